"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (ASCII letters lower-cased, runs of white space as one space, trimmed) and hashed once; a table of each row's
counts and line hashes is written, and everything else is aggregated from it. The distinct documents that hold a line are
counted for each host; lines in at least ``MIN_DOCS`` documents and more than ``MAX_PERCENT`` per cent of the host's documents
are removed there, and a document that loses more than half of its words is depleted and rejected. The limit is a share, so it
means the same at every size. Exact copies with ids of their own are documents of their own; rows that repeat doc_id and text
are one.

Cases: null text counts as empty; a text without words has no lines and fails the base rules. A null host is a host of its own.
Rows that repeat doc_id, host and text get the same verdict each. Lines without a word are neither counted nor removed. A line
that very many documents share is pre-aggregated in each task; its occurrences are joined through a skew-proof exchange.
Texts of any length are read whole; extra columns, of any name, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, spread_join, unboxed, written

MAX_PERCENT = 5
MIN_DOCS = 20
MIN_WORDS = 50
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def _blank(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\x0c\r", "     ")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(_blank(text), " "), "")


def lines_of(text: Column) -> Column:
    """The lines with a word, in order."""
    return F.filter(F.split(text, "\n"), lambda x: F.trim(_blank(x)) != "")


def normal_line(line: Column) -> Column:
    ascii_low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_join(words_of(ascii_low), " ")


def repeat_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(places, k - 1)))), F.lit(0), lambda a, x: a + x)

    def twice(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        same = _let(pairs, lambda s: F.filter(s, lambda e, k: (F.get(s, k - 1)["g"] == e["g"]) | (F.get(s, k + 1)["g"] == e["g"])))
        return _let(F.array_sort(F.transform(same, lambda e: e["i"])), covered)

    return F.when(n < 3, 0).otherwise(_let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(twice(g))))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A written table of one row per row of ``docs``: row (a number), doc_id, host, body (hash of the text), the five counts, and
    lines (hash and words of each line with a word)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    named = lambda found: F.transform(found, lambda x: _let(normal_line(x), lambda t: F.struct(F.xxhash64(t).alias("h"), F.size(F.split(t, " ")).alias("w"))))
    found = _let(lines_of(F.col("text")), lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), named(x).alias("lines")))
    counted = _let(words_of(F.col("text")), lambda x: F.struct(F.size(x).cast("long").alias("n"), repeat_words(x).cast("long").alias("repeat")))
    return written(base.select(
        "row", "doc_id", "host", F.xxhash64("text").alias("body"), counted.alias("words"), found.alias("found"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select("row", "doc_id", "host", "body", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("found.dup").alias("n_dup_lines"), F.col("words.repeat").alias("n_repeat_words"), F.col("found.lines").alias("lines")))


def frequent_lines(table: DataFrame, max_percent: float = MAX_PERCENT, min_docs: int = MIN_DOCS) -> DataFrame:
    """host, h of the lines over the limits; table: of ``line_table``."""
    once = F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")
    docs = table.select("host", "doc_id", "body").distinct().groupBy("host").agg(F.count("*").alias("all_docs"))
    held = table.select("host", "doc_id", "body", once).distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    return spread_join(held, docs, ["host"]).where(100 * F.col("docs") > max_percent * F.col("all_docs")).select("host", "h")


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_percent: float = MAX_PERCENT, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words, and gone (the hashes of its removed lines)."""
    table = line_table(docs, id_col, text_col, host_col)
    lines = table.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.w")
    hit = spread_join(lines, frequent_lines(table, max_percent, min_docs), ["host", "h"])
    loss = hit.groupBy("row").agg(F.sum("w").alias("lost"), F.collect_set("h").alias("gone"))  # as many as the document has lines
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.coalesce("lost", F.lit(0)).cast("long")
    return table.drop("lines").join(loss, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (2 * lost <= F.col("n_words"))).alias("kept"), lost.alias("n_removed_words"), F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"), "host", "body",
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_percent: float = MAX_PERCENT, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that are kept, without their removed lines; same columns."""
    box = boxed(docs)
    text = F.coalesce(F.col(f"_doc.`{text_col}`").cast("string"), F.lit(""))
    verdict = line_quality(docs, id_col, text_col, host_col, max_percent, min_docs).where("kept").select("doc_id", "host", "body", "gone").dropDuplicates(["doc_id", "host", "body"])
    key = F.struct(F.col(f"_doc.`{id_col}`").cast("long").alias("doc_id"), F.col(f"_doc.`{host_col}`").cast("string").alias("host"), F.xxhash64(text).alias("body"))
    held = spread_join(box.withColumn("_key", key), verdict.select(F.struct("doc_id", "host", "body").alias("_key"), F.col("gone").alias("_gone")), ["_key"])
    stay = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_gone", F.xxhash64(normal_line(x)))), "\n")
    return unboxed(held, docs.columns, **{text_col: stay})
