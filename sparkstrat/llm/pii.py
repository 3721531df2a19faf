"""Personal data and the terms that disclose it, in DataFrame functions only.

Base: e-mail addresses, IP addresses, card and phone numbers by pattern and check. They are the protected entities, with secrets: runs
of 20 or more ASCII letters and digits that hold at least four of each, outside base spans (keys and tokens; words of a language don't
hold digits).

Information-theoretic sanitisation: each entity occurrence has a window of ``REACH`` characters on either side. The distinct
texts in which a window of an entity holds a term are its co-occurrences; together with the distinct texts that hold the term
anywhere in the corpus they estimate how much of the entity's information content the term discloses:

    disclosure = PMI(entity, term) / IC(entity) = 1 + log(n_te / n_t) / log(N / n_e)

An entity is a value (this address), and so is each kind (any secret): a term that stands beside values of a kind in nearly all
texts that hold it gives away that one is there. Terms in at least ``SUPPORT`` distinct windows of a value, or ``KIND_SUPPORT`` of a
kind, with a disclosure of ``GENERALISE`` or more are spans of kind ``term`` wherever
they stand, in all documents; the sanitised text has their class for them, or nothing from ``REMOVE`` on. Every count is
of distinct texts, so that exact copies change none of them, and equal windows are one support.

Cases: null text counts as empty; texts without entities get no spans. Spans may overlap where kinds do; the sanitised text
replaces the union. Repeated rows get the same spans each. Ties of a disclosure need no order. Very long texts are searched whole.
Extra columns, of any name, are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, spread_join, unboxed, written

REACH = 64
SUPPORT = 3
KIND_SUPPORT = 10
GENERALISE = 0.8
REMOVE = 0.95
BROADCAST_TERMS = 50_000
# Possessive forms of the patterns: they match the same, without Java's recursion over repeated groups.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}_]{4,40}"
SECRET = r"[A-Za-z0-9]{20,}+"
KINDS = ["email", "ip", "card", "phone", "secret", "term"]
SECRETS, TERMS = 4, 5
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def spans(text: Column, pattern: str, kind: int, base: Column | int = 0) -> Column:
    """The matches of a pattern as (start, kind, end, value); offsets in code points, from ``base`` on."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shift = base if isinstance(base, Column) else F.lit(base)

    def walk(g: Column, m: Column) -> Column:
        empty = F.struct(shift.cast("int").alias("at"), F.array().cast(_SPAN).alias("out"))

        def one(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            end = start + F.length(x["m"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("value")))).alias("out"))

        return F.aggregate(F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: F.struct(a.alias("gap"), b.alias("m"))), empty, one, lambda s: s["out"])

    return _let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(_SPAN)).otherwise(_let(gaps, lambda g: walk(g, m))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _let(F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind."""
    octet = lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(F.substring(q, 1, 3).try_cast("int"), F.lit(0)) <= 255))
    some = lambda mark, value: F.when(F.instr(text, mark) > 0, value).otherwise(F.array().cast(_SPAN))
    email = some("@", spans(text, EMAIL, 0))
    ip = some(".", F.filter(spans(text, IP, 1), lambda s: F.forall(F.split(s["value"], "[.]"), octet)))
    card = F.filter(spans(text, CARD, 2), lambda s: _let(_digits(s["value"]), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))))
    phone = some("+", F.filter(spans(text, PHONE, 3), lambda s: F.length(_digits(s["value"])).between(9, 15)))
    return F.array_sort(F.concat(email, ip, card, phone))


def secret_spans(text: Column, base: Column) -> Column:
    """The secrets of a text that do not touch its base spans."""
    least = lambda v, letters: F.length(v) - F.length(F.regexp_replace(v, letters, "")) >= 4
    free = lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    return F.filter(spans(text, SECRET, SECRETS), lambda s: least(s["value"], "[0-9]") & least(s["value"], "[A-Za-z]") & free(s))


def protected(text: Column) -> Column:
    """Base spans and secrets, by start, then kind."""
    return _let(base_spans(text), lambda base: F.array_sort(F.concat(base, secret_spans(text, base))))


def replaced(text: Column, marks: Column, put) -> Column:
    """``text`` with ``put(span)`` for the union of overlapping sorted spans (that of the first span in each union)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def one(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(before, put(s))).alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out")))

    done = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(marks) == 0, text).otherwise(F.aggregate(marks, start, one, done))


def _blanked(text: Column, marks: Column) -> Column:
    """``text`` with spaces for the sorted spans; offsets stay."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def one(state: Column, s: Column) -> Column:
        low = F.greatest(s["start"], state["at"])
        put = F.concat(state["out"], F.array(F.substring(text, state["at"] + 1, low - state["at"]), F.repeat(F.lit(" "), s["end"] - low)))
        return F.when(s["end"] > state["at"], F.struct(s["end"].alias("at"), put.alias("out"))).otherwise(state)

    return F.aggregate(marks, start, one, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def joined(marks: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(marks, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _windows(found: DataFrame) -> DataFrame:
    """Two rows for each entity occurrence, for its value and for its kind: doc_id, body, entity, window (hash) and its terms as spans."""
    blanked = _blanked(F.col("text"), F.col("base"))
    one = found.where(F.size("base") > 0).withColumn("blank", blanked).select("doc_id", "body", "blank", F.explode("base").alias("s"))
    low = F.greatest(F.lit(0), F.col("s.start") - REACH)
    left, right = F.substring(F.col("blank"), F.col("low") + 1, F.col("s.start") - F.col("low")), F.substring(F.col("blank"), F.col("s.end") + 1, F.lit(REACH))
    number = F.when(F.col("s.kind") == 0, F.lower("s.value")).when(F.col("s.kind").isin(1, SECRETS), F.col("s.value")).otherwise(_digits(F.col("s.value")))
    cut = one.withColumn("low", low).withColumn("left", left).withColumn("right", right)
    before = F.filter(spans(F.col("left"), TERM, TERMS, F.col("low")), lambda t: (t["start"] > F.col("low")) | (F.col("low") == 0))
    after = F.filter(spans(F.col("right"), TERM, TERMS, F.col("s.end")), lambda t: (t["end"] < F.col("s.end") + REACH) | (t["end"] == F.length("blank")))
    entities = F.array(F.concat_ws(":", "s.kind", number), F.col("s.kind").cast("string"))
    each = cut.select("doc_id", "body", entities.alias("entities"), F.xxhash64(F.lower("left"), F.lower("right")).alias("window"), F.concat(before, after).alias("terms"))
    return each.select("doc_id", "body", F.explode("entities").alias("entity"), "window", "terms")


def disclosing(found: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity, term, disclosure of the pairs that reach the lower threshold; doc_id, body, term wherever a candidate stands."""
    places = windows.dropDuplicates(["entity", "body", "window"])
    n_e = places.groupBy("entity").agg(F.countDistinct("body").alias("n_e"))
    terms_of = F.explode(F.array_distinct(F.transform("terms", lambda t: F.lower(t["value"])))).alias("term")
    pairs = places.select("entity", "body", "window", terms_of).groupBy("entity", "term").agg(F.countDistinct("window").alias("support"), F.countDistinct("body").alias("n_te"))
    # n_t is at least the number of texts with the term in a window: what that rules out needs no count over all texts.
    near = places.select("body", terms_of).distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    total = found.agg(F.countDistinct("body").alias("total"))
    likely = pairs.where(F.col("support") >= F.when(F.instr("entity", ":") > 0, SUPPORT).otherwise(KIND_SUPPORT)).join(n_e, "entity").join(near, "term").crossJoin(F.broadcast(total))  # one row on that side
    pairs = written(likely.where(_disclosure("n_near") >= GENERALISE).drop("n_near"))
    terms = pairs.select("term").distinct()
    wanted = F.broadcast(terms) if pairs.count() <= BROADCAST_TERMS else terms  # a row has 40 characters at most
    lowered = F.transform(F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0)), F.lower)
    held = written(found.select("doc_id", "body", F.explode(F.array_distinct(lowered)).alias("term")).join(wanted, "term", "left_semi"))
    n_t = held.select("body", "term").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    return pairs.join(n_t, "term").select("entity", "term", _disclosure("n_t").alias("disclosure")).where(F.col("disclosure") >= GENERALISE), held


def _disclosure(n: str) -> Column:
    return 1 + F.ln(F.least(F.lit(1.0), F.col("n_te") / F.col(n))) / F.ln(F.greatest(F.lit(2.0), F.col("total") / F.col("n_e")))


def term_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, body (xxhash64 of the text) and added: the disclosing terms, (term, disclosure), of documents that hold any."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("body"), protected(F.col("text")).alias("base"))
    windows = written(_windows(found.select("doc_id", "text", "body", "base")))
    pairs, held = disclosing(found, windows)
    telling = pairs.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    marks = spread_join(held, telling, ["term"])
    return marks.groupBy("doc_id", "body").agg(F.collect_set(F.struct("term", "disclosure")).alias("added"))  # as many as the document has terms


def _annotated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The boxed rows with ``pii``."""
    added = term_marks(docs, id_col, text_col)
    given = F.col(f"_doc.`{text_col}`").cast("string")
    text = F.coalesce(given, F.lit(""))
    plain = F.transform(protected(text), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.lit(None).cast("double").alias("disclosure")))
    # The spans are found below the exchange, so that each use of them above is of a column, and not of the search again.
    base = boxed(docs).withColumn("_key", F.struct(F.col(f"_doc.`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"))).withColumn("_base", plain)
    joined = spread_join(base, added.select(F.struct("doc_id", "body").alias("_key"), F.col("added").alias("_added")), ["_key"], "left")
    names = F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS])
    put = lambda s: F.when(F.coalesce(s["disclosure"] >= REMOVE, F.lit(False)), F.lit("")).otherwise(F.get(names, s["kind"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,disclosure:double>>")

    def marked(words: Column) -> Column:
        found = F.filter(spans(_blanked(text, F.col("_base")), TERM, TERMS), lambda s: F.map_contains_key(words, F.lower(s["value"])))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), words[F.lower(s["value"])].alias("disclosure")))

    terms = F.when(F.col("_added").isNull(), none).otherwise(_let(F.map_from_entries("_added"), marked))
    pii = joined.withColumn("_terms", terms)
    clean = F.when(given.isNotNull(), replaced(text, F.array_sort(F.concat("_base", "_terms")), put))
    kind = lambda test: F.filter("_base", lambda s: test(s["kind"]))
    return pii.select("_doc", F.struct(kind(lambda k: k < SECRETS).alias("base_spans"), kind(lambda k: k == SECRETS).alias("secret_spans"), F.col("_terms").alias("term_spans"), clean.alias("sanitised")).alias("pii"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with columns base_spans, secret_spans, term_spans and sanitised in a struct ``pii``, which replaces a column of that name."""
    marked = _annotated(docs, id_col, text_col)
    return marked.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c.lower() != "pii"], "pii")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the sanitised text in ``text_col``; same columns."""
    return unboxed(_annotated(docs, id_col, text_col), docs.columns, **{text_col: F.col("pii.sanitised")})
