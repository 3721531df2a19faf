"""Token counts by a map-side two-tier lookup.

First tier: a broadcast table of the token counts of frequent pieces (a piece: a space with what follows up to the next),
taken from about ``sample`` documents and of at most ``entries`` entries, whatever the corpus. Second tier: what the table
misses is encoded by the library, once for each batch, and kept in a bounded cache of the worker. No piece is ever shuffled by
the count itself; the table only saves work and never changes a result.

Cases: null text counts as empty (0 bytes, 0 tokens). The special string in a text counts as the library's default has it: one
token. Texts without a space are one piece, encoded whole. Repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder, pieces_of

SAMPLE = 500
ENTRIES = 32_768
LIMIT = 512


def _frequent(batches):
    import pyarrow as pa

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(p for p in pieces_of(text or "") if len(p) <= 32)
        if len(seen) > 4 * ENTRIES:
            seen = Counter(dict(seen.most_common(2 * ENTRIES)))
    top = seen.most_common(ENTRIES)
    yield pa.record_batch({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})


def frequent_lengths(docs: DataFrame, path: str, sample: int = SAMPLE, entries: int = ENTRIES) -> dict[str, int]:
    """Token counts of at most ``entries`` pieces that are frequent in about ``sample`` rows, chosen by a hash of the id."""
    from .tokens import SPECIAL

    every = max(1, docs.count() // sample)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    top = some.mapInArrow(_frequent, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries).collect()
    return encoder(path, len).learn(r.piece for r in top if SPECIAL not in r.piece)


def _counted(path: str, table):
    def run(batches):
        import pyarrow as pa

        known, enc = table.value, encoder(path, len)
        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array([sum(v) for v in enc.encode(texts, known)], pa.int64()),
                })

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; path: a tokenizers file."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, path))
    counted = rows.mapInArrow(_counted(path, table), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
