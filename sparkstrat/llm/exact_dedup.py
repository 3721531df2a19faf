"""Exact dedup by block naming.

A normalised text is cut into fixed-size blocks. The distinct blocks are sorted and numbered, so that equal blocks have equal
integer names; then the names of adjacent pairs are named in the same way, round by round, until each document has one name.
Names stand for compared bytes, never for hashes, so no two different texts share an identity.

A block whose 64-bit hash occurs once equals no other block; such blocks and their documents need no name and leave early.

Cases: null text counts as empty, and empty texts equal one another. Runs of white space (space, tab to carriage return) count
as one space. Of equal texts the row with the smallest doc_id stays (nulls last); of rows that repeat a doc_id one stays.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, boxed, spread_join, unboxed, written

BLOCK_BYTES = 16384
_SPACES = re.compile(rb"[\x20\x09-\x0d]{2,}|[\x09-\x0d]")
_BLOCKS = "row long, doc_id long, sha binary, n_blocks int, idx int, h long, block binary"


def normalise(text: bytes) -> bytes:
    return _SPACES.sub(b" ", text)


def _cut(block_bytes: int):
    def run(batches):
        import pyarrow as pa
        import xxhash
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("n_blocks", pa.int32()), ("idx", pa.int32()), ("h", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            ids, rows, out, held = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), [], 0
            for row, doc_id, text in zip(rows, ids, arrow_bytes(batch.column("text")), strict=True):
                text = normalise(text)
                n = max(1, -(-len(text) // block_bytes))
                for i in range(n):
                    part = text[i * block_bytes : (i + 1) * block_bytes]
                    out.append((row, doc_id, hashlib.sha256(text).digest() if i == 0 else None, n, i, xxhash.xxh64_intdigest(part) - (1 << 63), squeeze(part)))
                held += len(text)
                if held > 16_000_000:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _named(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with the integer name of its keys: the distinct keys, sorted within hash partitions, are numbered."""
    names = df.select(*keys).distinct().sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())
    return spread_join(df, names, keys).drop(*keys)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and row.

    row: a column of ``docs`` with unique integers, returned as ``row``; rows are numbered here if it is not given."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    base = docs.select(number.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(base.mapInArrow(_cut(block_bytes), _BLOCKS), "none")  # the blocks are compressed already
    shared = blocks.groupBy("h").count().where("count > 1").select("h")
    doubtful = written(spread_join(blocks.select("row", "doc_id", "n_blocks", "idx", "h", "block"), shared, ["h"]).drop("h"))
    # Names of a round are never compared with those of another: n_blocks fixes the round in which a document is done.
    level = _named(doubtful, ["block"], "name").withColumn("n", F.col("n_blocks")).checkpoint()
    done = level.where("n = 1")
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    while longest > 1:
        pairs = (
            level.where("n > 1").groupBy("row", "doc_id", "n_blocks", "n", F.floor(F.col("idx") / 2).cast("int").alias("idx"))
            .agg(F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("a"), F.max(F.expr("if(idx % 2 = 1, name, null)")).alias("b"))
            .where("a is not null and (b is not null or 2 * idx + 1 >= n)")  # else one of them is a block that equals no other
            .withColumn("b", F.coalesce("b", F.lit(-1)))
        )
        level = _named(pairs, ["a", "b"], "name").withColumn("n", F.ceil(F.col("n") / 2).cast("int")).checkpoint()
        done = done.unionByName(level.where("n = 1"))
        longest = -(-longest // 2)
    groups = done.groupBy("n_blocks", "name").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("row").alias("r"))).alias("keep"), F.count("*").alias("size")
    )
    verdict = spread_join(done.select("row", "n_blocks", "name"), groups, ["n_blocks", "name"]).select("row", "keep", "size")
    return (
        blocks.where("idx = 0").select("row", "doc_id", "sha").join(verdict, "row", "left")
        .select(
            "doc_id",
            F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep.id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("keep.r") == F.col("row"), F.lit(True)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
            "row",
        )
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; same columns."""
    numbered = written(boxed(docs).withColumn("_row", F.monotonically_increasing_id()))  # the numbers must not change when a scan is repeated
    stay = exact_groups(numbered, f"_doc.`{id_col}`", f"_doc.`{text_col}`", block_bytes, "_row").where("kept").select(F.col("row").alias("_row"))
    return unboxed(numbered.join(stay, "_row", "left_semi"), docs.columns)
