"""Helpers that the text operators share: shared-folder tables, skew-proof joins, scans of document tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: set[str] = set()
BATCH_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one is set only where that is unset, as in tests."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkstrat-"))
        found = context._jsc.sc().getCheckpointDir().get()
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone, and so nothing can be removed through it
        pass


def written(df: DataFrame, compression: str = "zstd", by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    by: a column whose values are folders, so that a filter on it reads its part only. The files go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkstrat/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).option("compression", compression).parquet(path)
    if not _WRITTEN:
        atexit.register(lambda: [_remove(spark, p) for p in _WRITTEN])
    _WRITTEN.add(path)
    return spark.read.schema(df.schema).parquet(path)


def release(docs: DataFrame, paths: set[str]) -> None:
    """Removes tables that ``written`` made, but for those that ``docs`` reads, and has Spark's cleaner drop the shuffle files of
    frames that nobody holds any more."""
    spark = docs.sparkSession
    read = docs.inputFiles() if paths else []
    for path in [p for p in paths if not any(p.rsplit("/", 1)[1] in f for f in read)]:
        _remove(spark, path)
        _WRITTEN.discard(path)
        paths.discard(path)
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Has Spark's cleaner drop the shuffle files of frames that nobody holds any more, so that steps do not add up on disk."""
    gc.collect()
    spark._jvm.System.gc()


def _rested(batches):
    """Each worker drops what it keeps from task to task and gives freed memory back."""
    import ctypes
    import sys

    import pyarrow as pa

    for name, kept in (("near_dedup", "_HASHES"), ("tokens", "_ENCODERS")):
        if module := sys.modules.get(f"{__package__}.{name}"):
            getattr(module, kept).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no such function in this C library
        pass
    yield from batches


def rest(spark: SparkSession, workers: bool = True) -> None:
    """Has executors and their Python workers give back the memory that a step has left, so that steps do not add up there.

    A Java heap that has grown shrinks only in a full collection. Two tasks for each core reach every worker as a rule; one that is
    missed only keeps its memory. No result depends on it. workers: False collects in the executors alone, without any Python there."""
    n = 2 * spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    reached = spark.range(0, n, 1, n)
    if workers:
        reached = reached.mapInArrow(_rested, "id long")
    reached.select(collected.alias("done")).write.format("noop").mode("overwrite").save()


def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bounds the bytes of a batch that goes to Python, which both the executor and its worker hold; a lower bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= limit:
        spark.conf.set(name, str(limit))


def drop(table: DataFrame) -> None:
    """Removes a table that ``written`` made and that no later step reads, and sweeps."""
    spark = table.sparkSession
    files = table.inputFiles()
    for path in [p for p in _WRITTEN if any(p.rsplit("/", 1)[1] in f for f in files)]:
        _remove(spark, path)
        _WRITTEN.discard(path)
    sweep(spark)


def tables() -> set[str]:
    """The tables that ``written`` has made and that have not been removed."""
    return set(_WRITTEN)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` through an exchange of both sides that adaptive execution can split.

    A side that an aggregate has just dealt by the same keys would be joined in place, so that all rows of a hot key met in
    one task. Joining on a computed hash (and on the keys themselves) makes Spark deal both sides anew, and skewed partitions
    are then split. Nulls in keys meet nulls. ``right`` must have the keys and other columns that ``left`` has not."""
    mixed = F.xxhash64(*[F.col(k) for k in keys], F.lit("join"))
    a = left.withColumn("_mixed", mixed)
    b = right.select(mixed.alias("_other"), *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on: Column = a["_mixed"] == b["_other"]
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"_r_{k}"])
    return a.join(b, on, how).drop("_mixed", "_other", *[f"_r_{k}" for k in keys])


def boxed(docs: DataFrame) -> DataFrame:
    """The rows as one struct, ``_doc``, so that no column of theirs clashes with those that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def unboxed(rows: DataFrame, columns: list[str], **other: Column) -> DataFrame:
    """The columns of the boxed rows; other: what stands in the place of some."""
    return rows.select(*[other.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in columns])


def arrow_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, with null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch, text: str, limit: int):
    """Parts of an Arrow batch of about ``limit`` bytes of text at most, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)
