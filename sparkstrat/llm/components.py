"""Connected components of an edge table, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours (small: those below it, and itself) linked with the least of them and itself."""
    if small:
        about = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        about = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = about.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = spread_join(about, least, ["u"])
    if small:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); the component is its smallest node."""
    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        found = current.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if found == state or not found.n:
            break
        state = found
        current = written(_stars(_stars(current, False), True))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct())
