"""Weighted coverage of a matrix of strategy patterns: which kinds of strategies the vocabulary can express."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, benchmark_group string, category string, status string, classification string, weight double, mechanical string, semantic string, boundary string, missing_tokens array<string>, kernel_gaps array<string>"
CLASSES = ("supported", "partially_supported", "custom_token_required")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """(a row for each pattern of a YAML or JSON matrix, the discount of custom tokens)."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    rows = []
    for p in raw.get("patterns") or ():
        checked, gaps, weight = p.get("false_supported") or {}, p.get("gaps") or {}, p.get("market_weight") or {}
        name = lambda g: g.get("name") or g.get("id") if isinstance(g, dict) else g
        rows.append((
            p["id"], p.get("benchmark_group"), p.get("category"), p.get("status", "active"), p.get("expected_classification"), float(weight.get("final", 0) if isinstance(weight, dict) else weight),
            checked.get("mechanical_status"), checked.get("semantic_status"), checked.get("boundary_status"), [name(g) for g in gaps.get("missing_tokens") or ()], [name(g) for g in gaps.get("kernel_gaps") or ()],
        ))
    discount = ((raw.get("coverage_policy") or {}).get("custom_token_discount") or {}).get("value", 0.5)
    return spark.createDataFrame(rows, SCHEMA), float(discount)


def by_class(patterns: DataFrame) -> DataFrame:
    """classification, patterns, weight of the active ones outside the dogfood group."""
    return frontier(patterns).groupBy("classification").agg(F.count("*").alias("patterns"), F.sum("weight").alias("weight"))


def frontier(patterns: DataFrame) -> DataFrame:
    return patterns.where("status = 'active' and coalesce(benchmark_group, '') <> 'dogfood'")


def metrics(patterns: DataFrame, discount: float = 0.5) -> DataFrame:
    """One row of ratios by weight, rounded to four places; rates of supported rows that a review found wrong are by number."""
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("classification") == name, F.col("weight"))), F.lit(0.0))
    failed = lambda c: F.count_if((F.col("classification") == "supported") & (F.col(c) == "fail"))
    direct = F.coalesce(F.sum(F.when((F.col("classification") == "supported") & (F.col("mechanical") == "pass"), F.col("weight"))), F.lit(0.0))
    held = frontier(patterns).agg(
        F.count("*").alias("frontier_patterns"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"), direct.alias("_direct"), *[of(c).alias(f"_{c}") for c in CLASSES],
        F.count_if(F.col("classification") == "supported").alias("_n"), *[failed(c).alias(f"_{c}_failed") for c in ("mechanical", "semantic", "boundary")],
        F.sum(F.size("kernel_gaps")).cast("long").alias("kernel_gap_count"), F.array_size(F.array_distinct(F.flatten(F.collect_list("missing_tokens")))).alias("_missing"),
    )
    total, raw = F.col("total_weight"), F.col("_supported") + F.col("_partially_supported") + F.col("_custom_token_required")
    return held.select(
        "frontier_patterns", "total_weight", ratio(F.col("_direct"), total).alias("direct_builtin_coverage"), ratio(raw, total).alias("routable_record_coverage_raw"),
        ratio(raw - (1 - discount) * F.col("_custom_token_required"), total).alias("routable_record_coverage_discounted"), ratio(F.col("_custom_token_required"), F.greatest(raw, F.lit(1.0))).alias("custom_token_route_share"),
        *[ratio(F.col(f"_{c}_failed"), F.greatest(F.col("_n"), F.lit(1))).alias(f"false_supported_rate_{c}") for c in ("mechanical", "semantic", "boundary")],
        "kernel_gap_count", ratio(F.col("_missing"), F.col("frontier_patterns")).alias("token_bloat_index"),
    )
