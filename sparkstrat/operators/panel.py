"""Cross-sectional operators on panels: rows of (ts, symbol, value, in_universe), windows over one timestamp.

Rows outside the universe are dropped by rank, zscore, demean, winsorize, top_k and bottom_k, and kept by mask and the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import guard, unsigned_zero

SNAP = 1e-12


def at():
    """The rows of one timestamp."""
    return W.partitionBy("ts")


def active(panel: DataFrame, missing_policy: str = "error_on_missing") -> DataFrame:
    rows = panel.where("in_universe")
    if missing_policy == "drop_missing":
        return rows.where("value is not null")
    return rows.withColumn("value", guard(F.col("value"), F.col("value").isNull(), "PANEL_MISSING_VALUE"))


def mask(panel: DataFrame, members: DataFrame) -> DataFrame:
    """members: symbol (included ones), or a selection with ts, symbol, selected and in_universe. Rows stay."""
    keys = [c for c in ("ts", "symbol") if c in members.columns]
    allowed = members.where("selected and in_universe") if "selected" in members.columns else members
    flag = allowed.select(*keys).distinct().withColumn("_in", F.lit(True))
    return panel.join(flag, keys, "left").withColumn("in_universe", F.col("in_universe") & F.coalesce("_in", F.lit(False))).drop("_in")


def rank(panel: DataFrame, order: str = "descending", rank_base: int = 1, missing_policy: str = "error_on_missing") -> DataFrame:
    by = F.desc("value") if order == "descending" else F.asc("value")
    return active(panel, missing_policy).withColumn("value", (F.row_number().over(at().orderBy(by, "symbol")) + (rank_base - 1)).cast("double"))


def zscore(panel: DataFrame, missing_policy: str = "error_on_missing") -> DataFrame:
    sd, mean = F.stddev_pop("value").over(at()), F.avg("value").over(at())
    z = F.when(sd == 0, 0.0).otherwise((F.col("value") - mean) / sd)
    scored = active(panel, missing_policy).withColumn("value", z)
    return scored.withColumn("value", F.when(F.abs("value") < SNAP, 0.0).otherwise(F.col("value")))


def demean(panel: DataFrame, missing_policy: str = "error_on_missing") -> DataFrame:
    return active(panel, missing_policy).withColumn("value", F.col("value") - F.avg("value").over(at()))


def _select(panel: DataFrame, k: int, largest: bool, missing_policy: str, allow_smaller: bool) -> DataFrame:
    if k < 1:
        raise ValueError("PANEL_K_INVALID")
    by = F.desc("value") if largest else F.asc("value")
    rows = active(panel, missing_policy)
    if not allow_smaller:
        rows = rows.withColumn("value", guard(F.col("value"), F.count("*").over(at()) < k, "PANEL_K_TOO_LARGE"))
    chosen = F.row_number().over(at().orderBy(by, "symbol")) <= k
    return rows.withColumn("selected", chosen).select("ts", "symbol", "selected", F.lit("long" if largest else "short").alias("side"), F.col("value").alias("score"), "in_universe")


def top_k(panel: DataFrame, k: int, missing_policy: str = "error_on_missing", allow_smaller: bool = True) -> DataFrame:
    """The k largest values, ties by symbol; every active row is returned with its flag."""
    return _select(panel, k, True, missing_policy, allow_smaller)


def bottom_k(panel: DataFrame, k: int, missing_policy: str = "error_on_missing", allow_smaller: bool = True) -> DataFrame:
    return _select(panel, k, False, missing_policy, allow_smaller)


def top_bottom(panel: DataFrame, k: int, missing_policy: str = "error_on_missing") -> DataFrame:
    """The k largest long and the k smallest others short, from one exchange."""
    if k < 1:
        raise ValueError("PANEL_K_INVALID")
    rows = active(panel, missing_policy).withColumn("_top", F.row_number().over(at().orderBy(F.desc("value"), "symbol"))).withColumn("_low", F.row_number().over(at().orderBy("value", "symbol")))
    side = F.when(F.col("_top") <= k, "long").when(F.col("_low") <= k, "short")
    return rows.select("ts", "symbol", side.isNotNull().alias("selected"), side.alias("side"), F.col("value").alias("score"), "in_universe")


def _grouped(rows: DataFrame, groups: DataFrame, missing_group_policy: str) -> DataFrame:
    """groups: symbol, grp, one row for each symbol; Spark broadcasts it if it is small."""
    joined = rows.join(groups.select("symbol", "grp"), "symbol", "left")
    if missing_group_policy == "drop":
        return joined.where("grp is not null")
    if missing_group_policy == "assign_unknown":
        return joined.withColumn("grp", F.coalesce("grp", F.lit("__unknown__")))
    return joined.withColumn("grp", guard(F.col("grp"), F.col("grp").isNull(), "PANEL_GROUP_MISSING"))


def group_demean(panel: DataFrame, groups: DataFrame, missing_group_policy: str = "error", missing_policy: str = "error_on_missing") -> DataFrame:
    rows = _grouped(active(panel, missing_policy), groups, missing_group_policy)
    return rows.withColumn("value", F.col("value") - F.avg("value").over(W.partitionBy("ts", "grp"))).select("ts", "symbol", "value", "in_universe")


def winsorize(panel: DataFrame, lower: float = 0.01, upper: float = 0.99, missing_policy: str = "error_on_missing") -> DataFrame:
    """Clipped to nearest-rank quantiles."""
    rows = active(panel, missing_policy).withColumn("_k", F.row_number().over(at().orderBy("value", "symbol"))).withColumn("_n", F.count("*").over(at()))

    def bound(q: float) -> Column:
        place = F.least(F.greatest(F.ceil(F.lit(q) * F.col("_n")), F.lit(1)), F.col("_n"))
        return F.max(F.when(F.col("_k") == place, F.col("value"))).over(at())

    bounded = rows.withColumn("_low", bound(lower)).withColumn("_high", bound(upper))
    return bounded.withColumn("value", F.least(F.greatest("value", "_low"), F.col("_high"))).drop("_k", "_n", "_low", "_high")


def residualize(panel: DataFrame, factor: DataFrame, include_intercept: bool = True, min_observations: int = 3, insufficient: str = "unknown", missing_policy: str = "error_on_missing") -> DataFrame:
    """Residuals of each symbol's full-sample regression on a factor (ts, factor); explicit sums keep near ties as they are."""
    rows = active(panel, missing_policy).join(factor.select("ts", "factor"), "ts")
    own = W.partitionBy("symbol")
    x, y, n = F.col("factor"), F.col("value"), F.count("*").over(own)
    centred = rows.withColumn("_n", n).withColumn("_mx", F.avg(x).over(own) if include_intercept else F.lit(0.0)).withColumn("_my", F.avg(y).over(own) if include_intercept else F.lit(0.0))
    ordered = own.orderBy("ts").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    dx, dy = x - F.col("_mx"), y - F.col("_my")
    sums = centred.withColumn("_xx", F.sum(dx * dx).over(ordered)).withColumn("_xy", F.sum(dx * dy).over(ordered))
    poor = (F.col("_n") < min_observations) | (F.col("_xx") == 0)
    beta = F.col("_xy") / F.when(F.col("_xx") != 0, F.col("_xx"))
    left = y - ((F.col("_my") - beta * F.col("_mx")) + beta * x)
    value = guard(left, poor, "PANEL_RESIDUAL_INSUFFICIENT", "raise" if insufficient == "error" else "null")
    return sums.withColumn("value", value).select("ts", "symbol", "value", "in_universe")


def sector_neutral_rank(panel: DataFrame, groups: DataFrame | None, order: str = "descending", **params) -> DataFrame:
    if groups is None:
        raise ValueError("FACTOR_GROUPS_REQUIRED")
    return rank(group_demean(panel, groups, **params), order)


def rank_to_selection(panel: DataFrame, k: int, side: str = "top", **params) -> DataFrame:
    return (top_k if side == "top" else bottom_k)(panel, k, **params)


PANEL = {
    "core.panel.mask": mask, "core.panel.rank": rank, "core.panel.zscore": zscore, "core.panel.demean": demean, "core.panel.top_k": top_k, "core.panel.bottom_k": bottom_k,
    "core.panel.group_demean": group_demean, "core.panel.winsorize": winsorize, "core.panel.residualize": residualize,
    "core.panel.cross_sectional_rank": rank, "core.panel.zscore_by_universe": zscore, "core.panel.neutralize_group": group_demean,
    "core.selection.top_k": top_k, "core.selection.bottom_k": bottom_k, "core.signal.rank_top_k": top_k, "core.signal.rank_bottom_k": bottom_k,
    "core.factor.sector_neutral_rank": sector_neutral_rank, "core.factor.residualize": residualize, "core.decision.rank_to_selection": rank_to_selection,
}

__all__ = ["PANEL", "unsigned_zero"]
