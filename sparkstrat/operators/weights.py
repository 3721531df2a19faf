"""Portfolio weights: rows of (ts, symbol, weight, in_universe) as doubles; minus zero is never produced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import guard, unsigned_zero
from .panel import _grouped, at

_OUT = ["ts", "symbol", "weight", "in_universe"]


def _active(x):
    return F.when(F.col("in_universe"), x)


def to_weights(selection: DataFrame, method: str = "equal_long") -> DataFrame:
    """Equal weights of the selected active rows; only those are returned."""
    rows = selection.where("selected and in_universe")
    if method == "equal_long_short":
        side = F.when(F.col("side") == "short", F.lit(-1.0)).when(F.coalesce("side", F.lit("long")) == "long", F.lit(1.0))
        rows = rows.withColumn("_side", guard(side, F.col("side") == "both", "SELECTION_SIDE_INVALID"))
        weight = F.col("_side") / F.count("*").over(W.partitionBy("ts", "_side"))
    else:
        weight = F.lit({"equal_long": 1.0, "equal_short": -1.0}[method]) / F.count("*").over(at())
    return rows.withColumn("weight", weight).select(*_OUT)


def normalize_gross(weights: DataFrame, target_gross: float = 1.0, zero_gross_policy: str = "keep_zero") -> DataFrame:
    gross = F.sum(_active(F.abs("weight"))).over(at())
    scaled = F.when(gross == 0, 0.0).otherwise(F.col("weight") * target_gross / gross)
    if zero_gross_policy == "error":
        scaled = guard(scaled, gross == 0, "WEIGHT_ZERO_GROSS")
    return weights.withColumn("weight", F.when(F.col("in_universe"), unsigned_zero(scaled)).otherwise(F.col("weight"))).select(*_OUT)


def cap_per_symbol(weights: DataFrame, max_abs_weight: float) -> DataFrame:
    capped = F.least(F.greatest("weight", F.lit(-max_abs_weight)), F.lit(max_abs_weight))
    return weights.withColumn("weight", F.when(F.col("in_universe"), capped).otherwise(F.col("weight"))).select(*_OUT)


def market_neutral(weights: DataFrame, target_gross: float = 1.0, target_net: float = 0.0, zero_gross_policy: str = "keep_zero") -> DataFrame:
    if target_net != 0:
        raise ValueError("WEIGHT_TARGET_NET_UNSUPPORTED")
    if target_gross < 0:
        raise ValueError("WEIGHT_TARGET_GROSS_INVALID")
    active = F.count(_active(F.lit(1))).over(at())
    weights = weights.withColumn("weight", guard(F.col("weight"), active == 0, "WEIGHT_EMPTY_UNIVERSE"))
    centred = weights.withColumn("weight", F.when(F.col("in_universe"), F.col("weight") - F.avg(_active(F.col("weight"))).over(at())).otherwise(F.col("weight")))
    return normalize_gross(centred, target_gross, zero_gross_policy)


def normalize_net(weights: DataFrame, target_net: float = 0.0) -> DataFrame:
    """Adds the same to each active weight; others stay."""
    add = (target_net - F.sum(_active(F.col("weight"))).over(at())) / F.count(_active(F.lit(1))).over(at())
    return weights.withColumn("weight", F.when(F.col("in_universe"), unsigned_zero(F.col("weight") + add)).otherwise(F.col("weight"))).select(*_OUT)


def rank_weight(ranked: DataFrame, target_gross: float = 1.0, side: str = "long") -> DataFrame:
    rank = guard(F.col("value"), F.col("value") <= 0, "WEIGHT_RANK_INVALID")
    score = F.count(_active(F.lit(1))).over(at()) - rank + 1
    scored = ranked.withColumn("_score", F.when(F.col("in_universe"), score).otherwise(0.0))
    weight = F.lit(target_gross * (-1 if side == "short" else 1)) * F.col("_score") / F.sum("_score").over(at())
    return scored.withColumn("weight", F.when(F.col("in_universe"), weight).otherwise(0.0)).select(*_OUT)


def inverse_vol_weight(volatility: DataFrame, target_gross: float = 1.0) -> DataFrame:
    inverse = guard(F.try_divide(F.lit(1.0), F.col("value")), F.col("in_universe") & (F.col("value") <= 0), "WEIGHT_VOLATILITY_INVALID")
    rows = volatility.withColumn("_inverse", F.when(F.col("in_universe"), inverse))
    return rows.withColumn("weight", F.coalesce(F.lit(target_gross) * F.col("_inverse") / F.sum("_inverse").over(at()), F.lit(0.0))).select(*_OUT)


def group_neutral_weight(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """Less the mean of the group's active weights; inactive rows get 0."""
    rows = _grouped(weights, groups, "error")
    mean = F.avg(_active(F.col("weight"))).over(W.partitionBy("ts", "grp"))
    return rows.withColumn("weight", F.when(F.col("in_universe"), unsigned_zero(F.col("weight") - mean)).otherwise(0.0)).select(*_OUT)


def volatility_target(weights: DataFrame, volatility: DataFrame, target_volatility: float) -> DataFrame:
    """weight * target / volatility of the same (ts, symbol); a missing or non-positive volatility is an error."""
    joined = weights.join(volatility.select("ts", "symbol", F.col("value").alias("_vol")), ["ts", "symbol"], "left")
    bad = F.col("in_universe") & (F.col("_vol").isNull() | (F.col("_vol") <= 0))
    scaled = guard(F.col("weight") * target_volatility / F.when(F.col("_vol") > 0, F.col("_vol")), bad, "RISK_VOLATILITY_INVALID")
    return joined.withColumn("weight", F.when(F.col("in_universe"), scaled).otherwise(F.col("weight"))).select(*_OUT)


def turnover_cap(weights: DataFrame, previous: DataFrame, max_turnover: float) -> DataFrame:
    """Previous weight plus the change, clipped; a missing previous weight is an error."""
    joined = weights.join(previous.select("ts", "symbol", F.col("weight").alias("_was")), ["ts", "symbol"], "left")
    change = F.least(F.greatest(F.col("weight") - F.col("_was"), F.lit(-max_turnover)), F.lit(max_turnover))
    moved = guard(F.col("_was") + change, F.col("in_universe") & F.col("_was").isNull(), "RISK_PREVIOUS_WEIGHT_MISSING")
    return joined.withColumn("weight", F.when(F.col("in_universe"), unsigned_zero(moved)).otherwise(F.col("weight"))).select(*_OUT)


WEIGHTS = {
    "core.selection.to_weights": to_weights, "core.weight.equal_weight": to_weights, "core.decision.selection_to_weight": to_weights,
    "core.weight.normalize_gross": normalize_gross, "core.weight.cap_per_symbol": cap_per_symbol, "core.weight.max_weight_clip": cap_per_symbol,
    "core.weight.market_neutral": market_neutral, "core.weight.market_neutral_weight": market_neutral, "core.weight.normalize_net": normalize_net,
    "core.weight.rank_weight": rank_weight, "core.weight.inverse_vol_weight": inverse_vol_weight, "core.weight.group_neutral_weight": group_neutral_weight,
    "core.weight.vol_target_weight": volatility_target, "core.risk.volatility_target": volatility_target, "core.risk.volatility_target_record": volatility_target,
    "core.risk.turnover_cap": turnover_cap, "core.risk.turnover_limit_record": turnover_cap,
}
