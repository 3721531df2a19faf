"""Ordered series operators: expressions over a window of one key's rows in order.

A builder takes the ordered window (partitioned by key, ordered by time) and columns of one frame. Rows that an operator does not
emit (its warm-up) are null: absence is always a prefix of a key's rows, so aggregates skip it and ``kept`` filters it at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import RAISE, guard, hhmm


def _enough(x: Column, frame: WindowSpec, least: int, value: Column) -> Column:
    return F.when(F.count(x).over(frame) >= least, value)


def _trailing(w: WindowSpec, n: int) -> WindowSpec:
    if n < 1:
        raise ValueError("WINDOW_INVALID")
    return w.rowsBetween(-(n - 1), 0)


def rolling(agg):
    def run(w, x, window, min_periods=None):
        frame = _trailing(w, window)
        return F.when(x.isNotNull(), _enough(x, frame, min_periods or window, agg(x).over(frame)))

    return run


def zscore(w, x, window, min_periods=None):
    frame = _trailing(w, window)
    sd = F.stddev_pop(x).over(frame)
    return F.when(x.isNotNull(), _enough(x, frame, min_periods or window, F.when(sd == 0, 0.0).otherwise((x - F.avg(x).over(frame)) / sd)))


def shift(w, x, periods=1, allow_unsafe_future=False):
    if periods < 0 and not allow_unsafe_future:
        raise ValueError("UNSAFE_FUTURE_SHIFT")
    return F.lag(x, periods).over(w) if periods >= 0 else F.lead(x, -periods).over(w)


def pct_change(w, x, policy=RAISE):
    before = F.lag(x).over(w)
    return guard(F.try_divide(x, before) - 1, before == 0, "DATA_DIVIDE_BY_ZERO", policy)


def log_return(w, x, policy=RAISE):
    before = F.lag(x).over(w)
    return guard(F.ln(F.try_divide(x, before)), (before <= 0) | (x <= 0), "DATA_LOG_RETURN_DOMAIN_ERROR", policy)


def cross(up: bool, down: bool):
    def run(w, a, b):
        was, other = F.lag(a).over(w), F.lag(b).over(w)
        rose, fell = (was <= other) & (a > b), (was >= other) & (a < b)
        return F.when(was.isNotNull() & other.isNotNull(), rose | fell if up and down else rose if up else fell)

    return run


def zscore_revert(w, x, threshold=2.0):
    was = F.lag(x).over(w)
    return (F.abs(was) >= threshold) & (F.abs(x) < F.abs(was)) & ((was * x > 0) | (was == 0) | (x == 0))


def bollinger(w, x, window, width=2.0, min_periods=None):
    mean, sd = rolling(F.avg)(w, x, window, min_periods), rolling(F.stddev_pop)(w, x, window, min_periods)
    return {"middle": mean, "upper": mean + width * sd, "lower": mean - width * sd}


def channel(w, high, low, window):
    """Highest high and lowest low of the rows before this one."""
    frame = w.rowsBetween(-window, -1)
    return {"upper": _enough(high, frame, window, F.max(high).over(frame)), "lower": _enough(low, frame, window, F.min(low).over(frame))}


def channel_breakout(w, high, low, close, window):
    bands = channel(w, high, low, window)
    return (close > bands["upper"]) | (close < bands["lower"])


def regression(part: str):
    def run(w, y, x, window, policy=RAISE):
        if window < 2:
            raise ValueError("WINDOW_INVALID")
        frame = _trailing(w, window)
        pair = F.when(x.isNotNull(), y)
        flat = (F.count(pair).over(frame) >= window) & (F.var_pop(F.when(y.isNotNull(), x)).over(frame) == 0)
        beta, alpha = F.regr_slope(y, x).over(frame), F.regr_intercept(y, x).over(frame)
        return _enough(pair, frame, window, guard(beta if part == "beta" else y - (alpha + beta * x), flat, "INDICATOR_ZERO_VARIANCE", policy))

    return run


def slope(w, x, window):
    """Least-squares slope against 0..n-1: a weighted sum over the frame's values, whatever its length in one expression."""
    if window < 2:
        raise ValueError("WINDOW_INVALID")
    mid = (window - 1) / 2
    held = F.collect_list(x).over(_trailing(w, window))
    total = F.aggregate(F.transform(held, lambda v, k: v * (k - mid)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(held) == window, total / sum((k - mid) ** 2 for k in range(window)))


def forward_fill(w, x):
    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def score_zscore(frame: DataFrame, keys: list[str], x: str, out: str = "value") -> DataFrame:
    """Whole-series population z-score: a key's moments are aggregated before the exchange and joined back."""
    sd, mean = F.col("_sd"), F.col("_mean")
    moments = frame.groupBy(*keys).agg(F.stddev_pop(x).alias("_sd"), F.avg(x).alias("_mean"))
    return frame.join(moments, keys).withColumn(out, F.when(sd == 0, 0.0).otherwise((F.col(x) - mean) / sd)).drop("_sd", "_mean")


def true_range(w, high, low, close, policy=RAISE):
    before = F.lag(close).over(w)
    return guard(F.greatest(high - low, F.abs(high - before), F.abs(low - before)), high < low, "INDICATOR_RANGE_INVALID", policy)


SERIES = {
    "core.data.identity": lambda w, x: x,
    "core.data.shift": shift,
    "core.data.diff": lambda w, x: x - F.lag(x).over(w),
    "core.data.pct_change": pct_change,
    "core.data.log_return": log_return,
    "core.align.forward_fill": forward_fill,
    **{f"core.window.{k}": rolling(f) for k, f in {"max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_pop, "sum": F.sum, "count": F.count}.items()},
    "core.window.zscore": zscore,
    "core.signal.cross_above": cross(True, False),
    "core.signal.cross_below": cross(False, True),
    "core.signal.crosses": cross(True, True),
    "core.signal.zscore_revert": zscore_revert,
    "core.indicator.sma": rolling(F.avg),
    "core.indicator.rolling_mean": rolling(F.avg),
    "core.indicator.rolling_std": rolling(F.stddev_pop),
    "core.indicator.rolling_zscore": zscore,
    "core.indicator.bollinger": bollinger,
    "core.indicator.bollinger_band": bollinger,
    "core.indicator.channel_breakout": channel_breakout,
    "core.indicator.donchian_channel": channel,
    "core.indicator.linear_regression_slope": slope,
    "core.indicator.beta": regression("beta"),
    "core.indicator.residual": regression("residual"),
    "core.factor.beta_neutral_signal": regression("residual"),
}


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def kept(frame: DataFrame, column: str) -> DataFrame:
    """Without the rows that an operator does not emit."""
    return frame.where(F.col(column).isNotNull())


def volatility(frame: DataFrame, w: WindowSpec, x: str, window: int, out: str = "value") -> DataFrame:
    """Population deviation of the last ``window`` relative changes."""
    return frame.withColumn("_change", pct_change(w, F.col(x))).withColumn(out, rolling(F.stddev_pop)(w, F.col("_change"), window)).drop("_change")


def session_filter(frame: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to ``end`` (HH:MM, inclusive); no session over midnight."""
    if start > end:
        raise ValueError("TIME_SESSION_INVALID")
    return frame.where(hhmm(F.col(ts)).between(start, end))


def inner_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "inner")


def left_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left")


def drop_missing(frame: DataFrame, column: str) -> DataFrame:
    return frame.where(F.col(column).isNotNull())


FRAMES = {"core.score.zscore": score_zscore, "core.time.session_filter": session_filter, "core.align.inner_join": inner_join, "core.align.left_join": left_join, "core.align.drop_missing": drop_missing, "core.indicator.volatility": volatility}
