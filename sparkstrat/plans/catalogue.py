"""The registered queries of the strategy operators, with the DuckDB SQL that each is compared with.

Series: events with a positive value, a user's rows by (ts, event_id); y is a second series. Bars: a user's days. Panels: order
totals by month and nation. Decisions and machine events: from event types.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import folds, panel, series, weights
from ..operators.decisions import FOLDED, ORDERED, ROW
from ..operators.scalar import SCALAR
from ..operators.series import SERIES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, build, sql: str | None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLE[name] = sql


def _r(x: Column) -> Column:
    """Doubles to six places, without minus zero."""
    y = F.round(x.cast("double"), 6)
    return F.when(y == 0, F.lit(0.0)).otherwise(y)


def _rs(x: str) -> str:
    return f"CASE WHEN round(CAST({x} AS DOUBLE), 6) = 0 THEN 0.0 ELSE round(CAST({x} AS DOUBLE), 6) END"


# Series.

EV = "ev AS (SELECT event_id, user_id, ts, value AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM events WHERE value > 0)"
ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    return rows.select("event_id", "user_id", "ts", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))


def ordered():
    return series.ordered(["user_id"], ["ts", "event_id"])


def _typed(value: Column, kind: str) -> Column:
    return {"double": _r, "long": lambda v: v.cast("long"), "bool": lambda v: v, "string": lambda v: v}[kind](value)


def _typed_sql(value: str, kind: str) -> str:
    return {"double": _rs(value), "long": f"CAST({value} AS BIGINT)", "bool": value, "string": value}[kind]


def _row(token: str, build, sql: str, kind: str = "double", where: str | None = None) -> None:
    """An expression for each event."""

    def run(spark, sf_dir):
        rows = events(spark, sf_dir)
        rows = rows.where(where) if where else rows
        return rows.select("event_id", _typed(build(), kind).alias("value"))

    _add("op_" + token.removeprefix("core.").replace(".", "_"), run, f"WITH {EV} SELECT event_id, {_typed_sql(sql, kind)} AS value FROM ev" + (f" WHERE {where}" if where else ""))


x, y = (lambda: F.col("x")), (lambda: F.col("y"))
XY = lambda f: lambda: f(F.col("x"), F.col("y"))
A, B = (lambda: F.col("x") > 50), (lambda: F.col("y") > 48)


def _scalars() -> None:
    s = SCALAR
    for name, sql in {"add": "x + y", "sub": "x - y", "mul": "x * y"}.items():
        _row(f"core.math.{name}", XY(s[f"core.math.{name}"]), sql)
    _row("core.math.div", lambda: s["core.math.div"](x(), y() + 0.37), "x / (y + 0.37)")  # no ties in the sixth place
    _row("core.math.neg", lambda: s["core.math.neg"](x()), "-x")
    _row("core.math.abs", lambda: s["core.math.abs"](x() - 50), "abs(x - 50)")
    _row("core.math.pow", lambda: s["core.math.pow"](x(), F.lit(1.5)), "pow(x, 1.5)")
    _row("core.math.sqrt", lambda: s["core.math.sqrt"](x()), "sqrt(x)")
    _row("core.math.log", lambda: s["core.math.log"](x()), "ln(x)")
    _row("core.math.exp", lambda: s["core.math.exp"](-x() / 100), "exp(-x / 100)")
    _row("core.math.clip", lambda: s["core.math.clip"](x(), 20.0, 80.0), "least(greatest(x, 20.0), 80.0)")
    _row("core.math.floor", lambda: s["core.math.floor"](x()), "floor(x)", "long")
    _row("core.math.ceil", lambda: s["core.math.ceil"](x()), "ceil(x)", "long")
    _row("core.math.round", lambda: s["core.math.round"](F.floor(x()) + F.lit(0.5)), "round_even(floor(x) + 0.5, 0)")  # ties only
    _add("op_math_round_digits", lambda r, d: events(r, d).select("event_id", _r(s["core.math.round"](F.floor(x()) / 8, 2)).alias("value")), f"WITH {EV} SELECT event_id, {_rs('round_even(floor(x) / 8, 2)')} AS value FROM ev")
    _row("core.math.sign", lambda: s["core.math.sign"](x() - y()), "sign(x - y)", "long")
    _row("core.math.isnan", lambda: s["core.math.isnan"](x()), "isnan(x)", "bool")
    _row("core.math.isfinite", lambda: s["core.math.isfinite"](x()), "isfinite(x)", "bool")
    _row("core.math.where", lambda: s["core.math.where"](A(), x(), y()), "CASE WHEN x > 50 THEN x ELSE y END")
    nan = lambda: F.when(A(), F.lit(float("nan"))).otherwise(x())
    _row("core.math.fill_nan", lambda: s["core.math.fill_nan"](nan(), -1.0), "CASE WHEN x > 50 THEN -1.0 ELSE x END")
    triple = lambda: F.array(x(), y(), F.lit(40.0))
    _row("core.math.min", lambda: s["core.math.min"](triple()), "least(x, y, 40.0)")
    _row("core.math.max", lambda: s["core.math.max"](triple()), "greatest(x, y, 40.0)")
    flags = lambda: F.array(A(), B())
    _row("core.bool.any", lambda: s["core.bool.any"](flags()), "x > 50 OR y > 48", "bool")
    _row("core.bool.all", lambda: s["core.bool.all"](flags()), "x > 50 AND y > 48", "bool")
    _row("core.bool.count_true", lambda: s["core.bool.count_true"](flags()), "CAST(x > 50 AS INT) + CAST(y > 48 AS INT)", "long")
    for group, names in (("bool", ("and", "or", "xor", "not")), ("logic", ("and", "or", "not")), ("signal", ("and", "or", "not"))):
        for name in names:
            token = f"core.{group}.{name}"
            sql = {"and": "x > 50 AND y > 48", "or": "x > 50 OR y > 48", "xor": "(x > 50) <> (y > 48)", "not": "NOT (x > 50)"}[name]
            _row(token, (lambda t=token: s[t](A())) if name == "not" else (lambda t=token: s[t](A(), B())), sql, "bool")
    for token, op in {**{f"core.cmp.{k}": v for k, v in {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}.items()}, **{f"core.compare.{k}": v for k, v in {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "="}.items()}, "core.signal.greater_than": ">", "core.signal.less_than": "<", "core.signal.breakout_up": ">", "core.signal.breakout_down": "<"}.items():
        _row(token, XY(s[token]), f"x {op} y", "bool")
    for group, names in (("cmp", ("between", "outside")), ("signal", ("between", "outside_band"))):
        for name in names:
            token = f"core.{group}.{name}"
            _row(token, lambda t=token: s[t](x(), F.lit(20.0), F.lit(70.0)), ("" if name == "between" else "NOT ") + "(x BETWEEN 20 AND 70)", "bool")
    _row("core.signal.threshold_above", lambda: s["core.signal.threshold_above"](x(), 50.0), "x >= 50", "bool")
    _row("core.signal.threshold_below", lambda: s["core.signal.threshold_below"](x(), 50.0, False), "x < 50", "bool")
    _row("core.norm.range_position", lambda: s["core.norm.range_position"](x(), y() + 1, y()), "(x - y) / ((y + 1) - y)")


def _series(token: str, sql: str, kind: str = "double", outputs: dict[str, str] | None = None, second: bool = False, **params) -> None:
    """A series operator over events; outputs: SQL of each output of a multi-output operator."""

    def run(spark, sf_dir):
        rows = events(spark, sf_dir)
        found = SERIES[token](ordered(), F.col("x"), *([F.col("y")] if second else []), **params)
        found = found if isinstance(found, dict) else {"value": found}
        out = rows.select("event_id", *[v.alias(k) for k, v in found.items()]).where(F.col(next(iter(found))).isNotNull())
        return out.select("event_id", *[_typed(F.col(k), kind).alias(k) for k in found])

    columns = outputs or {"value": sql}
    inner = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    outer = ", ".join(f"{_typed_sql(k, kind)} AS {k}" for k in columns)
    _add("op_" + token.removeprefix("core.").replace(".", "_"), run, f"WITH {EV}, s AS (SELECT *, row_number() OVER ({ORDER}) AS n FROM ev), f AS (SELECT event_id, {inner} FROM s) SELECT event_id, {outer} FROM f WHERE {next(iter(columns))} IS NOT NULL")


def _frame(n: int) -> str:
    return f"({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rolled(expression: str, n: int) -> str:
    return f"CASE WHEN count(x) OVER {_frame(n)} >= {n} THEN {expression} END"


def _all_series() -> None:
    lag = lambda c="x": f"lag({c}) OVER ({ORDER})"
    _series("core.data.identity", "x")
    _series("core.data.shift", f"lag(x, 2) OVER ({ORDER})", periods=2)
    _series("core.data.diff", f"x - {lag()}")
    _series("core.data.pct_change", f"x / {lag()} - 1")
    _series("core.data.log_return", f"ln(x / {lag()})")
    for name, agg in {"max": "max", "min": "min", "mean": "avg", "std": "stddev_pop", "sum": "sum", "count": "count"}.items():
        _series(f"core.window.{name}", _rolled(f"{agg}(x) OVER {_frame(5)}", 5), "long" if name == "count" else "double", window=5)
    z = _rolled(f"CASE WHEN stddev_pop(x) OVER {_frame(5)} = 0 THEN 0 ELSE (x - avg(x) OVER {_frame(5)}) / stddev_pop(x) OVER {_frame(5)} END", 5)
    _series("core.window.zscore", z, window=5)
    _series("core.indicator.rolling_zscore", z, window=5)
    for name in ("sma", "rolling_mean"):
        _series(f"core.indicator.{name}", _rolled(f"avg(x) OVER {_frame(7)}", 7), window=7)
    _series("core.indicator.rolling_std", _rolled(f"stddev_pop(x) OVER {_frame(7)}", 7), window=7)
    for name in ("bollinger", "bollinger_band"):
        mean, sd = f"avg(x) OVER {_frame(5)}", f"stddev_pop(x) OVER {_frame(5)}"
        _series(f"core.indicator.{name}", "", outputs={"middle": _rolled(mean, 5), "upper": _rolled(f"{mean} + 2 * {sd}", 5), "lower": _rolled(f"{mean} - 2 * {sd}", 5)}, window=5)
    rose, fell = f"({lag()} <= {lag('y')} AND x > y)", f"({lag()} >= {lag('y')} AND x < y)"
    for name, sql in {"cross_above": rose, "cross_below": fell, "crosses": f"({rose} OR {fell})"}.items():
        _series(f"core.signal.{name}", f"CASE WHEN n > 1 THEN {sql} END", "bool", second=True)
    _series("core.signal.zscore_revert", f"CASE WHEN n > 1 THEN abs({lag()}) >= 60 AND abs(x) < abs({lag()}) AND (x * {lag()} > 0 OR x = 0 OR {lag()} = 0) END", "bool", threshold=60.0)
    n, w = 6, _frame(6)
    full = f"count(x) OVER {w} >= {n}"
    _series("core.indicator.linear_regression_slope", f"CASE WHEN {full} THEN regr_slope(x, n) OVER {w} END", window=n)
    _series("core.indicator.beta", f"CASE WHEN {full} THEN regr_slope(x, y) OVER {w} END", second=True, window=n)
    for token in ("core.indicator.residual", "core.factor.beta_neutral_signal"):
        _series(token, f"CASE WHEN {full} THEN x - (regr_intercept(x, y) OVER {w} + regr_slope(x, y) OVER {w} * y) END", second=True, window=n)
    mean, sd = "avg(x) OVER (PARTITION BY user_id)", "stddev_pop(x) OVER (PARTITION BY user_id)"
    _add("op_score_zscore", lambda s, d: series.score_zscore(events(s, d), ["user_id"], "x").select("event_id", _r(F.col("value")).alias("value")), f"WITH {EV} SELECT event_id, {_rs(f'CASE WHEN {sd} = 0 THEN 0 ELSE (x - {mean}) / {sd} END')} AS value FROM ev")

    def sparse(rows):
        return rows.withColumn("z", F.when(F.col("event_id") % 3 == 0, F.col("x")))

    _add("op_align_forward_fill", lambda s, d: sparse(events(s, d)).select("event_id", _r(series.forward_fill(ordered(), F.col("z"))).alias("value")),
         f"WITH {EV} SELECT event_id, {_rs(f'last_value(CASE WHEN event_id % 3 = 0 THEN x END IGNORE NULLS) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS value FROM ev")
    _add("op_align_drop_missing", lambda s, d: series.drop_missing(sparse(events(s, d)), "z").select("event_id", _r(F.col("z")).alias("value")), f"WITH {EV} SELECT event_id, {_rs('x')} AS value FROM ev WHERE event_id % 3 = 0")
    for kind in ("inner", "left"):
        def joined(s, d, kind=kind):
            rows = events(s, d)
            join = series.inner_join if kind == "inner" else series.left_join
            return join(rows.select("user_id", "ts", "event_id", "x"), rows.where("event_id % 2 = 0").select("user_id", "ts", "y"), ["user_id", "ts"]).select("event_id", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))

        _add(f"op_align_{kind}_join", joined, f"WITH {EV} SELECT a.event_id, {_rs('a.x')} AS x, {_rs('b.y')} AS y FROM ev a {kind.upper()} JOIN (SELECT * FROM ev WHERE event_id % 2 = 0) b ON a.user_id = b.user_id AND a.ts = b.ts")
    _add("op_time_session_filter", lambda s, d: series.session_filter(events(s, d), "ts", "09:00", "16:30").select("event_id", _r(F.col("x")).alias("value")), f"WITH {EV} SELECT event_id, {_rs('x')} AS value FROM ev WHERE strftime(ts, '%H:%M') BETWEEN '09:00' AND '16:30'")
    change = f"c AS (SELECT *, x / lag(x) OVER ({ORDER}) - 1 AS c FROM ev)"
    _add("op_indicator_volatility", lambda s, d: series.kept(series.volatility(events(s, d), ordered(), "x", 5), "value").select("event_id", _r(F.col("value")).alias("value")),
         f"WITH {EV}, {change}, f AS (SELECT event_id, CASE WHEN count(c) OVER {_frame(5)} >= 5 AND c IS NOT NULL THEN stddev_pop(c) OVER {_frame(5)} END AS v FROM c) SELECT event_id, {_rs('v')} AS value FROM f WHERE v IS NOT NULL")


# Folds: the oracle is a recursive query over a user's numbered rows.

BARS = "bars AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events WHERE value > 0 GROUP BY 1, 2)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, at = events(spark, sf_dir), F.struct("ts", "event_id")
    return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("x", at).alias("open"), F.max("x").alias("high"), F.min("x").alias("low"), F.max_by("x", at).alias("close"))


def _recursive(alpha: str, source: str = "x") -> str:
    return f"s AS (SELECT *, row_number() OVER ({ORDER}) AS n FROM ev), r AS (SELECT user_id, event_id, n, {source} AS v FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.event_id, s.n, {alpha} * s.{source} + (1 - {alpha}) * r.v FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)"


def _all_folds() -> None:
    keys, order = ["user_id"], ["ts", "event_id"]
    for token, params, alpha in (("core.smooth.linear_recursive", {"alpha": 0.3}, "0.3"), ("core.indicator.ema", {"window": 9}, "0.2")):
        _add("op_" + token[5:].replace(".", "_"), lambda s, d, t=token, p=params: folds.fold(events(s, d), t, keys, order, "x", **p).select("event_id", _r(F.col("value")).alias("value")), f"WITH RECURSIVE {EV}, {_recursive(alpha)} SELECT event_id, {_rs('v')} AS value FROM r")
    step = lambda new, n: f"(r.{new} * {n - 1} + d.{new}) / {n}"
    rsi = f"""WITH RECURSIVE {EV}, s AS (SELECT *, row_number() OVER ({ORDER}) AS n, x - lag(x) OVER ({ORDER}) AS c FROM ev),
d AS (SELECT user_id, event_id, n, greatest(c, 0) AS g, greatest(-c, 0) AS l FROM s WHERE n > 1),
r AS (SELECT d.user_id, max(d.n) AS n, sum(d.g) / 5 AS g, sum(d.l) / 5 AS l FROM d WHERE d.n <= 6 GROUP BY d.user_id HAVING count(*) = 5
UNION ALL SELECT d.user_id, d.n, {step('g', 5)}, {step('l', 5)} FROM r JOIN d ON d.user_id = r.user_id AND d.n = r.n + 1)
SELECT d.event_id, {_rs('CASE WHEN r.g = 0 AND r.l = 0 THEN 50 WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / r.l) END')} AS value FROM r JOIN d USING (user_id, n)"""
    _add("op_indicator_rsi", lambda s, d: series.kept(folds.fold(events(s, d), "core.indicator.rsi", keys, order, "x", window=5), "value").select("event_id", _r(F.col("value")).alias("value")), rsi)
    macd = f"""WITH RECURSIVE {EV}, s AS (SELECT *, row_number() OVER ({ORDER}) AS n FROM ev),
r AS (SELECT user_id, event_id, n, x AS f, x AS w, CAST(0 AS DOUBLE) AS g FROM s WHERE n = 1
UNION ALL SELECT s.user_id, s.event_id, s.n, s.x / 2 + r.f / 2, s.x * 2 / 7 + r.w * 5 / 7, ((s.x / 2 + r.f / 2) - (s.x * 2 / 7 + r.w * 5 / 7)) * 0.4 + r.g * 0.6 FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT event_id, {_rs('f - w')} AS macd, {_rs('g')} AS signal, {_rs('f - w - g')} AS histogram FROM r"""
    _add("op_indicator_macd", lambda s, d: folds.fold(events(s, d), "core.indicator.macd", keys, order, "x", fast=3, slow=6, signal=4).select("event_id", *[_r(F.col(c)).alias(c) for c in ("macd", "signal", "histogram")]), macd)
    atr = f"""WITH RECURSIVE {BARS}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n, lag(close) OVER (PARTITION BY user_id ORDER BY day) AS p FROM bars),
t AS (SELECT user_id, day, n, CASE WHEN p IS NULL THEN high - low ELSE greatest(high - low, abs(high - p), abs(low - p)) END AS t FROM s),
r AS (SELECT user_id, CAST(3 AS BIGINT) AS n, sum(t) / 3 AS v FROM t WHERE n <= 3 GROUP BY user_id HAVING count(*) = 3
UNION ALL SELECT t.user_id, t.n, (r.v * 2 + t.t) / 3 FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
SELECT user_id, CAST(t.day AS VARCHAR) AS day, {_rs('r.v')} AS value FROM r JOIN t USING (user_id, n)"""
    _add("op_indicator_atr", lambda s, d: series.kept(folds.atr_frame(bars(s, d), ["user_id"], ["day"], 3), "value").select("user_id", F.col("day").cast("string").alias("day"), _r(F.col("value")).alias("value")), atr)
    by_day = lambda: series.ordered(["user_id"], ["day"])
    past = "(PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"

    def donchian(s, d):
        bands = series.channel(by_day(), F.col("high"), F.col("low"), 3)
        return series.kept(bars(s, d).select("user_id", F.col("day").cast("string").alias("day"), *[_r(v).alias(k) for k, v in bands.items()]), "upper")

    high, low = f"CASE WHEN count(*) OVER {past} >= 3 THEN max(high) OVER {past} END", f"CASE WHEN count(*) OVER {past} >= 3 THEN min(low) OVER {past} END"
    _add("op_indicator_donchian_channel", donchian, f"WITH {BARS}, f AS (SELECT user_id, day, {high} AS upper, {low} AS lower FROM bars) SELECT user_id, CAST(day AS VARCHAR) AS day, {_rs('upper')} AS upper, {_rs('lower')} AS lower FROM f WHERE upper IS NOT NULL")

    def breakout(s, d):
        found = series.channel_breakout(by_day(), F.col("high"), F.col("low"), F.col("close"), 3)
        return series.kept(bars(s, d).select("user_id", F.col("day").cast("string").alias("day"), found.alias("value")), "value")

    _add("op_indicator_channel_breakout", breakout, f"WITH {BARS}, f AS (SELECT user_id, day, close > {high} OR close < {low} AS value FROM bars) SELECT user_id, CAST(day AS VARCHAR) AS day, value FROM f WHERE value IS NOT NULL")
    table = {"states": ["ready", "cooldown", "frozen"], "events": ["purchase", "view", "click", "error"], "initial_state": "ready", "transitions": [{"from": a, "event": e, "to": b} for a, e, b in _MOVES]}

    def machine(s, d):
        rows = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", "event_type")
        return folds.fold(rows, "core.state.fsm", keys, order, "event_type", **table).select("event_id", F.col("value").alias("state"), F.col("diagnostic").isNull().alias("known"))

    moves = ", ".join(f"('{a}', '{e}', '{b}')" for a, e, b in _MOVES)
    _add("op_state_fsm", machine, f"""WITH RECURSIVE m(f, e, t) AS (VALUES {moves}), s AS (SELECT event_id, user_id, event_type, row_number() OVER ({ORDER}) AS n FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'ready' AS state, false AS known FROM (SELECT DISTINCT user_id FROM s)
UNION ALL SELECT s.user_id, s.n, coalesce(m.t, r.state), m.t IS NOT NULL FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1 LEFT JOIN m ON m.f = r.state AND m.e = s.event_type)
SELECT s.event_id, r.state, r.known FROM r JOIN s USING (user_id, n)""")


_MOVES = [("ready", "purchase", "cooldown"), ("cooldown", "view", "ready"), ("ready", "click", "frozen"), ("cooldown", "click", "frozen"), ("frozen", "error", "ready")]


# Decisions, gates, risk and state over events: kind and reasons as text.


def _decided(token: str, build, kind: str, reason: str) -> None:
    """kind, reason: SQL over the numbered events s."""

    def run(spark, sf_dir):
        rows = events(spark, sf_dir)
        return rows.withColumn("e", F.when(F.col("event_id") % 5 == 0, "fill").when(F.col("event_id") % 5 == 1, "cooldown_expired").otherwise("signal")).select("event_id", build().alias("d")).select("event_id", F.col("d.kind").alias("kind"), F.array_join("d.reasons", ",").alias("reasons"))

    _add("op_" + token[5:].replace(".", "_"), run, f"WITH {EV}, s AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'fill' WHEN 1 THEN 'cooldown_expired' ELSE 'signal' END AS e, row_number() OVER ({ORDER}) AS n FROM ev), f AS (SELECT event_id, {kind} AS kind, {reason} AS reasons FROM s) SELECT * FROM f")


def _block(token: str, build, bad: str, reason: str) -> None:
    _decided(token, build, f"CASE WHEN {bad} THEN 'block' ELSE 'accept' END", f"CASE WHEN {bad} THEN '{reason}' ELSE '' END")


def _all_decisions() -> None:
    run = f"({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    _decided("core.decision.lift_bool", lambda: ROW["core.decision.lift_bool"](A()), "CASE WHEN x > 50 THEN 'accept' ELSE 'reject' END", "CASE WHEN x > 50 THEN 'DECISION_TRUE' ELSE 'DECISION_FALSE' END")
    _decided("core.decision.long_flat", lambda: ROW["core.decision.long_flat"](A()), "CASE WHEN x > 50 THEN 'accept' ELSE 'reject' END", "CASE WHEN x > 50 THEN 'DECISION_LONG' ELSE 'DECISION_FLAT' END")
    _decided("core.decision.signal_to_decision", lambda: ROW["core.decision.signal_to_decision"](x(), 40.0), "CASE WHEN x >= 40 THEN 'accept' ELSE 'reject' END", "CASE WHEN x >= 40 THEN 'DECISION_SIGNAL_PASS' ELSE 'DECISION_SIGNAL_FAIL' END")
    both = "x > 50 AND y > 48"
    _decided("core.decision.long_short", lambda: ROW["core.decision.long_short"](A(), B()), f"CASE WHEN {both} THEN 'block' WHEN x > 50 OR y > 48 THEN 'accept' ELSE 'reject' END", f"CASE WHEN {both} THEN 'DECISION_CONFLICT' WHEN x > 50 THEN 'DECISION_LONG' WHEN y > 48 THEN 'DECISION_SHORT' ELSE 'DECISION_FLAT' END")
    held = f"coalesce(last_value(CASE WHEN x > 50 AND NOT y > 48 THEN true WHEN y > 48 AND NOT x > 50 THEN false END IGNORE NULLS) OVER {run}, false)"
    _decided("core.decision.entry_exit_to_position", lambda: ORDERED["core.decision.entry_exit_to_position"](ordered(), A(), B()), f"CASE WHEN {both} THEN 'block' WHEN {held} THEN 'accept' ELSE 'reject' END", f"CASE WHEN {both} THEN 'DECISION_CONFLICT' WHEN {held} THEN 'DECISION_LONG' ELSE 'DECISION_FLAT' END")
    first = lambda: ROW["core.decision.lift_bool"](A())
    _decided("core.decision.gate_decision", lambda: ROW["core.decision.gate_decision"](first(), ROW["core.gate.min_hold"](y(), 10)), "CASE WHEN y < 10 THEN 'block' WHEN x > 50 THEN 'accept' ELSE 'reject' END", "CASE WHEN x > 50 THEN 'DECISION_TRUE' ELSE 'DECISION_FALSE' END || CASE WHEN y < 10 THEN ',GATE_BLOCKED_MIN_HOLD' ELSE '' END")
    for token, name in (("core.risk.position_cap", "position_cap"), ("core.risk.exposure_cap_record", "exposure")):
        _decided(token, lambda t=token: ROW[t](first(), y(), 80), "CASE WHEN abs(y) > 80 THEN 'block' WHEN x > 50 THEN 'accept' ELSE 'reject' END", "CASE WHEN x > 50 THEN 'DECISION_TRUE' ELSE 'DECISION_FALSE' END || CASE WHEN abs(y) > 80 THEN ',RISK_POSITION_CAP' ELSE '' END")
    _block("core.gate.volatility_regime", lambda: ROW["core.gate.volatility_regime"](x(), 70), "x > 70", "GATE_BLOCKED_VOLATILITY")
    _block("core.gate.drawdown", lambda: ROW["core.gate.drawdown"](x(), 70), "abs(x) >= 70", "GATE_BLOCKED_DRAWDOWN")
    _block("core.gate.time_window", lambda: ROW["core.gate.time_window"](F.col("ts"), "22:00", "06:00"), "NOT (strftime(ts, '%H:%M') >= '22:00' OR strftime(ts, '%H:%M') <= '06:00')", "GATE_BLOCKED_TIME_WINDOW")
    _block("core.gate.rebalance", lambda: ROW["core.gate.rebalance"](x() - y(), 5), "abs(x - y) < 5", "GATE_BLOCKED_REBALANCE")
    _block("core.gate.min_hold", lambda: ROW["core.gate.min_hold"](y(), 30), "y < 30", "GATE_BLOCKED_MIN_HOLD")
    _block("core.gate.max_hold", lambda: ROW["core.gate.max_hold"](y(), 30), "y < 30", "GATE_BLOCKED_MAX_HOLD_WAIT")
    state = lambda on, off: f"e = 'signal' AND coalesce(last_value(CASE e WHEN '{on}' THEN true WHEN '{off}' THEN false END IGNORE NULLS) OVER {run}, false)"
    _block("core.gate.cooldown", lambda: ORDERED["core.gate.cooldown"](ordered(), F.col("e")), state("fill", "cooldown_expired"), "GATE_BLOCKED_COOLDOWN")
    frozen = lambda: F.replace(F.replace(F.col("e"), F.lit("fill"), F.lit("freeze_on")), F.lit("cooldown_expired"), F.lit("freeze_off"))
    _block("core.gate.market_freeze", lambda: ORDERED["core.gate.market_freeze"](ordered(), frozen()), state("fill", "cooldown_expired"), "GATE_BLOCKED_MARKET_FREEZE")
    ones, total = (lambda: (F.col("y") > 90).cast("int")), f"sum(CAST(y > 90 AS INT)) OVER {run}"
    for name, op, default, reason in (("circuit_breaker", ">=", 2, "CIRCUIT_BREAKER"), ("observe_period", "<", 3, "OBSERVE_PERIOD"), ("slot_budget", ">", 2, "SLOT_BUDGET")):
        _block(f"core.gate.{name}", lambda n=name: ORDERED[f"core.gate.{n}"](ordered(), ones()), f"{total} {op} {default}", f"GATE_BLOCKED_{reason}")
    _block("core.risk.stop_loss_record", lambda: ROW["core.risk.stop_loss_record"](x(), y(), 0.25), "y <= x * (1 - 0.25)", "RISK_STOP_LOSS")
    _decided("core.risk.take_profit_record", lambda: ROW["core.risk.take_profit_record"](x(), y(), 0.25), "CASE WHEN y >= x * (1 + 0.25) THEN 'accept' ELSE 'reject' END", "CASE WHEN y >= x * (1 + 0.25) THEN 'RISK_TAKE_PROFIT' ELSE 'RISK_HOLD' END")
    top = f"max(x) OVER {run}"
    _block("core.risk.trailing_stop_record", lambda: ORDERED["core.risk.trailing_stop_record"](ordered(), x(), 0.25), f"x <= {top} * (1 - 0.25) AND x < {top}", "RISK_TRAILING_STOP")
    _block("core.risk.max_drawdown_record", lambda: ORDERED["core.risk.max_drawdown_record"](ordered(), x(), 0.4), f"({top} - x) / {top} >= 0.4", "RISK_MAX_DRAWDOWN")
    for reducer, sql in {"sum": f"10 + sum(x) OVER {run}", "max": f"greatest(max(x) OVER {run}, 10)", "min": f"least(min(x) OVER {run}, 10)", "count": f"10 + count(x) OVER {run}", "last": f"last_value(x) OVER {run}"}.items():
        name = "op_state_accumulate" + ("" if reducer == "sum" else f"_{reducer}")
        _add(name, lambda s, d, r=reducer: events(s, d).select("event_id", _r(ORDERED["core.state.accumulate"](ordered(), x(), r, 10.0)).alias("value")), f"WITH {EV} SELECT event_id, {_rs(sql)} AS value FROM ev")
    _add("op_state_delay", lambda s, d: events(s, d).select("event_id", _r(ORDERED["core.state.delay"](ordered(), x(), 2, 0.0, "emit_initial")).alias("value")), f"WITH {EV} SELECT event_id, {_rs(f'coalesce(lag(x, 2) OVER ({ORDER}), 0)')} AS value FROM ev")
    was = f"lag(x > 50) OVER ({ORDER})"
    for mode, sql in {"rising": f"NOT {was} AND x > 50", "falling": f"{was} AND NOT x > 50", "change": f"{was} <> (x > 50)"}.items():
        _add("op_state_edge_detect" + ("" if mode == "rising" else f"_{mode}"), lambda s, d, m=mode: events(s, d).select("event_id", ORDERED["core.state.edge_detect"](ordered(), A(), m).alias("value")), f"WITH {EV} SELECT event_id, coalesce({sql}, false) AS value FROM ev")
    kinds = "CASE WHEN event_id % 11 = 0 THEN 'block' WHEN event_id % 7 = 0 THEN 'unknown' WHEN value > 50 THEN 'accept' ELSE 'reject' END"
    base = f"d AS (SELECT user_id, CAST(ts AS DATE) AS day, {kinds} AS kind, upper(event_type) AS reason, value FROM events)"
    keys = ["user_id", "day"]

    def given(s, d):
        rows = s.read.parquet(f"{d}/events.parquet").selectExpr("user_id", "to_date(ts) AS day", f"{kinds} AS kind", "array(upper(event_type)) AS reasons", "value", "ts", "event_id")
        return rows

    def folded(name, sql, reasons, **params):
        def go(s, d):
            out = FOLDED[f"core.decision.{name}"](given(s, d), keys, **params)
            return out.select("user_id", F.col("day").cast("string").alias("day"), "kind", *([F.array_join("reasons", ",").alias("reasons")] if reasons else []))

        _add(f"op_decision_{name}", go, f"WITH {base}, g AS (SELECT user_id, day, max(CASE kind {{}} END) AS p, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, count(*) FILTER (kind = 'accept') AS a, count(*) FILTER (kind = 'reject') AS r, count(*) FILTER (kind = 'block') AS b, sum(CASE kind WHEN 'accept' THEN value WHEN 'reject' THEN -value ELSE 0 END) AS v FROM d GROUP BY 1, 2) SELECT user_id, CAST(day AS VARCHAR) AS day, {sql} AS kind{', reasons' if reasons is True else f', {reasons} AS reasons' if reasons else ''} FROM g".replace("{}", " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(["accept", "unknown", "reject", "block"] if name != "any_accept" else ["reject", "unknown", "accept", "block"]))))

    folded("unknown_propagating_and", "['accept','unknown','reject','block'][p + 1]", True)
    folded("any_accept", "['reject','unknown','accept','block'][p + 1]", True)
    for name, to in (("strict_and", "reject"), ("permissive_and", "accept")):
        extra = f"DECISION_UNKNOWN_AS_{to.upper()}"
        folded(name, f"CASE p WHEN 0 THEN 'accept' WHEN 1 THEN '{to}' WHEN 2 THEN 'reject' ELSE 'block' END", f"CASE WHEN p = 1 THEN array_to_string(list_sort(list_append(string_split(reasons, ','), '{extra}')), ',') ELSE reasons END")
    folded("majority", "CASE WHEN b > 0 THEN 'block' WHEN a > r THEN 'accept' WHEN r > a THEN 'reject' ELSE 'unknown' END", "reasons")
    folded("quorum", "CASE WHEN b > 0 THEN 'block' WHEN a >= 2 THEN 'accept' WHEN a + r >= 2 THEN 'reject' ELSE 'unknown' END", "reasons", accept_quorum=2, min_known=2)
    folded("weighted_vote", "CASE WHEN b > 0 THEN 'block' WHEN v > 0 THEN 'accept' WHEN v < 0 THEN 'reject' ELSE 'unknown' END", "reasons", weight="value", order=["ts", "event_id"])


# Panels.

PN = "pn AS (SELECT strftime(o_orderdate, '%Y-%m') AS ts, n_name AS symbol, round(CAST(sum(o_totalprice) AS DOUBLE), 2) AS value, n_name <> 'FRANCE' AS u, n_regionkey AS grp FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 4, 5)"
FACTOR = "fa AS (SELECT ts, avg(value) AS factor FROM pn GROUP BY ts)"


def panel_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rows = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ts"), F.col("n_name").alias("symbol")).agg(F.round(F.sum("o_totalprice").cast("double"), 2).alias("value"))
    return sums.withColumn("in_universe", F.col("symbol") != "FRANCE")


def nation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("symbol"), F.col("n_regionkey").cast("string").alias("grp"))


def _factor(panel_rows: DataFrame) -> DataFrame:
    return panel_rows.groupBy("ts").agg(F.avg("value").alias("factor"))


def _panel(name: str, build, sql: str, kind: str = "double", column: str = "value") -> None:
    def run(spark, sf_dir):
        return build(spark, sf_dir).select("ts", "symbol", _typed(F.col(column), kind).alias(column))

    _add(name, run, f"WITH {PN}, {sql} SELECT ts, symbol, {_typed_sql(column, kind)} AS {column} FROM f")


def _all_panels() -> None:
    p = panel_nation
    ranked = "f AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY value DESC, symbol) AS value FROM pn WHERE u)"
    for name in ("panel_rank", "panel_cross_sectional_rank"):
        _panel(f"op_{name}", lambda s, d: panel.rank(p(s, d)), ranked)
    z = "f AS (SELECT ts, symbol, CASE WHEN stddev_pop(value) OVER (PARTITION BY ts) = 0 THEN 0 ELSE (value - avg(value) OVER (PARTITION BY ts)) / stddev_pop(value) OVER (PARTITION BY ts) END AS value FROM pn WHERE u)"
    for name in ("panel_zscore", "panel_zscore_by_universe"):
        _panel(f"op_{name}", lambda s, d: panel.zscore(p(s, d)), z)
    _panel("op_panel_demean", lambda s, d: panel.demean(p(s, d)), "f AS (SELECT ts, symbol, value - avg(value) OVER (PARTITION BY ts) AS value FROM pn WHERE u)")
    grouped = "f AS (SELECT ts, symbol, value - avg(value) OVER (PARTITION BY ts, grp) AS value FROM pn WHERE u)"
    for name in ("panel_group_demean", "panel_neutralize_group"):
        _panel(f"op_{name}", lambda s, d: panel.group_demean(p(s, d), nation_groups(s, d)), grouped)
    _panel("op_factor_sector_neutral_rank", lambda s, d: panel.sector_neutral_rank(p(s, d), nation_groups(s, d)), grouped.replace("f AS", "g AS") + ", f AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY value DESC, symbol) AS value FROM g)")
    for name, order, sign in (("top_k", "DESC", panel.top_k), ("bottom_k", "ASC", panel.bottom_k)):
        sql = f"f AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY value {order}, symbol) <= 5 AS selected FROM pn WHERE u)"
        for prefix in ("panel", "selection", "signal_rank"):
            _panel(f"op_{prefix}_{name}", lambda s, d, f=sign: f(p(s, d), 5), sql, "bool", "selected")
    _panel("op_decision_rank_to_selection", lambda s, d: panel.rank_to_selection(p(s, d), 4, "bottom"), "f AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY value, symbol) <= 4 AS selected FROM pn WHERE u)", "bool", "selected")
    _panel("op_panel_mask", lambda s, d: panel.mask(p(s, d), nation_groups(s, d).where("grp = '3'").select("symbol")), "f AS (SELECT ts, symbol, u AND grp = 3 AS in_universe FROM pn)", "bool", "in_universe")
    cut = "k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY value, symbol) AS k, count(*) OVER (PARTITION BY ts) AS n FROM pn WHERE u), b AS (SELECT *, max(value) FILTER (k = least(greatest(ceil(CAST(0.1 AS DOUBLE) * n), 1), n)) OVER (PARTITION BY ts) AS lo, max(value) FILTER (k = least(greatest(ceil(CAST(0.9 AS DOUBLE) * n), 1), n)) OVER (PARTITION BY ts) AS hi FROM k), f AS (SELECT ts, symbol, least(greatest(value, lo), hi) AS value FROM b)"
    _panel("op_panel_winsorize", lambda s, d: panel.winsorize(p(s, d), 0.1, 0.9), cut)
    rest = f"{FACTOR}, f AS (SELECT pn.ts, symbol, value - (regr_intercept(value, factor) OVER (PARTITION BY symbol) + regr_slope(value, factor) OVER (PARTITION BY symbol) * factor) AS v FROM pn JOIN fa USING (ts) WHERE u)".replace(" AS v FROM", " AS value FROM")
    for name in ("panel_residualize", "factor_residualize"):
        def residuals(s, d):
            rows = p(s, d)
            return panel.residualize(rows, _factor(rows)).withColumn("value", F.round("value", 3))

        _panel(f"op_{name}", residuals, rest.replace("f AS (SELECT pn.ts", "h AS (SELECT pn.ts") + ", f AS (SELECT ts, symbol, round(value, 3) AS value FROM h)")
    # Weights: from the value's share, with a sign, and from the rank.
    wt = "w AS (SELECT ts, symbol, grp, u AS in_universe, (CASE WHEN grp % 2 = 0 THEN 1 ELSE -1 END) * round(value / sum(value) OVER (PARTITION BY ts), 6) AS weight FROM pn)"

    def weight(s, d):
        rows = p(s, d).join(nation_groups(s, d), "symbol")
        return rows.withColumn("weight", F.when(F.col("grp").cast("int") % 2 == 0, 1.0).otherwise(-1.0) * F.round(F.col("value") / F.sum("value").over(W.partitionBy("ts")), 6)).select("ts", "symbol", "weight", "in_universe")

    def weighed(names, build, sql):
        for name in names:
            _panel(f"op_{name}", build, f"{wt}, {sql}", "double", "weight")

    act = lambda e: f"sum({e}) FILTER (in_universe) OVER (PARTITION BY ts)"
    weighed(["weight_normalize_gross"], lambda s, d: weights.normalize_gross(weight(s, d), 2.0), f"f AS (SELECT ts, symbol, CASE WHEN in_universe THEN weight * 2 / {act('abs(weight)')} ELSE weight END AS weight FROM w)")
    weighed(["weight_cap_per_symbol", "weight_max_weight_clip"], lambda s, d: weights.cap_per_symbol(weight(s, d), 0.05), "f AS (SELECT ts, symbol, CASE WHEN in_universe THEN least(greatest(weight, -0.05), 0.05) ELSE weight END AS weight FROM w)")
    neutral = f"c AS (SELECT ts, symbol, in_universe, CASE WHEN in_universe THEN weight - avg(weight) FILTER (in_universe) OVER (PARTITION BY ts) ELSE weight END AS weight FROM w), f AS (SELECT ts, symbol, CASE WHEN NOT in_universe THEN weight WHEN {act('abs(weight)')} = 0 THEN 0 ELSE weight / {act('abs(weight)')} END AS weight FROM c)"
    weighed(["weight_market_neutral", "weight_market_neutral_weight"], lambda s, d: weights.market_neutral(weight(s, d)), neutral)
    weighed(["weight_normalize_net"], lambda s, d: weights.normalize_net(weight(s, d), 0.5), f"f AS (SELECT ts, symbol, CASE WHEN in_universe THEN weight + (0.5 - {act('weight')}) / count(*) FILTER (in_universe) OVER (PARTITION BY ts) ELSE weight END AS weight FROM w)")
    weighed(["weight_group_neutral_weight"], lambda s, d: weights.group_neutral_weight(weight(s, d), nation_groups(s, d)), "f AS (SELECT ts, symbol, CASE WHEN in_universe THEN weight - avg(weight) FILTER (in_universe) OVER (PARTITION BY ts, grp) ELSE 0 END AS weight FROM w)")
    weighed(["weight_rank_weight"], lambda s, d: weights.rank_weight(panel.rank(p(s, d))), "r AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY value DESC, symbol) AS k, count(*) OVER (PARTITION BY ts) AS n FROM pn WHERE u), f AS (SELECT ts, symbol, (n - k + 1) / sum(n - k + 1) OVER (PARTITION BY ts) AS weight FROM r)")
    weighed(["weight_inverse_vol_weight"], lambda s, d: weights.inverse_vol_weight(p(s, d)), "f AS (SELECT ts, symbol, CASE WHEN u THEN (1 / value) / sum(1 / value) FILTER (u) OVER (PARTITION BY ts) ELSE 0 END AS weight FROM pn)")
    for names, side, how in ((["weight_equal_weight", "selection_to_weights", "decision_selection_to_weight"], panel.top_k, "equal_long"),):
        weighed(names, lambda s, d, f=side, h=how: weights.to_weights(f(p(s, d), 5), h), "k AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY value DESC, symbol) AS k FROM pn WHERE u), f AS (SELECT ts, symbol, 1.0 / count(*) OVER (PARTITION BY ts) AS weight FROM k WHERE k <= 5)")
    weighed(["weight_vol_target_weight", "risk_volatility_target", "risk_volatility_target_record"], lambda s, d: weights.volatility_target(weight(s, d), p(s, d), 100000.0), "f AS (SELECT w.ts, w.symbol, CASE WHEN in_universe THEN weight * 100000 / value ELSE weight END AS weight FROM w JOIN pn USING (ts, symbol))")

    def before(s, d):
        return weights.cap_per_symbol(weight(s, d), 0.03)

    weighed(["risk_turnover_cap", "risk_turnover_limit_record"], lambda s, d: weights.turnover_cap(weight(s, d), before(s, d), 0.01), "q AS (SELECT *, CASE WHEN in_universe THEN least(greatest(weight, -0.03), 0.03) ELSE weight END AS was FROM w), f AS (SELECT ts, symbol, CASE WHEN in_universe THEN was + least(greatest(weight - was, -0.01), 0.01) ELSE weight END AS weight FROM q)")
    # Cases: chains of operators.
    chain = "l AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY value DESC, symbol) AS a, row_number() OVER (PARTITION BY ts ORDER BY value, symbol) AS b FROM pn WHERE u), c AS (SELECT ts, symbol, CASE WHEN a <= 5 THEN 1.0 ELSE -1.0 END AS side FROM l WHERE a <= 5 OR b <= 5), d AS (SELECT ts, symbol, side / count(*) OVER (PARTITION BY ts, side) AS weight FROM c), m AS (SELECT ts, symbol, weight - avg(weight) OVER (PARTITION BY ts) AS weight FROM d), g AS (SELECT *, sum(abs(weight)) OVER (PARTITION BY ts) AS gross FROM m), f AS (SELECT ts, symbol, CASE WHEN gross = 0 THEN 0 ELSE weight / gross END AS weight FROM g)"
    _panel("case_top_bottom_market_neutral", flagship_panel, chain, "double", "weight")
    back = rest.replace("f AS (SELECT pn.ts", "h AS (SELECT pn.ts") + ", e AS (SELECT ts, symbol, round((value - avg(value) OVER (PARTITION BY ts)) / stddev_pop(value) OVER (PARTITION BY ts), 9) AS value FROM h), k AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY value, symbol) AS k FROM e), f AS (SELECT ts, symbol, 1.0 / count(*) OVER (PARTITION BY ts) AS weight FROM k WHERE k <= 3)"

    def reversion(s, d):
        rows = p(s, d)
        scores = panel.zscore(panel.residualize(rows, _factor(rows))).withColumn("value", F.round("value", 9))
        return weights.normalize_gross(weights.to_weights(panel.bottom_k(scores, 3)))

    _panel("case_residual_mean_reversion", reversion, back, "double", "weight")


def flagship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest nations of a month long and the five smallest of the others short, market neutral."""
    return weights.market_neutral(weights.to_weights(panel.top_bottom(panel_nation(spark, sf_dir), 5), "equal_long_short"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bollinger mean reversion: below the lower band is a decision to buy."""
    bands = SERIES["core.indicator.bollinger"](ordered(), F.col("x"), 20)
    rows = series.kept(events(spark, sf_dir).select("event_id", "user_id", "x", bands["lower"].alias("lower")), "lower")
    return rows.select("event_id", "user_id", ROW["core.decision.lift_bool"](F.col("x") < F.col("lower")).alias("d")).select("event_id", "user_id", F.col("d.kind").alias("kind"), F.array_join("d.reasons", ",").alias("reasons"))


def _build() -> None:
    if QUERIES:
        return
    _scalars()
    _all_series()
    _all_folds()
    _all_decisions()
    _all_panels()
    from . import cases

    for name, (build, sql) in cases.cases(sys.modules[__name__]).items():
        _add(name, build, sql)
    lower = f"avg(x) OVER {_frame(20)} - 2 * stddev_pop(x) OVER {_frame(20)}"
    _add("case_bollinger_mean_reversion", flagship, f"WITH {EV}, f AS (SELECT event_id, user_id, x, {_rolled(lower, 20)} AS lower FROM ev) SELECT event_id, user_id, CASE WHEN x < lower THEN 'accept' ELSE 'reject' END AS kind, CASE WHEN x < lower THEN 'DECISION_TRUE' ELSE 'DECISION_FALSE' END AS reasons FROM f WHERE lower IS NOT NULL")


def queries() -> dict:
    _build()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _build()
    return ORACLE
