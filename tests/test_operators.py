"""Operators on small inputs of our own, each with the value that its definition gives."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkstrat.operators import METADATA_ONLY, REGISTRY, folds, panel, series, weights
from sparkstrat.operators.decisions import FOLDED, ORDERED, ROW, accumulate, delay, edge_detect, epochs
from sparkstrat.operators.scalar import SCALAR
from sparkstrat.operators.series import SERIES


def series_of(spark, *values):
    return spark.createDataFrame([("k", i, None if v is None else float(v)) for i, v in enumerate(values)], "key string, ts long, x double")


def window():
    return series.ordered(["key"], ["ts"])


def run(spark, token, values, **params):
    found = SERIES[token](window(), F.col("x"), **params)
    return [r.v for r in series_of(spark, *values).select("ts", found.alias("v")).orderBy("ts").collect() if r.v is not None]


def test_vocabulary():
    assert len(REGISTRY) == 179 and len(METADATA_ONLY) == 13


def test_series(spark):
    assert run(spark, "core.data.shift", [3, 5, 9, 6]) == [3, 5, 9]
    assert run(spark, "core.data.diff", [3, 5, 9, 6]) == [2, 4, -3]
    assert run(spark, "core.data.pct_change", [4, 5, 10]) == [0.25, 1]
    assert run(spark, "core.window.sum", [3, 5, 9, 6], window=3) == [17, 20]
    assert run(spark, "core.window.std", [2, 4, 9], window=3) == [pytest.approx(math.sqrt(26 / 3))]  # 9 + 1 + 16 about the mean of 5
    # -1 * 7 + 0 * 1 + 1 * 4 over 1 + 0 + 1
    assert run(spark, "core.indicator.linear_regression_slope", [7, 1, 4, 8], window=3) == [-1.5, 3.5]
    with pytest.raises(ValueError, match="UNSAFE_FUTURE_SHIFT"):
        run(spark, "core.data.shift", [1, 2], periods=-1)


def naive_smooth(x, alpha):
    out = []
    for v in x:
        out.append(v if not out else alpha * v + (1 - alpha) * out[-1])
    return out


def naive_wilder(x, n):
    out = [None] * (n - 1) + [sum(x[:n]) / n]
    for v in x[n:]:
        out.append((out[-1] * (n - 1) + v) / n)
    return out[: len(x)] if len(x) >= n else [None] * len(x)


@pytest.mark.parametrize("cut", [1, 3, 7, 100])
def test_folds_do_not_depend_on_batches(cut):
    x = np.random.default_rng(3).normal(50, 9, 40).round(2)
    parts = [x[i : i + cut] for i in range(0, len(x), cut)]

    def fed(machine, name="value", given=parts):
        return np.concatenate([machine.feed(p)[name] for p in given])

    same = lambda a, b: np.testing.assert_allclose(np.array(a, float), np.array(b, float), rtol=1e-12)
    same(fed(folds.ema(6)), naive_smooth(x, 2 / 7))
    same(fed(folds.linear_recursive(0.3)), naive_smooth(x, 0.3))
    same(fed(folds.atr(5)), naive_wilder(list(x), 5))
    line = np.subtract(naive_smooth(x, 2 / 4), naive_smooth(x, 2 / 8))
    same(fed(folds.Macd(3, 7, 4), "macd"), line)
    same(fed(folds.Macd(3, 7, 4), "histogram"), line - np.array(naive_smooth(line, 2 / 5)))
    up, down = (naive_wilder([max(0, s * (b - a)) for a, b in zip(x, x[1:], strict=False)], 4) for s in (1, -1))
    same(fed(folds.Rsi(4)), [None, *[None if g is None else 100 - 100 / (1 + g / d) for g, d in zip(up, down, strict=True)]])
    assert list(fed(folds.Rsi(2), given=[np.array([5.0, 5, 5, 6, 9])])[2:]) == [50, 100, 100]


def test_folds_by_key(spark):
    rows = spark.createDataFrame([(k, i, None if (i + k) % 5 == 0 else float(i * k)) for k in (1, 2, 3) for i in range(50)], "key long, ts long, x double")
    out = folds.fold(rows, "core.indicator.ema", ["key"], ["ts"], "x", window=4).collect()
    for k in (1, 2, 3):
        given = [(i, float(i * k)) for i in range(50) if (i + k) % 5]
        wanted = naive_smooth([v for _, v in given], 0.4)
        assert [(r.ts, r.value) for r in sorted((r for r in out if r.key == k), key=lambda r: r.ts)] == [(i, pytest.approx(v)) for (i, _), v in zip(given, wanted, strict=True)]
    with pytest.raises(ValueError, match="MACD_WINDOWS_INVALID"):
        folds.fold(rows, "core.indicator.macd", ["key"], ["ts"], "x", fast=5, slow=5)


DOOR = {"states": ["shut", "open"], "events": ["push", "pull"], "initial_state": "shut", "transitions": [{"from": "shut", "event": "push", "to": "open"}, {"from": "open", "event": "pull", "to": "shut"}]}


def test_fsm(spark):
    events = spark.createDataFrame([("k", i, e) for i, e in enumerate(["push", "push", "kick", "pull"])], "key string, ts long, e string")
    go = lambda **p: [(r.value, r.diagnostic) for r in folds.fold(events, "core.state.fsm", ["key"], ["ts"], "e", **DOOR, **p).orderBy("ts").collect()]
    assert go() == [("open", None), ("open", "FSM_TRANSITION_MISSING"), ("open", "FSM_UNKNOWN_EVENT"), ("shut", None)]
    assert [s for s, _ in go(failure_policy="transition_to_unknown")] == ["open", "unknown", "unknown", "unknown"]
    traced = folds.fold(events, "core.state.fsm", ["key"], ["ts"], "e", **DOOR)
    assert folds.replay(events, traced, ["key"], ["ts"], "e", **DOOR).count() == 0
    wrong = traced.withColumn("value", F.when(F.col("ts") == 3, "open").otherwise(F.col("value")))
    assert [r.differ for r in folds.replay(events, wrong, ["key"], ["ts"], "e", **DOOR).collect()] == [1]
    with pytest.raises(PySparkException, match="FSM_TRANSITION_MISSING"):
        folds.check(traced).collect()
    with pytest.raises(ValueError, match="FSM_DEFINITION_INVALID"):
        folds.Fsm(**{**DOOR, "initial_state": "ajar"})


def panel_of(spark, rows):
    return spark.createDataFrame([("t1", s, None if v is None else float(v), v is not None) for s, v in rows], "ts string, symbol string, value double, in_universe boolean")


def test_panel(spark):
    rows = panel_of(spark, [("P", 11), ("Q", 3), ("R", 8), ("S", 3), ("out", None)])
    assert {r.symbol: r.value for r in panel.rank(rows).collect()} == {"P": 1, "R": 2, "Q": 3, "S": 4}
    # Nearest ranks 1 and 3 of 3, 3, 8, 11.
    assert [r.value for r in panel.winsorize(rows, 0.25, 0.75).orderBy("symbol").collect()] == [8, 3, 8, 3]
    assert {r.symbol for r in panel.top_k(rows, 1).where("selected").collect()} == {"P"}
    # Of 3 and 7 both are one deviation (2) from the mean of 5.
    assert [r.value for r in panel.zscore(panel_of(spark, [("P", 7), ("Q", 3)])).orderBy("symbol").collect()] == [1, -1]
    assert {r.symbol: r.side for r in panel.top_bottom(rows, 1).where("selected").collect()} == {"P": "long", "Q": "short"}
    assert {r.symbol: r.side for r in panel.top_bottom(rows, 3).where("selected").collect()} == {"P": "long", "R": "long", "Q": "long", "S": "short"}


def test_weights(spark):
    rows = spark.createDataFrame([("t1", "P", 0.7, True), ("t1", "Q", 0.1, True), ("t1", "R", 0.1, True), ("t2", "P", 0.5, True)], "ts string, symbol string, weight double, in_universe boolean")
    # Less the mean of 0.3: 0.4, -0.2, -0.2; gross 0.8.
    neutral = [r.weight for r in weights.market_neutral(rows.where("ts = 't1'")).orderBy("symbol").collect()]
    assert neutral == pytest.approx([0.5, -0.25, -0.25], abs=1e-12)
    assert [r.weight for r in weights.cap_per_symbol(rows, 0.4).orderBy("ts", "symbol").collect()] == [0.4, 0.1, 0.1, 0.4]
    with pytest.raises(PySparkException, match="WEIGHT_EMPTY_UNIVERSE"):
        weights.market_neutral(rows.withColumn("in_universe", F.col("ts") == "t1")).collect()


def test_gates(spark):
    events = spark.createDataFrame([("k", i, e) for i, e in enumerate(["fill", "signal", "signal", "cooldown_expired", "signal", "fill"])], "key string, ts long, e string")
    kinds = events.select("ts", ORDERED["core.gate.cooldown"](window(), F.col("e")).alias("d")).orderBy("ts").select("d.kind").collect()
    assert [r.kind for r in kinds] == ["accept", "block", "block", "accept", "accept", "accept"]
    # The top is 50 from the second row on; 44 is 12 % below it, 46 is 8 %.
    stops = series_of(spark, 40, 50, 46, 44).select("ts", ORDERED["core.risk.trailing_stop_record"](window(), F.col("x"), 0.1).alias("d"))
    assert [r.d.kind for r in stops.orderBy("ts").collect()] == ["accept", "accept", "accept", "block"]
    assert series_of(spark, 5).select(ROW["core.gate.min_hold"](F.col("x"), 6).alias("d")).first().d.kind == "block"


def naive_state(values, resets, kind, missing, initial, steps=2, reducer=None):
    """The rules of state operators, a row at a time."""
    out, buffer, state = [], [], initial
    fold = {"sum": lambda s, v: v if s is None else s + v, "count": lambda s, v: (s or 0) + 1, "max": lambda s, v: v if s is None else max(s, v), "min": lambda s, v: v if s is None else min(s, v), "last": lambda s, v: v}
    for v, reset in zip(values, resets, strict=True):
        if reset:
            buffer, state = [], initial
        ready = buffer[-steps] if len(buffer) >= steps else initial
        if v is not None:
            buffer.append(v)
            state = fold[reducer](state, v) if reducer else None
        found = ready if kind == "delay" else state
        out.append(None if v is None and missing == "emit_null" else found)
    return out


@pytest.mark.parametrize("missing", ["skip", "emit_null"])
def test_state_policies(spark, missing):
    values = [None, 4.0, 1.0, None, 7.0, 7.0, None, 2.0, 9.0, 3.0]
    resets = [i in (5, 8) for i in range(len(values))]
    rows = spark.createDataFrame([("k", i, v, r) for i, (v, r) in enumerate(zip(values, resets, strict=True))], "key string, ts long, x double, reset boolean")
    rows, w = epochs(rows, window(), "reset"), series.ordered(["key", "epoch"], ["ts"])
    got = lambda c: [r.v for r in rows.select("ts", c.alias("v")).orderBy("ts").collect()]
    assert got(delay(w, F.col("x"), 2, -1.0, "emit_initial", missing)) == naive_state(values, resets, "delay", missing, -1.0)
    assert got(delay(w, F.col("x"), 1, None, "emit_null", missing)) == naive_state(values, resets, "delay", missing, None, 1)
    for reducer in ("sum", "count", "max", "min", "last"):
        for initial in (None, 5):
            assert got(accumulate(w, F.col("x"), reducer, initial, missing)) == naive_state(values, resets, "fold", missing, initial, reducer=reducer), (reducer, initial)
    rest = False if missing == "skip" else None
    flags = [rest if v is None else v > 3 and any(u is not None for u in values[:i]) and next(u for u in values[:i][::-1] if u is not None) <= 3 for i, v in enumerate(values)]
    assert got(edge_detect(window(), F.col("x") > 3, "rising", missing)) == flags
    for build in (delay(w, F.col("x")), accumulate(w, F.col("x")), edge_detect(w, F.col("x") > 3)):
        with pytest.raises(PySparkException, match="STATE_MISSING_EVENT"):
            got(build)
    with pytest.raises(ValueError, match="STATE_REDUCER_UNKNOWN"):
        accumulate(w, F.col("x"), "median")


def test_numbers(spark):
    nan, big = float("nan"), float("inf")
    rows = spark.createDataFrame([(1.0, nan), (big, 2.0)], "a double, b double")
    for token in ("math.add", "math.sub", "math.mul", "math.div", "cmp.eq", "cmp.gt", "cmp.lte"):
        with pytest.raises(PySparkException, match="NUMERIC_NONFINITE"):
            rows.select(SCALAR[f"core.{token}"](F.col("a"), F.col("b"))).collect()
        assert [r[0] for r in rows.select(SCALAR[f"core.{token}"](F.col("a"), F.col("b"), policy="null")).collect()] == [None, None]
    for token in ("math.neg", "math.abs", "math.sign", "math.floor", "math.ceil", "math.round"):
        with pytest.raises(PySparkException, match="NUMERIC_NONFINITE"):
            rows.select(SCALAR[f"core.{token}"](F.col("b"))).collect()
    with pytest.raises(PySparkException, match="NUMERIC_NONFINITE"):
        rows.select(SCALAR["core.math.min"](F.array("a", "b"))).collect()
    for token, code in (("cmp.between", "CMP_RANGE_INVALID"), ("cmp.outside", "CMP_RANGE_INVALID"), ("signal.between", "SIGNAL_BAND_INVALID"), ("signal.outside_band", "SIGNAL_BAND_INVALID")):
        with pytest.raises(PySparkException, match=code):
            rows.limit(1).select(SCALAR[f"core.{token}"](F.col("a"), F.lit(3.0), F.lit(2.0))).collect()


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 6])
def test_round_is_exact(spark, digits):
    rng = np.random.default_rng(digits)
    x = [*np.round(rng.normal(0, 100, 3000), digits + 1), *rng.normal(0, 1e6, 500), 2.675, 0.125, -0.125, 1.005, 0.5, 1.5, -2.5, 1e17, 4503599627370497.5, 0.0, 5e-324]
    out = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").select("i", SCALAR["core.math.round"](F.col("x"), digits).alias("y")).orderBy("i").collect()
    assert [r.y for r in out] == [float(round(float(v), digits)) for v in x]


@pytest.mark.parametrize("name, kinds, wanted", [("strict_and", ["accept", "unknown"], "reject"), ("permissive_and", ["accept", "unknown"], "accept"), ("any_accept", ["reject", "unknown"], "unknown"), ("majority", ["accept", "reject", "accept"], "accept"), ("majority", ["accept", "block"], "block"), ("majority", ["accept", "reject"], "unknown")])
def test_decisions(spark, name, kinds, wanted):
    rows = spark.createDataFrame([("g", k, [f"R{i % 2}"]) for i, k in enumerate(kinds)], "g string, kind string, reasons array<string>")
    found = FOLDED[f"core.decision.{name}"](rows, ["g"]).first()
    assert found.kind == wanted and {"R0", "R1"} <= set(found.reasons) and found.reasons == sorted(found.reasons)


def test_votes(spark):
    rows = spark.createDataFrame([("g", "accept", ["b"], Decimal("0.5"), Decimal("0.4")), ("g", "reject", ["a"], Decimal("0.3"), Decimal("0.9")), ("g", "unknown", ["a"], None, None)], "g string, kind string, reasons array<string>, weight decimal(10,4), score decimal(10,4)")
    quorum, vote = FOLDED["core.decision.quorum"], FOLDED["core.decision.weighted_vote"]
    assert quorum(rows, ["g"], 2).first().kind == "unknown" and quorum(rows, ["g"], 2, 2).first().kind == "reject" and quorum(rows, ["g"], 1).first().kind == "accept"
    for bad in ({"accept_quorum": 0}, {"accept_quorum": 2, "min_known": 1}):
        with pytest.raises(ValueError, match="DECISION_INVALID_PARAMS"):
            quorum(rows, ["g"], **bad)
    found = vote(rows, ["g"]).first()
    assert (found.kind, found.reasons) == ("accept", ["a", "b"]) and vote(rows, ["g"], score="score").first().kind == "reject"  # 0.20 against 0.27
    missing = rows.withColumn("weight", F.when(F.col("kind") != "reject", F.col("weight")))
    with pytest.raises(PySparkException, match="DECISION_MISSING_WEIGHT"):
        vote(missing, ["g"]).collect()
    assert vote(missing, ["g"], missing_weight="use_one").first().kind == "reject"
    unscored = rows.withColumn("score", F.when(F.col("kind") != "reject", F.col("score")))
    with pytest.raises(PySparkException, match="DECISION_MISSING_SCORE"):
        vote(unscored, ["g"], score="score").collect()
    assert vote(unscored, ["g"], score="score", missing_score="abstain").first().kind == "accept" and vote(unscored, ["g"], score="score", missing_score="use_default").first().kind == "reject"
    with pytest.raises(PySparkException, match="DECISION_SCORE_OUT_OF_RANGE"):
        vote(rows.withColumn("score", F.col("score") * 3), ["g"], score="score").collect()
    best = FOLDED["core.decision.any_accept"](rows, ["g"], score="score").first()
    assert (best.kind, best.score) == ("accept", Decimal("0.9000"))
