"""Decisions, gates, risk records and state: window expressions over a key's ordered rows, and folds of a group's decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import RAISE, decision, guard, hhmm, lag_valid, merged_reasons

def _running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(W.unboundedPreceding, 0)


def _blocked(bad: Column, reason: str) -> Column:
    return decision(F.when(bad, "block").otherwise("accept"), F.when(bad, reason))


def lift_bool(x, accept_reason="DECISION_TRUE", reject_reason="DECISION_FALSE"):
    return decision(F.when(x, "accept").otherwise("reject"), F.when(x, accept_reason).otherwise(reject_reason))


def long_flat(x):
    return lift_bool(x, "DECISION_LONG", "DECISION_FLAT")


def long_short(long, short):
    kind = F.when(long & short, "block").when(long | short, "accept").otherwise("reject")
    return decision(kind, F.when(long & short, "DECISION_CONFLICT").when(long, "DECISION_LONG").when(short, "DECISION_SHORT").otherwise("DECISION_FLAT"))


def signal_to_decision(x, threshold=0.0):
    return lift_bool(x >= threshold, "DECISION_SIGNAL_PASS", "DECISION_SIGNAL_FAIL")


def entry_exit_to_position(w, entry, leave):
    """Both: block, and the position stays; exit: flat; entry: in; else as it was."""
    set_to = F.when(entry & ~leave, F.lit(True)).when(leave & ~entry, F.lit(False))
    held = F.coalesce(F.last(set_to, ignorenulls=True).over(_running(w)), F.lit(False))
    both = entry & leave
    kind = F.when(both, "block").when(held, "accept").otherwise("reject")
    return decision(kind, F.when(both, "DECISION_CONFLICT").when(held, "DECISION_LONG").otherwise("DECISION_FLAT"))


def gate_decision(given, gate):
    """The gate's block wins, with both records' reasons."""
    stop = gate["kind"] == "block"
    return F.when(stop, F.struct(F.lit("block").alias("kind"), merged_reasons(given["reasons"], gate["reasons"]).alias("reasons"))).otherwise(given)


def _last_setter(on: str, off: str, reason: str):
    def run(w, event):
        state = F.last(F.when(event == on, True).when(event == off, False), ignorenulls=True).over(_running(w))
        return _blocked((event == "signal") & F.coalesce(state, F.lit(False)), reason)

    return run


def _cumulative(test, reason: str, name: str, default: int):
    def run(w, x, **params):
        limit = params.get(name, default)
        return _blocked(test(F.sum(x).over(_running(w)), limit), reason)

    return run


def time_window(ts, start, end):
    """Over midnight if start is after end."""
    now = hhmm(ts)
    inside = now.between(start, end) if start <= end else (now >= start) | (now <= end)
    return _blocked(~inside, "GATE_BLOCKED_TIME_WINDOW")


def position_cap(given, position, max_abs_position):
    over = F.abs(position) > max_abs_position
    add = F.array(F.lit("RISK_POSITION_CAP"))
    return F.when(over, F.struct(F.lit("block").alias("kind"), merged_reasons(given["reasons"], add).alias("reasons"))).otherwise(given)


def stop_loss(entry, current, stop_pct):
    return _blocked(current <= entry * (1 - stop_pct), "RISK_STOP_LOSS")


def take_profit(entry, current, take_pct):
    return lift_bool(current >= entry * (1 + take_pct), "RISK_TAKE_PROFIT", "RISK_HOLD")


def trailing_stop(w, price, trail_pct):
    top = F.max(price).over(_running(w))
    return _blocked((price <= top * (1 - trail_pct)) & (price < top), "RISK_TRAILING_STOP")


def max_drawdown(w, equity, max_drawdown):
    top = F.max(equity).over(_running(w))
    return _blocked(guard((top - equity) / top, equity <= 0, "RISK_EQUITY_INVALID") >= max_drawdown, "RISK_MAX_DRAWDOWN")


ROW = {
    "core.decision.lift_bool": lift_bool, "core.decision.long_flat": long_flat, "core.decision.long_short": long_short, "core.decision.signal_to_decision": signal_to_decision,
    "core.decision.gate_decision": gate_decision,
    "core.gate.volatility_regime": lambda x, max_volatility: _blocked(x > max_volatility, "GATE_BLOCKED_VOLATILITY"),
    "core.gate.drawdown": lambda x, max_drawdown: _blocked(F.abs(x) >= max_drawdown, "GATE_BLOCKED_DRAWDOWN"),
    "core.gate.time_window": time_window,
    "core.gate.rebalance": lambda x, band: _blocked(F.abs(x) < band, "GATE_BLOCKED_REBALANCE"),
    "core.gate.min_hold": lambda x, bars: _blocked(x < bars, "GATE_BLOCKED_MIN_HOLD"),
    "core.gate.max_hold": lambda x, bars: _blocked(x < bars, "GATE_BLOCKED_MAX_HOLD_WAIT"),
    "core.risk.position_cap": position_cap, "core.risk.exposure_cap_record": position_cap,
    "core.risk.stop_loss_record": stop_loss, "core.risk.take_profit_record": take_profit,
}


MISSING = ("error", "skip", "emit_null")


def _with_missing(x: Column, found: Column, missing: str, policy: str) -> Column:
    """``found``, but for rows without an input: an error, null, or (skip) the state as it stands."""
    if missing not in MISSING:
        raise ValueError("STATE_MISSING_POLICY_UNKNOWN")
    if missing == "skip":
        return found
    return guard(F.when(x.isNotNull(), found), x.isNull(), "STATE_MISSING_EVENT", policy if missing == "error" else "null")


def delay(w, x, steps=1, initial=None, warmup="emit_null", missing="error", policy=RAISE):
    """The valid input ``steps`` back; missing inputs don't count. For resets, partition the window by ``epochs``."""
    if steps < 1:
        raise ValueError("STATE_STEPS_INVALID")
    if warmup not in ("emit_null", "emit_initial", "error"):
        raise ValueError("STATE_WARMUP_POLICY_UNKNOWN")
    ready = F.count(x).over(w.rowsBetween(W.unboundedPreceding, -1)) >= steps
    start = F.lit(initial) if warmup == "emit_initial" else F.lit(None)
    return _with_missing(x, F.when(ready, lag_valid(x, steps).over(w)).otherwise(start), missing, policy)


class Reducers:
    """Named reducers of ``state.accumulate``: a builder of (running window, input, initial) for each."""

    def __init__(self):
        self._builders: dict = {}

    def register(self, name: str, build) -> None:
        if name in self._builders:
            raise ValueError("STATE_REDUCER_DUPLICATE")
        self._builders[name] = build

    def names(self) -> list[str]:
        return sorted(self._builders)

    def get(self, name: str):
        if name not in self._builders:
            raise ValueError("STATE_REDUCER_UNKNOWN")
        return self._builders[name]


def default_reducers() -> Reducers:
    """count, last, max, min, sum; without an initial value the first input is the state."""
    found = Reducers()
    started = lambda initial: F.lit(initial)
    found.register("count", lambda run, x, initial: F.lit(initial or 0) + F.count(x).over(run))
    found.register("sum", lambda run, x, initial: F.sum(x).over(run) if initial is None else F.lit(initial) + F.coalesce(F.sum(x).over(run), F.lit(0)))
    found.register("last", lambda run, x, initial: F.coalesce(F.last(x, ignorenulls=True).over(run), started(initial)))
    found.register("min", lambda run, x, initial: F.least(F.min(x).over(run), started(initial)))
    found.register("max", lambda run, x, initial: F.greatest(F.max(x).over(run), started(initial)))
    return found


def accumulate(w, x, reducer="sum", initial=None, missing="error", policy=RAISE, reducers=None):
    """The reducer's state after each input."""
    run = _running(w)
    state = (reducers or default_reducers()).get(reducer)(run, x, initial)
    if reducer == "count" and initial is None:
        state = F.when(F.count(x).over(run) > 0, state)
    return _with_missing(x, state, missing, policy)


def edge_detect(w, x, mode="rising", missing="error", policy=RAISE):
    """Against the previous valid value; the first is no edge, and a skipped input is none."""
    was = F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    found = {"rising": ~was & x, "falling": was & ~x, "change": was != x}[mode]
    return _with_missing(x, F.coalesce(found, F.lit(False)), missing, policy)


def epochs(frame: DataFrame, w: WindowSpec, reset: str, out: str = "epoch") -> DataFrame:
    """The number of resets so far: a key's state starts anew in each epoch, so windows are partitioned by it as well."""
    return frame.withColumn(out, F.sum(F.coalesce(F.col(reset), F.lit(False)).cast("int")).over(_running(w)))


ORDERED = {
    "core.decision.entry_exit_to_position": entry_exit_to_position,
    "core.gate.cooldown": _last_setter("fill", "cooldown_expired", "GATE_BLOCKED_COOLDOWN"),
    "core.gate.market_freeze": _last_setter("freeze_on", "freeze_off", "GATE_BLOCKED_MARKET_FREEZE"),
    "core.gate.circuit_breaker": _cumulative(lambda s, n: s >= n, "GATE_BLOCKED_CIRCUIT_BREAKER", "threshold", 2),
    "core.gate.observe_period": _cumulative(lambda s, n: s < n, "GATE_BLOCKED_OBSERVE_PERIOD", "window", 3),
    "core.gate.slot_budget": _cumulative(lambda s, n: s > n, "GATE_BLOCKED_SLOT_BUDGET", "slot_budget", 2),
    "core.risk.trailing_stop_record": trailing_stop, "core.risk.max_drawdown_record": max_drawdown,
    "core.state.delay": delay, "core.state.accumulate": accumulate, "core.state.edge_detect": edge_detect,
}

KINDS_AND = ["accept", "unknown", "reject", "block"]
KINDS_ANY = ["reject", "unknown", "accept", "block"]


def _reasons() -> Column:
    """All reasons of a group: codes of a closed set, so the set stays small, however many rows there are."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons")


def _monoid(order):
    def run(rows: DataFrame, keys: list[str], score: str | None = None) -> DataFrame:
        """The kind of highest priority, and all reasons; with a score column, the largest score. Partial aggregation applies to all."""
        level = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
        folded = rows.groupBy(*keys).agg(F.max(level).alias("_level"), _reasons(), *([F.max(score).alias("score")] if score else []))
        return folded.select(*keys, F.element_at(F.array(*map(F.lit, order)), F.col("_level").cast("int")).alias("kind"), "reasons", *(["score"] if score else []))

    return run


def _policy(kind: str, reason: str):
    def run(rows: DataFrame, keys: list[str], score: str | None = None) -> DataFrame:
        folded, open_ = _monoid(KINDS_AND)(rows, keys, score), F.col("kind") == "unknown"
        reasons = F.when(open_, merged_reasons(F.col("reasons"), F.array(F.lit(reason)))).otherwise(F.col("reasons"))
        return folded.select(*keys, F.when(open_, kind).otherwise(F.col("kind")).alias("kind"), reasons.alias("reasons"), *(["score"] if score else []))

    return run


def across(token: str, decisions: list[Column]) -> Column:
    """A monoid or its policy over decisions of one row, as a decision."""
    order = KINDS_ANY if token == "core.decision.any_accept" else KINDS_AND
    names, final = F.array(*map(F.lit, order)), {"core.decision.strict_and": ("reject", "DECISION_UNKNOWN_AS_REJECT"), "core.decision.permissive_and": ("accept", "DECISION_UNKNOWN_AS_ACCEPT")}.get(token)
    level = F.array_max(F.array(*[F.array_position(names, d["kind"]) for d in decisions]))
    kind, reasons = F.element_at(names, level.cast("int")), merged_reasons(*[d["reasons"] for d in decisions])
    if final:
        open_ = kind == "unknown"
        reasons = F.when(open_, merged_reasons(reasons, F.array(F.lit(final[1])))).otherwise(reasons)
        kind = F.when(open_, final[0]).otherwise(kind)
    return F.struct(kind.alias("kind"), reasons.alias("reasons"))


ACROSS = ("core.decision.unknown_propagating_and", "core.decision.any_accept", "core.decision.strict_and", "core.decision.permissive_and")


def _votes(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in KINDS_AND], _reasons())


def majority(rows: DataFrame, keys: list[str]) -> DataFrame:
    yes, no = F.col("_accept"), F.col("_reject")
    return _votes(rows, keys).select(*keys, F.when(F.col("_block") > 0, "block").when(yes > no, "accept").when(no > yes, "reject").otherwise("unknown").alias("kind"), "reasons")


def quorum(rows: DataFrame, keys: list[str], accept_quorum: int, min_known: int | None = None) -> DataFrame:
    """accept from ``accept_quorum`` votes on; else reject if ``min_known`` is given and so many are known."""
    if not isinstance(accept_quorum, int) or accept_quorum <= 0 or (min_known is not None and (not isinstance(min_known, int) or min_known < accept_quorum)):
        raise ValueError("DECISION_INVALID_PARAMS")
    yes, no = F.col("_accept"), F.col("_reject")
    known = (yes + no >= min_known) if min_known is not None else F.lit(False)
    return _votes(rows, keys).select(*keys, F.when(F.col("_block") > 0, "block").when(yes >= accept_quorum, "accept").when(known, "reject").otherwise("unknown").alias("kind"), "reasons")


def weighted_vote(rows: DataFrame, keys: list[str], weight: str = "weight", score: str | None = None, missing_weight: str = "error", missing_score: str = "error", policy: str = RAISE, order: list[str] | None = None) -> DataFrame:
    """The sign of the accepted less the rejected weights (times score, in [0, 1], if given).

    missing_weight: error or use_one; missing_score: error, abstain (0) or use_default (1). Only accept and reject rows are looked at.
    order: columns in whose order a group's weights are added. Doubles need it: where both sides weigh the same, the sum is zero or
    a rounding error, by the order of addition, which would else be by how the rows are dealt. A group is then one task's."""
    if missing_weight not in ("error", "use_one") or missing_score not in ("error", "abstain", "use_default"):
        raise ValueError("DECISION_INVALID_PARAMS")
    w = F.coalesce(F.col(weight), F.lit(1)) if missing_weight == "use_one" else guard(F.col(weight), F.col(weight).isNull(), "DECISION_MISSING_WEIGHT", policy)
    size = w
    if score:
        s = F.col(score)
        s = guard(s, s.isNull(), "DECISION_MISSING_SCORE", policy) if missing_score == "error" else F.coalesce(s, F.lit(0 if missing_score == "abstain" else 1))
        size = w * guard(s, (s < 0) | (s > 1), "DECISION_SCORE_OUT_OF_RANGE", policy)
    signed = F.when(F.col("kind") == "accept", size).when(F.col("kind") == "reject", -size)
    total = F.sum(signed)
    if order:
        w = W.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumns({"_sum": total.over(_running(w)), "_at": F.row_number().over(w)})
        total = F.max_by("_sum", "_at")
    folded = rows.groupBy(*keys).agg(F.count_if(F.col("kind") == "block").alias("_block"), F.coalesce(total, F.lit(0)).alias("_total"), _reasons())
    return folded.select(*keys, F.when(F.col("_block") > 0, "block").when(F.col("_total") > 0, "accept").when(F.col("_total") < 0, "reject").otherwise("unknown").alias("kind"), "reasons")


FOLDED = {
    "core.decision.unknown_propagating_and": _monoid(KINDS_AND), "core.decision.any_accept": _monoid(KINDS_ANY),
    "core.decision.strict_and": _policy("reject", "DECISION_UNKNOWN_AS_REJECT"), "core.decision.permissive_and": _policy("accept", "DECISION_UNKNOWN_AS_ACCEPT"),
    "core.decision.majority": majority, "core.decision.quorum": quorum, "core.decision.weighted_vote": weighted_vote,
}
