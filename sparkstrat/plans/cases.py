"""Registered queries of chains: state cases, missing events and resets, a custom token, compiled graphs, frame checks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from ..operators import folds
from ..operators.decisions import accumulate, delay, edge_detect, epochs
from ..operators.series import ordered as window_of
from ..records import custom, graphs, packs
from ..sources import frames
from .compiler import compile_graph

KEYS, ORDER = ["user_id"], ["ts", "event_id"]

#: Machines of the state cases: what each event leads to, by state.
MACHINES = {
    "cooldown": ("ready", {"ready": {"signal": "ready", "fill": "cooldown", "cooldown_expired": "ready"}, "cooldown": {"signal": "cooldown", "fill": "cooldown", "cooldown_expired": "ready"}}),
    "market_freeze": ("active", {"active": {"signal": "active", "freeze_on": "frozen", "freeze_off": "active"}, "frozen": {"signal": "frozen", "freeze_on": "frozen", "freeze_off": "active"}}),
    "circuit_breaker": ("active", {"active": {"ok": "active", "trip": "tripped"}, "tripped": {"ok": "tripped", "trip": "tripped"}}),
    "observe_period": ("observing", {"observing": {"observe": "observing", "ready": "active"}, "active": {"observe": "active", "ready": "active"}}),
}


def definition(name: str) -> dict:
    start, table = MACHINES[name]
    moves = [{"from": a, "event": e, "to": b} for a, row in table.items() for e, b in row.items()]
    return {"states": sorted(table), "events": sorted(table[start]), "initial_state": start, "transitions": moves, "failure_policy": "raise"}


def machine(frame, name: str, column: str = "event"):
    """A state case: the machine's state after each event; failures are errors."""
    return folds.check(folds.fold(frame, "core.state.fsm", KEYS, ORDER, column, **definition(name)))


def two_state(frame, name: str, blocked: str):
    """state and decision: a signal in the ``blocked`` state is blocked, everything else is active."""
    states = machine(frame, name).withColumnRenamed("value", "state")
    both = frame.select(*KEYS, *ORDER, "event").join(states, [*KEYS, *ORDER])
    return both.withColumn("decision", F.when((F.col("event") == "signal") & (F.col("state") == blocked), "blocked").otherwise("active"))


def cumulative(frame, name: str, limit: int, reducer: str, low: str, high: str, blocked: str):
    """count (the accumulated state), the machine's state and the decision."""
    counted = frame.withColumn("count", accumulate(window_of(KEYS, ORDER), F.col("v"), reducer, 0))
    events = counted.withColumn("event", F.when(F.col("count") >= limit, high).otherwise(low))
    states = machine(events, name).withColumnRenamed("value", "state")
    both = events.select(*KEYS, *ORDER, "count").join(states, [*KEYS, *ORDER])
    return both.withColumn("decision", F.when(F.col("state") == blocked, "blocked").otherwise("active"))


def slot_budget(frame, budget: int = 2):
    used = frame.withColumn("count", accumulate(window_of(KEYS, ORDER), F.col("v"), "sum", 0))
    return used.withColumn("decision", F.when(F.col("count") <= budget, "active").otherwise("blocked"))


GRAPHS = {
    "ema_cross": {
        "capabilities": ["core"],
        "strategy": {
            "id": "ema_cross",
            "version": 1,
            "nodes": [
                {"id": "fast", "token": "indicator.ema", "inputs": {"series": "$externals.market.x"}, "params": {"span": 3}},
                {"id": "slow", "token": "indicator.ema", "inputs": {"series": "$externals.market.x"}, "params": {"span": 9}},
                {"id": "above", "token": "compare.gt", "inputs": {"a": "fast.value", "b": "slow.value"}},
                {"id": "decision", "token": "decision.lift_bool", "inputs": {"series": "above.value"}, "params": {"accept_reason": "EMA_ABOVE", "reject_reason": "EMA_BELOW"}},
            ],
            "outputs": {"decision": "decision.value"},
        },
    },
    "channel_breakout": {
        "capabilities": ["core"],
        "strategy": {
            "id": "channel_breakout",
            "version": 1,
            "nodes": [
                {"id": "mean", "token": "window.mean", "inputs": {"series": "$externals.market.x"}, "params": {"window": 5}},
                {"id": "top", "token": "window.max", "inputs": {"series": "$externals.market.x"}, "params": {"window": 5}},
                {"id": "over", "token": "signal.greater_than", "inputs": {"a": "$externals.market.x", "b": "mean.value"}},
                {"id": "at_top", "token": "cmp.gte", "inputs": {"a": "$externals.market.x", "b": "top.value"}},
                {"id": "both", "token": "logic.and", "inputs": {"a": "over.value", "b": "at_top.value"}},
            ],
            "outputs": {"signal": "both.value"},
        },
    },
    "rank_neutral": {
        "capabilities": ["core", "panel_type", "panel_ops", "panel_weights"],
        "strategy": {
            "id": "rank_neutral",
            "version": 1,
            "nodes": [
                {"id": "score", "token": "panel.demean", "inputs": {"panel": "$externals.panel.score"}},
                {"id": "top", "token": "panel.top_k", "inputs": {"panel": "score.value"}, "params": {"k": 5}},
                {"id": "held", "token": "selection.to_weights", "inputs": {"selection": "top.selection"}, "params": {"method": "equal_long"}},
                {"id": "neutral", "token": "weight.cap_per_symbol", "inputs": {"weights": "held.weights"}, "params": {"max_abs_weight": 0.15}},
            ],
            "outputs": {"weights": "neutral.weights"},
        },
    },
}


def _kalman(frame):
    """The example token: approved, granted and run on the executors."""
    port = {"type": "TimeSeries[float]"}
    token = packs.Token("example.level", inputs={"series": port}, outputs={"filtered": port}, params={"alpha": 0.5}, entrypoint="sparkstrat.records.example_tokens:level")
    here = os.path.dirname(os.path.abspath(custom.__file__))
    pack = packs.Pack("example", "1", (token,), implementation={"kind": "source_tree", "path": here})
    with tempfile.TemporaryDirectory() as folder:  # the driver's own: approvals are its record
        store = custom.Approvals(os.path.join(folder, "approvals.json"))
        custom.approve(store, pack, token.id, "research", token.id, True)
        grant = custom.issue_grant(store, pack, token.id, "case", "research")
    return custom.execute(frame, pack, token.id, grant, "case", {"series": "x"}, KEYS, ORDER, {"alpha": 1 / 3})


def bars(spark, sf_dir: str):
    """Daily bars of event values as a market frame, some days missing for some symbols."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    day = F.date_trunc("day", "ts")
    number = lambda x: F.round(x, 6).cast(frames.NUMBER)
    grouped = rows.groupBy(day.alias("timestamp"), F.concat(F.lit("U"), F.col("user_id") % 5, F.lit("/USD")).alias("symbol"))
    return grouped.agg(number(F.min_by("value", F.struct("ts", "event_id"))).alias("open"), number(F.max("value")).alias("high"), number(F.min("value")).alias("low"), number(F.max_by("value", F.struct("ts", "event_id"))).alias("close"), F.count("*").cast(frames.NUMBER).alias("volume"))


def cases(catalogue) -> dict:
    """name: (query, SQL)."""
    ev, order, rounded, sql_round = catalogue.EV, catalogue.ORDER, catalogue._r, catalogue._rs
    found: dict = {}

    def add(name, build, sql):
        found[name] = (build, sql)

    kinds = {"cooldown": ("fill", "cooldown_expired", "cooldown", "ready"), "market_freeze": ("freeze_on", "freeze_off", "frozen", "active")}
    for name, (on, off, bad, good) in kinds.items():
        event = f"CASE event_id % 7 WHEN 0 THEN '{on}' WHEN 3 THEN '{off}' ELSE 'signal' END"

        def go(s, d, n=name, e=event, b=bad):
            return two_state(catalogue.events(s, d).withColumn("event", F.expr(e)), n, b).select("event_id", "state", "decision")

        setter = f"last_value(CASE event WHEN '{on}' THEN '{bad}' WHEN '{off}' THEN '{good}' END IGNORE NULLS) OVER ({order} ROWS UNBOUNDED PRECEDING)"
        add(f"case_state_{name}", go, f"WITH {ev}, e AS (SELECT *, {event} AS event FROM ev), m AS (SELECT *, coalesce({setter}, '{good}') AS state FROM e) SELECT event_id, state, CASE WHEN event = 'signal' AND state = '{bad}' THEN 'blocked' ELSE 'active' END AS decision FROM m")
    run = f"OVER ({order} ROWS UNBOUNDED PRECEDING)"
    flag = lambda s, d: catalogue.events(s, d).withColumn("v", (F.col("y") > 90).cast("long"))
    add("case_state_circuit_breaker", lambda s, d: cumulative(flag(s, d), "circuit_breaker", 2, "sum", "ok", "trip", "tripped").select("event_id", F.col("count").cast("long").alias("count"), "state", "decision"), f"WITH {ev}, c AS (SELECT event_id, CAST(sum(CAST(y > 90 AS INT)) {run} AS BIGINT) AS count FROM ev) SELECT event_id, count, CASE WHEN count >= 2 THEN 'tripped' ELSE 'active' END AS state, CASE WHEN count >= 2 THEN 'blocked' ELSE 'active' END AS decision FROM c")
    add("case_state_observe_period", lambda s, d: cumulative(flag(s, d), "observe_period", 3, "count", "observe", "ready", "observing").select("event_id", F.col("count").cast("long").alias("count"), "state", "decision"), f"WITH {ev}, c AS (SELECT event_id, count(*) {run} AS count FROM ev) SELECT event_id, count, CASE WHEN count >= 3 THEN 'active' ELSE 'observing' END AS state, CASE WHEN count >= 3 THEN 'active' ELSE 'blocked' END AS decision FROM c")
    add("case_state_slot_budget", lambda s, d: slot_budget(flag(s, d)).select("event_id", F.col("count").cast("long").alias("count"), "decision"), f"WITH {ev}, c AS (SELECT event_id, CAST(sum(CAST(y > 90 AS INT)) {run} AS BIGINT) AS count FROM ev) SELECT event_id, count, CASE WHEN count <= 2 THEN 'active' ELSE 'blocked' END AS decision FROM c")

    holes = f"{ev}, m AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE x END AS z, sum(CAST(event_id % 13 = 0 AS INT)) {run} AS epoch FROM ev)"
    gaps = lambda s, d: catalogue.events(s, d).withColumn("z", F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE x END"))
    anew = lambda s, d: epochs(gaps(s, d).withColumn("reset", F.col("event_id") % 13 == 0), window_of(KEYS, ORDER), "reset")
    w, we = (lambda: window_of(KEYS, ORDER)), (lambda: window_of([*KEYS, "epoch"], ORDER))
    z, over, over_e = (lambda: F.col("z")), f"({order})", f"(PARTITION BY user_id, epoch {order.split('user_id', 1)[1].strip()})"
    lagged = lambda o: f"coalesce(lag(z, 2 IGNORE NULLS) OVER {o}, -1)"
    add("op_state_delay_skip", lambda s, d: gaps(s, d).select("event_id", rounded(delay(w(), z(), 2, -1.0, "emit_initial", "skip")).alias("value")), f"WITH {holes} SELECT event_id, {sql_round(lagged(over))} AS value FROM m")
    add("op_state_delay_emit_null", lambda s, d: gaps(s, d).select("event_id", rounded(delay(w(), z(), 2, -1.0, "emit_initial", "emit_null")).alias("value")), f"WITH {holes} SELECT event_id, CASE WHEN z IS NOT NULL THEN {sql_round(lagged(over))} END AS value FROM m")
    add("op_state_delay_reset", lambda s, d: anew(s, d).select("event_id", rounded(delay(we(), z(), 2, -1.0, "emit_initial", "skip")).alias("value")), f"WITH {holes} SELECT event_id, {sql_round(lagged(over_e))} AS value FROM m")
    for reducer, call in {"sum": "sum(z)", "count": "nullif(count(z), 0)", "max": "max(z)", "min": "min(z)", "last": "last_value(z IGNORE NULLS)"}.items():
        fold = call.replace("count(z)", f"count(z) OVER {over_e[:-1]} ROWS UNBOUNDED PRECEDING)") if reducer == "count" else f"{call} OVER {over_e[:-1]} ROWS UNBOUNDED PRECEDING)"
        add(f"op_state_accumulate_reset_{reducer}", lambda s, d, r=reducer: anew(s, d).select("event_id", rounded(accumulate(we(), z(), r, None, "skip")).alias("value")), f"WITH {holes} SELECT event_id, {sql_round(fold)} AS value FROM m")
    was = f"last_value(z > 50 IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    for missing, rest in (("skip", "false"), ("emit_null", "NULL")):
        add(f"op_state_edge_detect_{missing}", lambda s, d, m=missing: gaps(s, d).select("event_id", edge_detect(w(), z() > 50, "rising", m).alias("value")), f"WITH {holes} SELECT event_id, CASE WHEN z IS NULL THEN {rest} ELSE coalesce(NOT {was} AND z > 50, false) END AS value FROM m")

    recursive = f"""s AS (SELECT *, row_number() OVER ({order}) AS n FROM ev),
r AS (SELECT user_id, event_id, n, x AS v FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.event_id, s.n, r.v + CAST(1 AS DOUBLE) / 3 * (s.x - r.v) FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)"""
    add("case_custom_token_level", lambda s, d: _kalman(catalogue.events(s, d)).select("event_id", rounded(F.col("filtered")).alias("value")), f"WITH RECURSIVE {ev}, {recursive} SELECT event_id, {sql_round("v")} AS value FROM r")

    two = f"""s AS (SELECT *, row_number() OVER ({order}) AS n FROM ev),
r AS (SELECT user_id, event_id, n, x AS f, x AS w FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.event_id, s.n, s.x / 2 + r.f / 2, s.x * 0.2 + r.w * 0.8 FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)"""
    compiled = lambda s, d, g: compile_graph(graphs.from_mapping(GRAPHS[g]), catalogue.events(s, d), KEYS, ORDER)
    add("graph_ema_cross", lambda s, d: compiled(s, d, "ema_cross").select("event_id", F.col("decision.kind").alias("kind"), F.array_join("decision.reasons", ",").alias("reasons")), f"WITH RECURSIVE {ev}, {two} SELECT event_id, CASE WHEN f > w THEN 'accept' ELSE 'reject' END AS kind, CASE WHEN f > w THEN 'EMA_ABOVE' ELSE 'EMA_BELOW' END AS reasons FROM r")
    five = f"OVER ({order} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    add("graph_channel_breakout", lambda s, d: compiled(s, d, "channel_breakout").where("signal is not null").select("event_id", "signal"), f"WITH {ev}, m AS (SELECT *, avg(x) {five} AS a, max(x) {five} AS t, count(*) {five} AS n FROM ev) SELECT event_id, x > a AND x >= t AS signal FROM m WHERE n = 5")
    add("graph_rank_neutral", lambda s, d: compile_graph(graphs.from_mapping(GRAPHS["rank_neutral"]), catalogue.panel_nation(s, d), ["symbol"], ["ts"], {"panel.score": catalogue.panel_nation(s, d)}).select("ts", "symbol", rounded(F.col("weight")).alias("weight")), f"WITH {catalogue.PN}, k AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY value DESC, symbol) AS k FROM pn WHERE u), t AS (SELECT * FROM k WHERE k <= 5) SELECT ts, symbol, {sql_round('least(1.0 / count(*) OVER (PARTITION BY ts), 0.15)')} AS weight FROM t")

    grid = "b AS (SELECT date_trunc('day', ts) AS day, 'U' || (user_id % 5) || '/USD' AS symbol FROM events WHERE value > 0 GROUP BY 1, 2), h AS (SELECT day, count(*) AS n FROM b GROUP BY 1), k AS (SELECT count(DISTINCT symbol) AS n FROM b)"
    add("frame_market_violations", lambda s, d: frames.violations(bars(s, d), "market").select("code", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "n"), f"WITH {grid} SELECT 'FRAME_ALIGNMENT_MISSING' AS code, strftime(day, '%Y-%m-%d') AS day, k.n - h.n AS n FROM h, k WHERE k.n > 1 AND h.n < k.n")
    def listed(s, d):
        out = frames.texts(bars(s, d), "market")
        return out.select("timestamp", "symbol", F.col("volume").cast("long").alias("volume"), *[rounded(F.col(c).cast("double")).alias(c) for c in ("open", "high", "low", "close")])

    add("frame_market_bars", listed, f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'U' || (user_id % 5) || '/USD' AS symbol, count(*) AS volume, {sql_round('arg_min(value, (ts, event_id))')} AS open, {sql_round('max(value)')} AS high, {sql_round('min(value)')} AS low, {sql_round('arg_max(value, (ts, event_id))')} AS close FROM events WHERE value > 0 GROUP BY 1, 2")
    return found
