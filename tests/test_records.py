"""Frames, canonical JSON, graphs, packs and custom tokens."""

import json
import os
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkstrat import sources
from sparkstrat.plans import cases
from sparkstrat.plans.compiler import compile_graph
from sparkstrat.records import canonical, custom, graphs, packs
from sparkstrat.sources import formats, frames

DAYS = [datetime(2024, 3, d, 9, 30, 0, 250000 * (d % 2), tzinfo=timezone.utc) for d in (1, 2)]


def made(spark, kind):
    n = Decimal
    rows = {
        "market": [(t, s, n("1.50"), n("2"), n("0.25"), n("1.75"), n("1000")) for t in DAYS[::-1] for s in ("XYZ/USD", "ABC/USD")],
        "signal": [(DAYS[1], "ABC/USD", "long", n("0.5")), (DAYS[0], "ABC/USD", "flat", n("0"))],
        "feature": [(DAYS[0], "ABC/USD", {"z": n("1.10"), "a": n("-2")}), (DAYS[1], "ABC/USD", {"a": n("3")})],
        "trace": [(DAYS[0], "n2", "made", '{"k":[1,2]}'), (DAYS[0], "n1", 'said "so", twice', "{}")],
    }[kind]
    return spark.createDataFrame(rows, frames.SCHEMAS[kind])


def listed(frame, kind):
    return [tuple(r) for r in frames.texts(frames.canonical(frame, kind), kind).collect()]


@pytest.mark.parametrize("kind", frames.KINDS)
def test_formats_round_trip(spark, kind, tmp_path):
    frame = made(spark, kind)
    wanted = listed(frame, kind)
    assert sources.require(frame, kind) is frame
    assert wanted[0][0] == "2024-03-01T09:30:00.250000Z" and [r[0] for r in wanted] == sorted(r[0] for r in wanted)
    sources.write_csv(frame, kind, f"{tmp_path}/csv")
    assert listed(sources.read_csv(spark, kind, f"{tmp_path}/csv"), kind) == wanted
    sources.write_parquet(frame, kind, f"{tmp_path}/parquet")
    assert listed(sources.read_parquet(spark, kind, f"{tmp_path}/parquet"), kind) == wanted
    for lines in (True, False):
        sources.write_json(frame, kind, f"{tmp_path}/json{lines}", lines, "own")
        found, again = sources.read_json(spark, f"{tmp_path}/json{lines}", lines)
        assert found == kind and listed(again, kind) == wanted
    assert listed(sources.from_pandas(spark, sources.to_pandas(frame, kind), kind), kind) == wanted
    found, again = sources.from_arrow(spark, sources.to_arrow(frame, kind))
    assert found == kind and listed(again, kind) == wanted
    assert sources.digest(frame, kind).first() == sources.digest(again.repartition(3), kind).first() and sources.frame_hash(frame, kind) == sources.frame_hash(again, kind)


def test_numbers_are_canonical(spark):
    given = {"1.50": "1.5", "2": "2", "100": "100", "0": "0", "-0.0": "0", "0.000001": "0.000001", "-3.1400": "-3.14", "0.000000000000000001": "0.000000000000000001"}
    rows = spark.createDataFrame([(k,) for k in given], "s string").select("s", frames.plain_number(F.col("s").cast(frames.NUMBER)).alias("v"))
    assert {r.s: r.v for r in rows.collect()} == given


def test_frame_rules(spark):
    bars = made(spark, "market")
    codes = lambda f, kind="market", **p: sorted((r.code, r.n) for r in frames.violations(f, kind, **p).collect())
    assert codes(bars) == [] and codes(bars.limit(0)) == []
    assert codes(bars.unionByName(bars.limit(1))) == [("FRAME_DUPLICATE_ROW", 2)]
    assert codes(bars.where(~((F.col("symbol") == "ABC/USD") & (F.dayofmonth("timestamp") == 2)))) == [("FRAME_ALIGNMENT_MISSING", 1)]
    assert codes(bars.where("symbol = 'ABC/USD'"), symbols=["NEW/USD"]) == [("FRAME_ALIGNMENT_MISSING", 1)] * 2
    assert codes(bars.withColumn("symbol", F.lower("symbol"))) == [("FRAME_SYMBOL_INVALID", 1)] * 4
    assert codes(made(spark, "signal").withColumn("signal", F.lit("up")), "signal") == [("FRAME_SIGNAL_INVALID", 1)] * 2
    assert codes(bars.withColumn("volume", F.lit(None).cast(frames.NUMBER))) == [("FRAME_FIELD_MISSING", 1)] * 4
    with pytest.raises(ValueError, match="FRAME_DUPLICATE_ROW"):
        sources.require(bars.unionByName(bars), "market")
    with pytest.raises(ValueError, match="FRAME_VERSION_UNSUPPORTED"):
        frames.kind_of("own-order-frame/1")
    with pytest.raises(ValueError, match="FRAME_VERSION_MISSING"):
        sources.from_arrow(spark, bars.toArrow().replace_schema_metadata(None))
    with pytest.raises(ValueError, match="FRAME_COLUMN_MISSING"):
        formats.from_pandas(spark, sources.to_pandas(bars, "market").drop(columns="close"), "market")
    with pytest.raises(ValueError, match="TOO_LARGE"):
        frames.frame_hash(bars, "market", max_rows=3)


def test_canonical_json():
    assert canonical.canonical_json({"b": [1, 2.5, None], "a": "é"}) == '{"a":"é","b":[1,2.5,null]}'.encode()
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError, match="NONFINITE"):
            canonical.canonical_json([bad])
    for bad in ((1,), b"x", {1: 2}, {"a": object()}):
        with pytest.raises(TypeError):
            canonical.canonical_json(bad)
    deep: list = []
    for _ in range(canonical.MAX_DEPTH):
        deep = [deep]
    canonical.canonical_json(deep)
    with pytest.raises(ValueError, match="TOO_DEEP"):
        canonical.canonical_json([deep])
    assert canonical.is_hash(canonical.record_hash("a", 1)) and canonical.record_hash("a", 1) != canonical.record_hash("b", 1)
    chain = canonical.audit_chain([{"event": "x", "at": 1}, {"event": "y", "at": 2}])
    assert chain == canonical.audit_chain([{"event": "x", "at": 7}, {"event": "y", "at": 8}]) and chain[1] != canonical.audit_chain([{"event": "y"}])[0]


def graph(**changes):
    return graphs.from_mapping(json.loads(json.dumps({**cases.GRAPHS["channel_breakout"], **changes})))


def codes(found):
    return [d.code for d in found]


def test_graphs(tmp_path):
    base = graph()
    assert [n.id for n in graphs.ordered(base)].index("both") == 4 and graphs.validate(base) == []
    turned = json.loads(json.dumps(cases.GRAPHS["channel_breakout"]))
    turned["strategy"]["nodes"].reverse()
    assert graphs.hashes(graphs.from_mapping(turned)) == graphs.hashes(base)
    turned["strategy"]["nodes"][-1]["params"]["window"] = 6
    other = graphs.hashes(graphs.from_mapping(turned))
    assert other["graph"] == graphs.hashes(base)["graph"] and other["param"] != graphs.hashes(base)["param"] and other["instance"] != graphs.hashes(base)["instance"]
    text = "capabilities: [core]\nstrategy:\n  id: s\n  nodes:\n  - {id: a, token_ref: {namespace: core, name: data.shift, version: 1}, inputs: {series: $externals.m.x}, params: {periods: -1}}\n  - {id: b, token: math.neg, inputs: {x: a.value}}\n  outputs: {o: b.value}\n"
    (tmp_path / "g.yaml").write_text(text)
    ahead = graphs.load(str(tmp_path / "g.yaml"))
    assert ahead.node("a").token == "core.data.shift"
    assert [(d.node, d.severity) for d in graphs.temporal(ahead)] == [("a", "warning"), ("b", "warning")]
    assert {d.severity for d in graphs.validate(ahead, "pretrade")} == {"error"}
    assert codes(graphs.validate(graph(capabilities=["core", "magic"]))) == ["CAPABILITY_NOT_ACCEPTED"]
    ranked = cases.GRAPHS["rank_neutral"]
    assert graphs.validate(graphs.from_mapping(ranked)) == []
    assert "CAPABILITY_PANEL_OPS_REQUIRES_PANEL_TYPE" in codes(graphs.validate(graphs.from_mapping({**ranked, "capabilities": ["core", "panel_ops"]})))
    assert "CAPABILITY_PANEL_WEIGHTS_MISSING" in codes(graphs.validate(graphs.from_mapping({**ranked, "capabilities": ["core", "panel_type", "panel_ops"]})))
    broken = {"strategy": {"id": "s", "nodes": [{"id": "a", "token": "no.such", "inputs": {"x": "c.value"}}, {"id": "p", "token": "plan.noop"}], "outputs": {"o": "q.value"}}}
    assert codes(graphs.validate(graphs.from_mapping(broken), "paper")) == ["TOKEN_UNKNOWN", "INPUT_UNRESOLVED", "TOKEN_METADATA_ONLY", "OUTPUT_UNRESOLVED"]
    circle = {"strategy": {"id": "s", "nodes": [{"id": "a", "token": "math.neg", "inputs": {"x": "b.v"}}, {"id": "b", "token": "math.neg", "inputs": {"x": "a.v"}}]}}
    assert codes(graphs.validate(graphs.from_mapping(circle))) == ["GRAPH_CYCLE"]
    for bad in ({}, {"strategy": {"nodes": []}}, {"strategy": {"id": "s", "nodes": [{"id": "a", "token": "math.neg"}] * 2}}, {"strategy": {"id": "s", "nodes": [{"id": 1}]}}):
        with pytest.raises(ValueError, match="GRAPH"):
            graphs.from_mapping(bad)


def test_compiled_graph_is_one_plan(spark):
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 9, 5, 6])], "key string, ts long, x double")
    out = compile_graph(graph(), rows, ["key"], ["ts"])
    assert out.columns == ["key", "ts", "signal"] and [r.signal for r in out.orderBy("ts").collect()][4:] == [True, False, False]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # both windows stand on one exchange
    for token, code in (("plan.noop", "TOKEN_METADATA_ONLY"), ("own.token", "TOKEN_UNKNOWN"), ("decision.majority", "NOT_COMPILED")):
        with pytest.raises(ValueError, match=code):
            compile_graph(graphs.from_mapping({"strategy": {"id": "s", "nodes": [{"id": "p", "token": token}]}}), rows, ["key"], ["ts"])


def test_graph_of_constants_custom_tokens_and_decisions(spark):
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([4, 1, 9, 2])], "key string, ts long, x double")
    lift = lambda i, source: {"id": i, "token": "decision.lift_bool", "inputs": {"series": source}, "params": {"accept_reason": f"{i}_YES", "reject_reason": f"{i}_NO", "note": "ignored"}}
    nodes = [
        {"id": "half", "token": "own.half", "inputs": {"series": "$externals.market.x"}, "params": {"by": 2}},
        {"id": "low", "token": "compare.lt", "inputs": {"a": "half.out", "b": "$externals.limits.low"}},
        {"id": "high", "token": "compare.gt", "inputs": {"a": "$externals.market.x", "b": 3.5}},
        lift("A", "low.value"), lift("B", "high.value"),
        {"id": "both", "token": "decision.strict_and", "inputs": {"decisions": ["A.decision", "B.decision"]}},
        {"id": "any", "token": "decision.any_accept", "inputs": {"decisions": ["A.decision", "B.decision"]}},
        {"id": "plan", "token": "plan.noop", "inputs": {"decision": "both.decision"}},
    ]
    halved = lambda base, ports, keys, order, params: base.selectExpr(*keys, *order, f"{ports['series']} / {params['by']} as out")
    strategy = {"strategy": {"id": "s", "nodes": nodes, "outputs": {"plan": "plan.plan", "any": "any.decision"}}}
    out = compile_graph(graphs.from_mapping(strategy), rows, ["key"], ["ts"], {"limits.low": 2.5}, {"own.half": halved}).orderBy("ts").collect()
    assert [(r.plan.kind, r["any"].kind) for r in out] == [("accept", "accept"), ("reject", "accept"), ("reject", "accept"), ("reject", "accept")]
    assert out[1].plan.reasons == ["A_YES", "B_NO"] and codes(graphs.validate(graphs.from_mapping(strategy), custom=("own.half",))) == ["TOKEN_METADATA_ONLY"]


def test_versions_and_packs(tmp_path):
    for version, wanted, fits in (("1.4.2", "~=1.4", True), ("2.0", "~=1.4", False), ("1.4.9", "~=1.4.2", True), ("1.5", "~=1.4.2", False), ("1.0", "==1.*", True), ("1.2.0", "==1.2", True), ("2.0rc1", ">=2.0", False), ("2.0", ">2.0rc1,!=2.1", True), ("1", "", True)):
        assert packs.matches(version, wanted) == fits, (version, wanted)
    made_of = lambda i, v, requires=(), token=None: packs.pack_of({"id": i, "version": v, "tokens": [{"id": token or f"{i}.t", "entrypoint": "m:f"}], "requires": dict(requires)})
    registry = packs.Registry()
    for p in (made_of("a", "1.0", {"b": ">=1,<2"}), made_of("b", "1.0"), made_of("b", "1.5"), made_of("b", "2.0")):
        registry.register(p)
    found = registry.resolve({"a": ""})
    assert [(p.id, p.version) for p in found] == [("b", "1.5"), ("a", "1.0")]
    with pytest.raises(ValueError, match="PACK_CONFLICT"):
        registry.resolve({"a": "", "b": ">=2"})
    with pytest.raises(KeyError, match="PACK_UNRESOLVED"):
        registry.resolve({"b": ">3"})
    with pytest.raises(ValueError, match="TOKEN_DUPLICATE"):
        registry.register(made_of("c", "1", token="a.t"))
    registry.register(made_of("x", "1", {"y": ""}))
    registry.register(made_of("y", "1", {"x": ""}))
    with pytest.raises(ValueError, match="PACK_CYCLE"):
        registry.resolve({"x": ""})
    locked = packs.lock(found)
    assert packs.verify_lock(locked, found) == []
    assert packs.verify_lock(locked, [made_of("b", "1.0")]) == ["LOCK_PACK_MISSING: a", "LOCK_VERSION_DIFFERS: b"]
    assert packs.verify_lock(locked, [*found[1:], made_of("b", "1.5", token="b.other")]) == ["LOCK_HASH_DIFFERS: b"]
    (tmp_path / "p.json").write_text(json.dumps({"id": "p", "tokens": [{"id": "p.t"}]}))
    (tmp_path / "p.yaml").write_text("id: p\ntokens: [{id: p.t}]\n")
    assert packs.load_pack(str(tmp_path / "p.json")) == packs.load_pack(str(tmp_path / "p.yaml"))


def test_custom_tokens(spark, tmp_path):
    port = {"type": "TimeSeries[float]"}
    token = packs.Token("example.level", inputs={"series": port}, outputs={"filtered": port}, params={"alpha": 0.5}, entrypoint="sparkstrat.records.example_tokens:level")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/code.py").write_text("x = 1\n")
    pack = packs.Pack("example", "1", (token,), implementation={"kind": "source_tree", "path": "src"})
    base, store = str(tmp_path), custom.Approvals(f"{tmp_path}/approvals.json")
    assert custom.check_authorization(store, pack, token.id, "paper", base) == ("requires_approval", ["APPROVAL_MISSING"])
    for allow, ack in (("other", True), (token.id, False)):
        with pytest.raises(PermissionError, match="NOT_CONFIRMED"):
            custom.approve(store, pack, token.id, "paper", allow, ack, base)
    custom.approve(store, pack, token.id, "paper", token.id, True, base)
    assert custom.check_authorization(store, pack, token.id, "paper", base) == ("authorized", [])
    assert custom.check_authorization(store, pack, token.id, "guarded", base)[0] == "requires_approval"
    grant = custom.issue_grant(store, pack, token.id, "run 1", "paper", base)
    rows = spark.createDataFrame([(k, i, float(i + k)) for k in (1, 2) for i in (2, 0, 1)], "key long, ts long, x double")
    out = custom.execute(rows, pack, token.id, grant, "run 1", {"series": "x"}, ["key"], ["ts"], {"alpha": 0.5}, base)
    assert [tuple(r) for r in out.orderBy("key", "ts").collect()] == [(1, 0, 1.0), (1, 1, 1.5), (1, 2, 2.25), (2, 0, 2.0), (2, 1, 2.5), (2, 2, 3.25)]
    with pytest.raises(PermissionError, match="ANOTHER_RUN"):
        custom.check_grant(grant, pack, token.id, "run 2", base)
    with pytest.raises(PermissionError, match="EXPIRED"):
        custom.check_grant(grant, pack, token.id, "run 1", base, now=grant.expires + 1)
    with pytest.raises(ValueError, match="INPUT_PORTS"):
        custom.execute(rows, pack, token.id, grant, "run 1", {"other": "x"}, ["key"], ["ts"], {"alpha": 0.5}, base)
    wrong = packs.Pack("example", "1", (packs.Token(**{**token.__dict__, "outputs": {"else": port}}),), implementation=pack.implementation)
    custom.approve(store, wrong, token.id, "paper", token.id, True, base)
    with pytest.raises(PySparkException, match="CUSTOM_OUTPUT_PORTS_DIFFER"):
        custom.execute(rows, wrong, token.id, custom.issue_grant(store, wrong, token.id, "r", "paper", base), "r", {"series": "x"}, ["key"], ["ts"], {"alpha": 0.5}, base).collect()
    custom.approve(store, pack, token.id, "paper", token.id, True, base)
    (tmp_path / "src/code.py").write_text("x = 2\n")
    assert custom.check_authorization(store, pack, token.id, "paper", base) == ("requires_approval", ["APPROVAL_BEHAVIOUR_DIFFERS", "APPROVAL_IMPLEMENTATION_DIFFERS"])
    with pytest.raises(PermissionError, match="HASHES_DIFFER"):
        custom.check_grant(grant, pack, token.id, "run 1", base)
    declared = packs.Pack("example", "1", (token,), implementation=pack.implementation, hashes={token.id: {"implementation": "sha256:0"}})
    assert custom.check_authorization(store, declared, token.id, "paper", base) == ("denied", ["INTEGRITY_IMPLEMENTATION_DIFFERS"])
    assert custom.verify_integrity(packs.Pack("example", "1", (token,), implementation={"kind": "wheel", "path": "no.whl"}), token.id, base) == ["IMPLEMENTATION_MISSING: no.whl"]
    assert store.revoke(token.id) == 1 and store.find(token.id, "paper") is None
    assert os.listdir(tmp_path) and custom.implementation_hash({"kind": "installed_distribution", "name": "numpy"}) != custom.implementation_hash({})
    assert set(custom.audit_record(grant, "issued")) == {"event", "at", "token", "run_id", "profile", "id"}
    for found, code in (({"filtered": [1.0]}, "LENGTH"), ({"filtered": [True, 1.0]}, "TYPE"), ([], "PORTS")):
        with pytest.raises(ValueError, match=code):
            custom.checked_outputs(found, token.outputs, 2)


WORKFLOW = """
task:
  model: {class: LGBModel, module_path: m.gbdt, kwargs: {loss: mse}}
  dataset:
    class: DatasetH
    kwargs:
      handler: {class: Alpha158, kwargs: {learn_processors: [{class: DropnaLabel}, {class: OwnProcessor}]}}
      segments: {train: [2010-01-01, 2012-01-01]}
  record:
    - {class: SignalRecord}
    - {class: PortAnaRecord, kwargs: {config: {strategy: {class: TopkDropoutStrategy, kwargs: {topk: 5}}, backtest: {account: 100}}}}
"""


def test_workflows(tmp_path):
    from sparkstrat.records import workflows

    (tmp_path / "flow.yaml").write_text(WORKFLOW)
    found = workflows.import_file(str(tmp_path / "flow.yaml"))
    assert [n["id"] for n in found["strategy"]["nodes"]] == ["dataset", "model", "record_1", "record_2", "strategy", "backtest_config"]
    assert found["metadata"]["classification"] == "partially_supported" and found["metadata"]["unsupported"] == [{"kind": "custom_processor", "name": "OwnProcessor"}]
    assert "feature.alpha158_record" in found["metadata"]["tokens"] and graphs.from_mapping(found).node("backtest_config").inputs == {"strategy": "strategy.record"}
    assert workflows.import_workflow({})["metadata"]["classification"] == "non_goal"
    assert workflows.import_workflow({"model": {"class": "MyModel"}})["metadata"]["unsupported"] == [{"kind": "custom_model", "name": "MyModel"}]
    assert workflows.import_workflow({"model": {"class": "XGBModel"}})["metadata"]["classification"] == "supported"


def test_coverage(spark, tmp_path):
    from sparkstrat.records import coverage

    row = lambda i, c, w, **more: {"id": i, "expected_classification": c, "market_weight": {"final": w}, **more}
    matrix = {"coverage_policy": {"custom_token_discount": {"value": 0.25}}, "patterns": [
        row("a", "supported", 6, false_supported={"mechanical_status": "pass", "semantic_status": "fail"}), row("b", "supported", 2), row("c", "custom_token_required", 4, gaps={"missing_tokens": ["x", "y"]}),
        row("d", "partially_supported", 3, gaps={"missing_tokens": ["x"], "kernel_gaps": ["k"]}), row("e", "non_goal", 5), row("f", "supported", 9, benchmark_group="dogfood"), row("g", "supported", 9, status="retired"),
    ]}
    (tmp_path / "m.yaml").write_text(json.dumps(matrix))
    patterns, discount = coverage.read_matrix(spark, str(tmp_path / "m.yaml"))
    assert {r.classification: (r.patterns, r.weight) for r in coverage.by_class(patterns).collect()} == {"supported": (2, 8), "custom_token_required": (1, 4), "partially_supported": (1, 3), "non_goal": (1, 5)}
    found = coverage.metrics(patterns, discount).first().asDict()
    assert found == {
        "frontier_patterns": 5, "total_weight": 20, "direct_builtin_coverage": 0.3, "routable_record_coverage_raw": 0.75, "routable_record_coverage_discounted": 0.6, "custom_token_route_share": 0.2667,
        "false_supported_rate_mechanical": 0.0, "false_supported_rate_semantic": 0.5, "false_supported_rate_boundary": 0.0, "kernel_gap_count": 1, "token_bloat_index": 0.4,
    }
    assert coverage.metrics(patterns.limit(0)).first().total_weight == 0
