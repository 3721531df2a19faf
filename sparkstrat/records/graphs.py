"""Strategy graphs: loading, canonical form, hashes, validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ..operators import REGISTRY, canonical
from .canonical import canonical_json, record_hash

#: What a graph may declare, and what needs what.
CAPABILITIES = ("core", "panel_type", "panel_ops", "panel_weights", "custom_token_runtime")
PROFILES = ("research", "paper", "pretrade", "guarded")
EXTERNAL = "$externals."


@dataclass(frozen=True)
class Diagnostic:
    code: str
    severity: str
    message: str
    node: str | None = None


@dataclass(frozen=True)
class Node:
    id: str
    token: str
    version: str = "1"
    inputs: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    signature: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Graph:
    id: str
    version: str
    nodes: tuple[Node, ...]
    outputs: dict
    capabilities: tuple[str, ...] = ("core",)
    versions: tuple[str, str] = ("", "")
    metadata: dict = field(default_factory=dict)

    def node(self, name: str) -> Node:
        return next(n for n in self.nodes if n.id == name)


def _node(raw: dict) -> Node:
    ref = raw.get("token_ref")
    token, version = (f"{ref['namespace']}.{ref['name']}", str(ref.get("version", 1))) if isinstance(ref, dict) else (raw.get("token"), str(raw.get("version", "1")))
    if not isinstance(raw.get("id"), str) or not isinstance(token, str):
        raise ValueError("GRAPH_NODE_INVALID")
    fields = {k: raw.get(k) or {} for k in ("inputs", "params", "signature", "metadata")}
    if not all(isinstance(v, dict) for v in fields.values()):
        raise ValueError("GRAPH_NODE_INVALID")
    return Node(raw["id"], canonical(token) if canonical(token) in REGISTRY else token, version, **fields)


def from_mapping(raw: dict) -> Graph:
    if not isinstance(raw, dict) or not isinstance(raw.get("strategy"), dict):
        raise ValueError("GRAPH_INVALID")
    body = raw["strategy"]
    nodes = tuple(_node(n) for n in body.get("nodes") or ())
    names = [n.id for n in nodes]
    if not isinstance(body.get("id"), str) or len(set(names)) < len(names):
        raise ValueError("GRAPH_INVALID" if len(set(names)) == len(names) else "GRAPH_NODE_DUPLICATE")
    return Graph(body["id"], str(body.get("version", 1)), nodes, body.get("outputs") or {}, tuple(raw.get("capabilities") or ("core",)), (str(raw.get("ir_version", "")), str(raw.get("canonical_version", ""))), raw.get("metadata") or {})


def loads(text: str) -> Graph:
    """A graph from YAML or JSON."""
    text = text.lstrip("﻿")
    try:
        return from_mapping(json.loads(text))
    except json.JSONDecodeError:
        import yaml

        return from_mapping(yaml.safe_load(text))


def load(path: str) -> Graph:
    return loads(Path(path).read_text(encoding="utf-8"))


def canonical_mapping(graph: Graph) -> dict:
    """Nodes by id, everything plain JSON."""
    nodes = [{"id": n.id, "token": n.token, "version": n.version, "inputs": n.inputs, "params": n.params, "signature": n.signature, "metadata": n.metadata} for n in sorted(graph.nodes, key=lambda n: n.id)]
    strategy = {"id": graph.id, "version": graph.version, "nodes": nodes, "outputs": graph.outputs}
    return json.loads(canonical_json({"ir_version": graph.versions[0], "canonical_version": graph.versions[1], "capabilities": list(graph.capabilities), "strategy": strategy, "metadata": graph.metadata}))


def _part(graph: Graph, keys: tuple[str, ...], outputs: bool) -> dict:
    whole = canonical_mapping(graph)
    strategy = whole["strategy"]
    body = {"id": strategy["id"], "version": strategy["version"], "nodes": [{k: n[k] for k in keys} for n in strategy["nodes"]]}
    return {"ir_version": whole["ir_version"], "canonical_version": whole["canonical_version"], "strategy": body | ({"outputs": strategy["outputs"]} if outputs else {})}


def hashes(graph: Graph) -> dict[str, str]:
    """graph: the structure without params; param: the params alone; instance: both; signature: the declared ports."""
    found = {"graph": record_hash("graph", _part(graph, ("id", "token", "version", "inputs"), True)), "param": record_hash("param", _part(graph, ("id", "params"), False))}
    found["instance"] = record_hash("instance", {"graph_hash": found["graph"], "param_hash": found["param"]})
    found["signature"] = record_hash("signature", _part(graph, ("id", "signature"), False))
    return found


def references(node: Node) -> list[tuple[str, str, str]]:
    """(port, node, output) of the inputs that come from other nodes."""
    out = []
    for port, source in sorted(node.inputs.items()):
        for s in source if isinstance(source, list) else [source]:
            if isinstance(s, str) and not s.startswith("$"):
                name, _, output = s.partition(".")
                out.append((port, name, output))
    return out


def ordered(graph: Graph) -> list[Node]:
    """Nodes, each after those that it reads; a cycle is an error."""
    known = {n.id: n for n in graph.nodes}
    done: list[Node] = []
    state: dict[str, int] = {}
    for start in sorted(known):
        stack = [(start, False)]
        while stack:
            name, leave = stack.pop()
            if leave:
                state[name] = 2
                done.append(known[name])
            elif state.get(name) == 1:
                raise ValueError("GRAPH_CYCLE")
            elif name in known and name not in state:
                state[name] = 1
                stack.append((name, True))
                for _, other, _ in references(known[name]):
                    if state.get(other) == 1:
                        raise ValueError("GRAPH_CYCLE")
                    stack.append((other, False))
    return done


def unsafe_future(node: Node) -> bool:
    """A node that reads rows after its own: a negative shift, or a port that says so."""
    ports = [p for p in (node.signature.get("outputs") or {}).values() if isinstance(p, dict)]
    declared = any((p.get("port_temporal") or {}).get("unsafe_future") for p in ports)
    return bool(declared) or (node.token == "core.data.shift" and int(node.params.get("periods", 1)) < 0)


def temporal(graph: Graph, profile: str = "research") -> list[Diagnostic]:
    """Future data: a warning in research and on paper, an error before and in trade; whatever reads it is tainted as well."""
    severity = "warning" if profile in ("research", "paper") else "error"
    tainted: set[str] = set()
    out = []
    for node in ordered(graph):
        own = unsafe_future(node)
        if own or any(name in tainted for _, name, _ in references(node)):
            tainted.add(node.id)
            out.append(Diagnostic("TEMPORAL_UNSAFE_FUTURE", severity, "reads rows after its own" if own else "reads a node that does", node.id))
    return out


def panel_layer(graph: Graph) -> list[Diagnostic]:
    """Panel nodes need the panel capabilities, and weights must come from a selection, from weights or from outside."""
    out = []
    kinds = {n.id: REGISTRY[n.token][0] for n in graph.nodes if n.token in REGISTRY}
    for n in graph.nodes:
        kind = kinds.get(n.id)
        if kind == "panel" and not {"panel_type", "panel_ops"} <= set(graph.capabilities):
            out.append(Diagnostic("CAPABILITY_PANEL_OPS_MISSING", "error", "panel operators need panel_type and panel_ops", n.id))
        if kind == "weights" and not {"panel_type", "panel_weights"} <= set(graph.capabilities):
            out.append(Diagnostic("CAPABILITY_PANEL_WEIGHTS_MISSING", "error", "weight operators need panel_type and panel_weights", n.id))
        if kind == "weights" and any(port == "weights" and kinds.get(name) not in ("weights", None) for port, name, _ in references(n)):
            out.append(Diagnostic("WEIGHT_LINEAGE_INVALID", "error", "weights must come from weights", n.id))
    return out


def validate(graph: Graph, profile: str = "research", custom: tuple[str, ...] = ()) -> list[Diagnostic]:
    """Everything that is wrong with a graph; custom: tokens that a registered pack brings."""
    if profile not in PROFILES:
        raise ValueError("PROFILE_UNKNOWN")
    out = [Diagnostic("CAPABILITY_NOT_ACCEPTED", "error", f"{c} is not accepted") for c in graph.capabilities if c not in CAPABILITIES]
    for needs in ("panel_weights", "panel_ops"):
        if needs in graph.capabilities and "panel_type" not in graph.capabilities:
            out.append(Diagnostic(f"CAPABILITY_{needs.upper()}_REQUIRES_PANEL_TYPE", "error", f"{needs} needs panel_type"))
    known = {n.id for n in graph.nodes}
    for n in graph.nodes:
        if n.token not in REGISTRY and n.token not in custom:
            out.append(Diagnostic("TOKEN_UNKNOWN", "error", n.token, n.id))
        elif n.token in REGISTRY and REGISTRY[n.token][0] == "metadata":
            out.append(Diagnostic("TOKEN_METADATA_ONLY", "warning" if profile == "research" else "error", f"{n.token} can't be run", n.id))
        out += [Diagnostic("INPUT_UNRESOLVED", "error", f"{port}: {name}", n.id) for port, name, _ in references(n) if name not in known]
    out += [Diagnostic("OUTPUT_UNRESOLVED", "error", f"{k}: {v}") for k, v in graph.outputs.items() if isinstance(v, str) and v.partition(".")[0] not in known]
    try:
        return out + panel_layer(graph) + temporal(graph, profile)
    except ValueError as error:
        return [*out, Diagnostic(str(error), "error", "the nodes read one another in a circle")]
