"""Strategy graphs as one plan: series nodes are columns over a key's ordered rows, panel nodes are frames.

Nothing runs while a graph is compiled, so Catalyst sees the whole of it and shares windows of nodes with the same partitioning.
"""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import REGISTRY, folds, series
from ..operators.decisions import ACROSS, across
from ..records.graphs import EXTERNAL, Graph, Node, ordered

#: The columns that operators of one output name it after; others have one column for each output.
ALIASES = {"span": "window", "periods": "periods"}


def _params(node: Node) -> dict:
    out = {ALIASES.get(k, k): v for k, v in node.params.items()}
    return {k: float(v) if isinstance(v, str) and v.replace(".", "", 1).lstrip("-").isdigit() else v for k, v in out.items()}


class Compiler:
    """keys and order of the rows; externals: by name, a frame (of panels and weights) or a constant, others are columns of the frame.

    custom: by token, a function of (frame, port to column, keys, order, params) that gives keys, order and outputs."""

    def __init__(self, graph: Graph, frame: DataFrame, keys: list[str], order: list[str], externals: dict | None = None, custom: dict | None = None):
        self.graph, self.frame, self.keys, self.order, self.externals, self.custom = graph, frame, keys, order, externals or {}, custom or {}
        self.values: dict[str, Column | DataFrame] = {}

    def value(self, source):
        """What an input refers to: a node's output, an external column or frame, or a constant."""
        if isinstance(source, list):
            return [self.value(s) for s in source]
        if isinstance(source, str) and source.startswith(EXTERNAL):
            name = source.removeprefix(EXTERNAL)
            if name in self.externals:
                found = self.externals[name]
                return found if isinstance(found, (DataFrame, Column)) else F.lit(found)
            return F.col(name.rpartition(".")[2])
        if isinstance(source, str) and source.partition(".")[0] in {n.id for n in self.graph.nodes}:
            name, _, output = source.partition(".")
            found = self.values[name]
            if isinstance(found, dict):
                return found.get(output, found.get("value", next(iter(found.values()))))
            return found
        return F.lit(source)

    def column(self, name: str, made: Column | dict) -> None:
        """Outputs of a series node as columns of the frame."""
        many = made if isinstance(made, dict) else {"value": made}
        self.frame = self.frame.select("*", *[v.alias(f"{name}.{k}") for k, v in many.items()])
        self.values[name] = {k: F.col(f"`{name}.{k}`") for k in many}

    def joined(self, name: str, found: DataFrame) -> None:
        """The outputs of a frame by keys and order as columns."""
        outputs = [c for c in found.columns if c not in (*self.keys, *self.order)]
        named = found.select(*self.keys, *self.order, *[F.col(f"`{c}`").alias(f"{name}.{c}") for c in outputs])
        self.frame = self.frame.join(named, [*self.keys, *self.order], "left")
        self.values[name] = {c: F.col(f"`{name}.{c}`") for c in outputs}

    def node(self, node: Node) -> None:
        given, params = [self.value(s) for s in node.inputs.values()], _params(node)
        if node.token in self.custom:
            ports = {p: f"_{node.id}_{p}" for p in node.inputs}
            base = self.frame.select("*", *[v.alias(ports[p]) for p, v in zip(node.inputs, given, strict=True)])
            self.joined(node.id, self.custom[node.token](base, ports, self.keys, self.order, params))
            return
        if node.token not in REGISTRY:
            raise ValueError(f"TOKEN_UNKNOWN: {node.token}")
        kind, build = REGISTRY[node.token]
        if kind == "metadata":  # it only describes what it is given
            if len(given) != 1:
                raise ValueError(f"TOKEN_METADATA_ONLY: {node.token}")
            self.values[node.id] = given[0]
            return
        if kind == "ordered" and "decision" in node.inputs:
            raise ValueError(f"GRAPH_TOKEN_NOT_COMPILED: {node.token} over decisions")
        accepted = inspect.signature(folds.FOLDS[node.token][0] if kind == "fold" else build).parameters
        params = {k: v for k, v in params.items() if k in accepted or any(p.kind is p.VAR_KEYWORD for p in accepted.values())}
        if kind == "group" and node.token in ACROSS:
            self.column(node.id, across(node.token, [d for g in given for d in (g if isinstance(g, list) else [g])]))
            return
        if kind in ("panel", "weights"):
            if not all(isinstance(g, DataFrame) for g in given):
                raise ValueError(f"GRAPH_INPUT_NOT_A_PANEL: {node.id}")
            self.values[node.id] = build(*given, **params)
        elif kind == "fold":
            column = f"_{node.id}"
            base = self.frame.withColumn(column, given[0])
            self.joined(node.id, folds.fold(base, node.token, self.keys, self.order, column, **params))
        elif kind == "ordered":
            self.column(node.id, build(series.ordered(self.keys, self.order), *given, **params))
        elif kind == "row":
            self.column(node.id, build(*given, **params))
        else:
            raise ValueError(f"GRAPH_TOKEN_NOT_COMPILED: {node.token}")

    def run(self) -> DataFrame:
        for node in ordered(self.graph):
            self.node(node)
        outs = {name: self.value(source) for name, source in self.graph.outputs.items()}
        frames = [v for v in outs.values() if isinstance(v, DataFrame)]
        if frames:
            if len(outs) > 1:
                raise ValueError("GRAPH_OUTPUTS_OF_PANELS: one at a time")
            return frames[0]
        return self.frame.select(*self.keys, *self.order, *[v.alias(k) for k, v in outs.items()])


def compile_graph(graph: Graph, frame: DataFrame, keys: list[str], order: list[str], externals: dict | None = None, custom: dict | None = None) -> DataFrame:
    """The outputs of a graph: for series, a row for each row of ``frame``; for panels, the output's frame."""
    return Compiler(graph, frame, keys, order, externals, custom).run()
