"""Ordered recursions, for which Spark has no built-in: a machine for each key takes the key's rows in order, batch by batch.

Rows are dealt by key and sorted within partitions, and a partition is one stream of Arrow batches, so a worker holds one batch and one
machine's state, however many rows a key has. The linear recursions run in compiled code; only the columns that they need travel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import ordered, true_range


class Smooth:
    """y = alpha * x + (1 - alpha) * y, from the first value on."""

    def __init__(self, alpha: float):
        self.alpha, self.y = alpha, None

    def feed(self, x: np.ndarray) -> np.ndarray:
        import pandas as pd

        if not len(x):
            return x
        known = [] if self.y is None else [self.y]
        out = pd.Series(np.concatenate([known, x])).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[len(known) :] if self.alpha < 1 else x
        self.y = float(out[-1])
        return out


class Wilder:
    """The mean of the first n, then (y * (n - 1) + x) / n; NaN before that."""

    def __init__(self, n: int):
        self.n, self.first, self.smooth = n, np.zeros(0), Smooth(1 / n)

    def feed(self, x: np.ndarray) -> np.ndarray:
        if self.smooth.y is not None:
            return self.smooth.feed(x)
        held, before = np.concatenate([self.first, x]), len(self.first)
        if len(held) < self.n:
            self.first = held
            return np.full(len(x), np.nan)
        self.smooth.y, self.first = float(held[: self.n].mean()), np.zeros(0)
        rest = np.concatenate([[self.smooth.y], self.smooth.feed(held[self.n :])])
        return np.concatenate([np.full(self.n - 1 - before, np.nan), rest])


class Value:
    """A machine of one recursion and one output."""

    def __init__(self, inner):
        self.inner = inner

    def feed(self, x):
        return {"value": self.inner.feed(np.asarray(x, float))}


def linear_recursive(alpha=0.5):
    if not 0 < alpha <= 1:
        raise ValueError("SMOOTH_ALPHA_INVALID")
    return Value(Smooth(alpha))


def ema(window):
    return Value(Smooth(2 / (window + 1)))


class Rsi:
    def __init__(self, window: int):
        self.gain, self.loss, self.last = Wilder(window), Wilder(window), None

    def feed(self, x):
        x = np.asarray(x, float)
        change = np.diff(x, prepend=x[:1] if self.last is None else [self.last])
        skip = int(self.last is None)  # the first value has no change
        self.last = float(x[-1])
        up, down = self.gain.feed(np.maximum(change[skip:], 0.0)), self.loss.feed(np.maximum(-change[skip:], 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where((up == 0) & (down == 0), 50.0, np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)))
        return {"value": np.concatenate([np.full(skip, np.nan), np.where(np.isnan(up), np.nan, out)])}


class Macd:
    def __init__(self, fast=12, slow=26, signal=9):
        if not 0 < fast < slow:
            raise ValueError("MACD_WINDOWS_INVALID")
        self.fast, self.slow, self.signal = (Smooth(2 / (n + 1)) for n in (fast, slow, signal))

    def feed(self, x):
        x = np.asarray(x, float)
        line = self.fast.feed(x) - self.slow.feed(x)
        mean = self.signal.feed(line)
        return {"macd": line, "signal": mean, "histogram": line - mean}


def atr(window):
    """Wilder's mean of true ranges; the first row's is its high less its low."""
    return Value(Wilder(window))


FSM_POLICIES = ("raise", "stay", "transition_to_unknown")


class Fsm:
    """One state for each event, with a code where an event is unknown or a transition missing: the machine then stays, or goes to
    ``unknown``; under ``raise`` it stays as well, and ``check`` makes the codes an error."""

    def __init__(self, states, events, initial_state, transitions, failure_policy="stay"):
        self.table = {(t["from"], t["event"]): t["to"] for t in transitions}
        self.events, self.state, self.lost = set(events), initial_state, failure_policy == "transition_to_unknown"
        if failure_policy not in FSM_POLICIES or initial_state not in states or any(a not in states or e not in events or b not in states for (a, e), b in self.table.items()):
            raise ValueError("FSM_DEFINITION_INVALID")

    def feed(self, x):
        state, out, codes = self.state, [], []
        for event in x:
            after = self.table.get((state, event))
            code = None if after is not None else "FSM_TRANSITION_MISSING" if event in self.events else "FSM_UNKNOWN_EVENT"
            state = after if code is None else "unknown" if self.lost else state
            out.append(state)
            codes.append(code)
        self.state = state
        return {"value": out, "diagnostic": codes}


def check(machine: DataFrame, column: str = "value", diagnostic: str = "diagnostic") -> DataFrame:
    """The result of a machine whose failures are errors."""
    failed = F.col(diagnostic).isNotNull()
    return machine.withColumn(column, F.when(failed, F.raise_error(F.col(diagnostic))).otherwise(F.col(column)))


def replay(frame: DataFrame, trace: DataFrame, keys: list[str], order: list[str], column: str, state: str = "value", **definition) -> DataFrame:
    """Keys whose trace (keys, order, state) is not what the machine gives for ``frame`` now, with the number of rows that differ."""
    again = fold(frame, "core.state.fsm", keys, order, column, prefix="_", **definition).select(*keys, *order, F.col("_value"))
    both = again.join(trace.select(*keys, *order, F.col(state).alias("_traced")), [*keys, *order], "full")
    return both.where(~F.col("_value").eqNullSafe(F.col("_traced"))).groupBy(*keys).agg(F.count("*").alias("differ"))


FOLDS = {
    "core.smooth.linear_recursive": (linear_recursive, {"value": "double"}),
    "core.indicator.ema": (ema, {"value": "double"}),
    "core.indicator.rsi": (Rsi, {"value": "double"}),
    "core.indicator.macd": (Macd, {"macd": "double", "signal": "double", "histogram": "double"}),
    "core.indicator.atr": (atr, {"value": "double"}),
    "core.state.fsm": (Fsm, {"value": "string", "diagnostic": "string"}),
}


def fold(frame: DataFrame, token: str, keys: list[str], order: list[str], column: str, prefix: str = "", **params) -> DataFrame:
    """``frame``'s keys, order and the outputs of a recursion over ``column`` (rows where it is null are left out)."""
    build, outputs = FOLDS[token]
    build(**params)  # wrong parameters are an error here, not on the executors
    needed, named = list(dict.fromkeys([*keys, *order, column])), list(dict.fromkeys([*keys, *order]))
    kinds = dict(frame.select(*needed).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in named), *(f"`{prefix}{c}` {t}" for c, t in outputs.items())])

    def run(batches):
        import pyarrow as pa

        at, machine = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            starts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            values = batch.column(column).to_numpy(zero_copy_only=False) if kinds[column] != "string" else batch.column(column).to_pylist()
            found: dict[str, list] = {c: [] for c in outputs}
            for a, b in zip(starts, starts[1:], strict=False):
                if machine is None or own[a] != at:
                    at, machine = own[a], build(**params)
                for c, v in machine.feed(values[a:b]).items():
                    found[c].append(v)
            made = [pa.array(np.concatenate(v), pa.float64(), from_pandas=True) if outputs[c] == "double" else pa.array([x for part in v for x in part], pa.string()) for c, v in found.items()]
            yield pa.record_batch([*(batch.column(c) for c in named), *made], names=[*named, *(prefix + c for c in outputs)])

    rows = frame.select(*needed).where(F.col(f"`{column}`").isNotNull())
    return rows.repartition(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{c}`") for c in named]).mapInArrow(run, schema)


def atr_frame(frame: DataFrame, keys: list[str], order: list[str], window: int, high="high", low="low", close="close") -> DataFrame:
    ranged = frame.withColumn("_range", true_range(ordered(keys, order), F.col(high), F.col(low), F.col(close)))
    return fold(ranged, "core.indicator.atr", keys, order, "_range", window=window)
