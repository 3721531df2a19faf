"""Typed frames: market bars, signals, features and trace logs as DataFrames with a fixed schema.

A frame is checked by ``violations``, which is lazy and distributed: a row for each broken rule. Numbers are decimals; timestamps
are instants (Spark's session zone only shows them). Order is a matter of writing, not of the frame: ``canonical`` sorts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..records.canonical import canonical_json

NUMBER = "decimal(38,18)"
SCHEMAS = {
    "market": f"timestamp timestamp, symbol string, open {NUMBER}, high {NUMBER}, low {NUMBER}, close {NUMBER}, volume {NUMBER}",
    "signal": f"timestamp timestamp, symbol string, signal string, size {NUMBER}",
    "feature": f"timestamp timestamp, symbol string, features map<string,{NUMBER}>",
    "trace": "timestamp timestamp, node_id string, event string, payload_json string",
}
KINDS = tuple(SCHEMAS)
#: The name of a kind in a frame's version, and the key of its rows in a JSON document.
VERSION_NAMES = {"market": "market-frame/1", "signal": "signal-frame/1", "feature": "feature-frame/1", "trace": "trace-log/1"}
ROWS = {"market": "bars", "signal": "rows", "feature": "rows", "trace": "events"}
SYMBOL = "^[A-Z0-9]+/[A-Z0-9]+$"
SIGNALS = ("long", "short", "flat")


def columns(kind: str) -> list[str]:
    return [part.split()[0] for part in SCHEMAS[kind].replace("map<string,decimal(38,18)>", "map").replace("decimal(38,18)", "decimal").split(", ")]


def version_of(kind: str, namespace: str = "frame") -> str:
    """A frame's version, such as frame-market-frame/1."""
    if kind not in KINDS:
        raise ValueError("FRAME_KIND_UNKNOWN")
    return f"{namespace}-{VERSION_NAMES[kind]}"


def kind_of(version: str | None) -> str:
    """The kind that a version names, whatever its namespace."""
    for kind, name in VERSION_NAMES.items():
        if version is not None and version.endswith(f"-{name}"):
            return kind
    raise ValueError(f"FRAME_VERSION_UNSUPPORTED: {version!r}")


def _broken(kind: str) -> Column:
    """The codes of the rules that a row breaks by itself."""
    bad = {"FRAME_TIMESTAMP_MISSING": F.col("timestamp").isNull()}
    if kind != "trace":
        bad["FRAME_SYMBOL_INVALID"] = ~F.coalesce(F.col("symbol").rlike(SYMBOL), F.lit(False))
    if kind == "market":
        bad["FRAME_FIELD_MISSING"] = F.greatest(*[F.col(c).isNull() for c in ("open", "high", "low", "close", "volume")])
    if kind == "signal":
        bad |= {"FRAME_SIGNAL_INVALID": ~F.coalesce(F.col("signal").isin(*SIGNALS), F.lit(False)), "FRAME_FIELD_MISSING": F.col("size").isNull()}
    if kind == "feature":
        bad["FRAME_FIELD_MISSING"] = F.exists(F.map_values(F.coalesce("features", F.create_map().cast(f"map<string,{NUMBER}>"))), lambda v: v.isNull())
    if kind == "trace":
        bad["FRAME_FIELD_MISSING"] = F.col("node_id").isNull() | F.col("event").isNull() | F.col("payload_json").isNull()
    return F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in bad.items()]), lambda c: c.isNotNull())


def violations(frame: DataFrame, kind: str, symbols: list[str] | None = None) -> DataFrame:
    """(code, timestamp, symbol, n) of what is wrong: broken rows; keys that occur n times; for bars of several symbols, timestamps that
    lack n of them. symbols: those the frame declares, besides those it has rows for.

    The grid is checked by counts, so it is never laid out."""
    name = F.col("symbol") if kind != "trace" else F.col("node_id")
    out = frame.select(F.explode(_broken(kind)).alias("code"), "timestamp", name.alias("symbol"), F.lit(1).cast("long").alias("n"))
    if kind == "trace":
        return out
    counts = frame.groupBy("timestamp", "symbol").agg(F.count("*").alias("n"))
    out = out.unionByName(counts.where("n > 1").select(F.lit("FRAME_DUPLICATE_ROW").alias("code"), "timestamp", "symbol", "n"))
    if kind == "market":
        known = counts.select("symbol").distinct()
        if symbols:
            known = known.union(frame.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")).distinct()
        wanted = known.agg(F.count("*").alias("wanted"))
        held = counts.groupBy("timestamp").agg(F.count("*").alias("held")).join(F.broadcast(wanted))  # one row on that side
        gaps = held.where("wanted > 1 and held < wanted")
        out = out.unionByName(gaps.select(F.lit("FRAME_ALIGNMENT_MISSING").alias("code"), "timestamp", F.lit(None).cast("string").alias("symbol"), (F.col("wanted") - F.col("held")).alias("n")))
    return out


def require(frame: DataFrame, kind: str, symbols: list[str] | None = None) -> DataFrame:
    """``frame`` if nothing is wrong with it; else an error that shows five cases."""
    found = violations(frame, kind, symbols).orderBy("code", "timestamp", "symbol").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.code} {r.timestamp} {r.symbol} ({r.n})" for r in found))
    return frame


def canonical(frame: DataFrame, kind: str) -> DataFrame:
    """The rows in canonical order, features by name."""
    order = ["timestamp", "node_id", "event", "payload_json"] if kind == "trace" else ["timestamp", "symbol"]
    if kind == "feature":
        frame = frame.withColumn("features", F.map_from_entries(F.array_sort(F.map_entries("features"))))
    return frame.select(*columns(kind)).orderBy(*order)


def plain_number(x: Column) -> Column:
    """A decimal's canonical string: no exponent, no trailing zeros, no minus zero."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%s", x.cast(NUMBER).cast("string")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, F.lit("0")).otherwise(F.when(F.instr(text, "E") > 0, F.lit("0")).otherwise(text))


def zulu(ts: Column) -> Column:
    """An instant as ISO 8601 in UTC, with microseconds where there are any."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(utc, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def texts(frame: DataFrame, kind: str) -> DataFrame:
    """The rows with timestamps and numbers as canonical strings."""
    out = frame.withColumn("timestamp", zulu(F.col("timestamp")))
    for c in {"market": ("open", "high", "low", "close", "volume"), "signal": ("size",)}.get(kind, ()):
        out = out.withColumn(c, plain_number(F.col(c)))
    if kind == "feature":
        out = out.withColumn("features", F.transform_values("features", lambda _, v: plain_number(v)))
    return out.select(*columns(kind))


def digest(frame: DataFrame, kind: str) -> DataFrame:
    """One row: rows, and the sum of the rows' SHA-256 in four parts, which tells two tables apart whatever their order and size."""
    row = F.sha2(F.to_json(F.struct(*texts(frame, kind).columns)), 256)
    hashed = texts(frame, kind).select(row.alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"part{i}") for i in range(4)]
    return hashed.agg(F.count("*").alias("rows"), *parts)


def document(frame: DataFrame, kind: str, namespace: str = "frame", symbols: list[str] | None = None, max_rows: int = 100_000) -> dict:
    """A small frame as one JSON document; more rows than ``max_rows`` are an error, as this is the driver's memory."""
    import json

    rows = texts(canonical(frame, kind), kind).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("FRAME_TOO_LARGE_FOR_A_DOCUMENT")
    found = [r.asDict(recursive=True) for r in rows]
    if kind == "trace":
        found = [{**{k: v for k, v in r.items() if k != "payload_json"}, "payload": json.loads(r["payload_json"])} for r in found]
    out = {"frame_version": version_of(kind, namespace), ROWS[kind]: found}
    if kind != "trace":
        out["symbols"] = sorted({r["symbol"] for r in found} | set(symbols or ()))
    return out


def frame_hash(frame: DataFrame, kind: str, namespace: str = "frame", max_rows: int = 100_000) -> str:
    """SHA-256 of a small frame's document."""
    return f"sha256:{hashlib.sha256(canonical_json(document(frame, kind, namespace, max_rows=max_rows))).hexdigest()}"
