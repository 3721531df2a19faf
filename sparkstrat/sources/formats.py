"""Frames from and to CSV, JSON, Parquet, Arrow and pandas.

CSV, JSON lines and Parquet are read and written by Spark in parallel, as folders of parts; a JSON document, Arrow tables and pandas
frames are for small frames. Readers return checked schemas; ``frames.require`` checks the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import NUMBER, ROWS, SCHEMAS, canonical, columns, document, kind_of, texts, version_of

VERSION_KEY = "frame_version"


def _typed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of strings as the frame's types; a text that is no number or instant is an error, and a missing column as well."""
    missing = [c for c in columns(kind) if c not in rows.columns]
    if missing:
        raise ValueError(f"FRAME_COLUMN_MISSING: {', '.join(missing)}")
    kinds = {"timestamp": "timestamp", **{c: NUMBER for c in ("open", "high", "low", "close", "volume", "size")}, "features": f"map<string,{NUMBER}>"}
    return rows.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in columns(kind)])


def write_csv(frame: DataFrame, kind: str, path: str) -> None:
    """With a header; features are a column for each name, blank where a row lacks it."""
    rows = texts(frame, kind)
    if kind == "feature":
        names = sorted(r.name for r in rows.select(F.explode(F.map_keys("features")).alias("name")).distinct().collect())  # the columns of the file
        rows = rows.select("timestamp", "symbol", *[F.col("features")[n].alias(n) for n in names])
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """All columns of the header are required; blank features are no features."""
    rows = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    if not rows.columns:
        raise ValueError("FRAME_HEADER_MISSING")
    if kind == "feature":
        names = [c for c in rows.columns if c not in ("timestamp", "symbol")]
        pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").alias("v")) for n in names]), lambda p: p["v"].isNotNull() & (p["v"] != "")) if names else None
        rows = rows.withColumn("features", F.map_from_entries(pairs) if names else F.create_map().cast("map<string,string>"))
    return _typed(rows, kind)


def write_json(frame: DataFrame, kind: str, path: str, lines: bool = True, namespace: str = "frame", symbols: list[str] | None = None) -> None:
    """lines: a folder of JSON lines; else one canonical document, of a small frame, as a single file of text."""
    if lines:
        texts(frame, kind).withColumn(VERSION_KEY, F.lit(version_of(kind, namespace))).write.mode("errorifexists").json(path)
        return
    from ..records.canonical import canonical_json

    body = canonical_json(document(frame, kind, namespace, symbols)).decode()
    frame.sparkSession.createDataFrame([(body,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_json(spark: SparkSession, path: str, lines: bool = True) -> tuple[str, DataFrame]:
    """(kind, frame); the kind is that of the frame's version, and an unknown version is an error."""
    rows = spark.read.text(path)
    version = F.get_json_object("value", f"$.{VERSION_KEY}")
    found = [r[0] for r in rows.select(version).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("FRAME_VERSION_MISSING" if not found else "FRAME_VERSIONS_DIFFER")
    kind = kind_of(found[0])
    plain = SCHEMAS[kind].replace(NUMBER, "string").replace("timestamp timestamp", "timestamp string")
    if lines:
        return kind, _typed(rows.select(F.from_json("value", plain, {"mode": "FAILFAST"}).alias("r")).select("r.*"), kind)
    if kind == "trace":
        each = F.from_json("value", "struct<events:array<struct<timestamp:string,node_id:string,event:string,payload:string>>>", {"mode": "FAILFAST"})
        out = rows.select(F.explode(each["events"]).alias("r")).select("r.timestamp", "r.node_id", "r.event", F.col("r.payload").alias("payload_json"))
    else:
        fields = ",".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in plain.split(", "))
        each = F.from_json("value", f"struct<{ROWS[kind]}:array<struct<{fields}>>>", {"mode": "FAILFAST"})
        out = rows.select(F.explode(each[ROWS[kind]]).alias("r")).select("r.*")
    return kind, _typed(out, kind)


def write_parquet(frame: DataFrame, kind: str, path: str) -> None:
    frame.select(*columns(kind)).write.mode("errorifexists").parquet(path)


def read_parquet(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return _typed(spark.read.parquet(path), kind)


def to_pandas(frame: DataFrame, kind: str):
    """A small frame in canonical order; numbers stay canonical strings, of dtype object."""
    return texts(canonical(frame, kind), kind).toPandas().astype(object)


def from_pandas(spark: SparkSession, pdf, kind: str) -> DataFrame:
    rows = [{k: v for k, v in r.items()} for r in pdf.to_dict("records")]
    plain = SCHEMAS[kind].replace(NUMBER, "string").replace("timestamp timestamp", "timestamp string")
    missing = [c for c in columns(kind) if c not in pdf.columns]
    if missing:
        raise ValueError(f"FRAME_COLUMN_MISSING: {', '.join(missing)}")
    text = lambda v: None if v is None or v != v else v if isinstance(v, dict) else str(v)
    return _typed(spark.createDataFrame([tuple(text(r[c]) for c in columns(kind)) for r in rows], plain), kind)


def to_arrow(frame: DataFrame, kind: str, namespace: str = "frame"):
    """A small frame as an Arrow table that names its version in the schema's metadata."""
    return texts(canonical(frame, kind), kind).toArrow().replace_schema_metadata({VERSION_KEY: version_of(kind, namespace)})


def from_arrow(spark: SparkSession, table) -> tuple[str, DataFrame]:
    version = (table.schema.metadata or {}).get(VERSION_KEY.encode())
    if version is None:
        raise ValueError("FRAME_VERSION_MISSING")
    kind = kind_of(version.decode())
    return kind, _typed(spark.createDataFrame(table.replace_schema_metadata(None)), kind)
