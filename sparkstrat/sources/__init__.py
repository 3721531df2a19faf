"""Typed frames and their formats."""

from .frames import KINDS, SCHEMAS, canonical, digest, frame_hash, require, version_of, violations
from .formats import from_arrow, from_pandas, read_csv, read_json, read_parquet, to_arrow, to_pandas, write_csv, write_json, write_parquet

__all__ = [
    "KINDS", "SCHEMAS", "canonical", "digest", "frame_hash", "require", "version_of", "violations", "from_arrow", "from_pandas", "read_csv",
    "read_json", "read_parquet", "to_arrow", "to_pandas", "write_csv", "write_json", "write_parquet",
]
