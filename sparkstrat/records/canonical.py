"""Canonical JSON and the hashes of records."""

from __future__ import annotations

import hashlib
import json
import math
import re

MAX_DEPTH = 12
HASH = re.compile(r"sha256:[0-9a-f]{64}")


def _checked(value, depth: int):
    if depth > MAX_DEPTH:
        raise ValueError("CANONICAL_TOO_DEEP")
    match value:
        case None | bool() | int() | str():
            return value
        case float():
            if not math.isfinite(value):
                raise ValueError("CANONICAL_NONFINITE")
            return value
        case dict():
            if not all(isinstance(k, str) for k in value):
                raise TypeError("CANONICAL_KEY_NOT_A_STRING")
            return {k: _checked(v, depth + 1) for k, v in value.items()}
        case list():
            return [_checked(v, depth + 1) for v in value]
    raise TypeError(f"CANONICAL_TYPE_REJECTED: {type(value).__name__}")


def canonical_json(value) -> bytes:
    """UTF-8, keys sorted, no spaces; no tuples, bytes, NaN or infinity; at most ``MAX_DEPTH`` levels below the top."""
    return json.dumps(_checked(value, 0), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def record_hash(kind: str, payload) -> str:
    """The hash of a record of a kind: equal payloads of different kinds differ."""
    return f"sha256:{hashlib.sha256(canonical_json({'kind': kind, 'payload': payload})).hexdigest()}"


def is_hash(text) -> bool:
    return isinstance(text, str) and HASH.fullmatch(text) is not None


def audit_chain(records: list[dict], wall_clock: str = "at") -> list[str]:
    """The hash of each record with that of the one before it; when a record was made is not part of it."""
    out: list[str] = []
    for r in records:
        out.append(record_hash("audit", {"before": out[-1] if out else None, "record": {k: v for k, v in r.items() if k != wall_clock}}))
    return out
