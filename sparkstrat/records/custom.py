"""Custom tokens: integrity, approval, grants, and their execution on the executors.

A token's function takes a mapping of a key's inputs (lists in order) and parameters, and returns a mapping of its outputs (lists as
long as the inputs). Nothing is imported before a grant is checked.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import time
import uuid
import zipfile
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from .canonical import record_hash
from .packs import Pack, behaviour_hash, pack_hash, spec_hash

TTL = 900.0
IMPLEMENTATIONS = ("spec_only", "source_tree", "wheel", "sdist", "installed_distribution")
TYPES = {"float": "double", "int": "long", "bool": "boolean", "string": "string"}


def _files(root: Path) -> list[tuple[str, bytes]]:
    skip = ("__pycache__", ".git")
    found = [p for p in root.rglob("*") if p.is_file() and not any(part in skip for part in p.relative_to(root).parts) and p.suffix != ".pyc"]
    return sorted((p.relative_to(root).as_posix(), p.read_bytes()) for p in found)


def implementation_hash(ref: dict, base: str = ".") -> str:
    """The hash of a token's code, read and not imported.

    ref: {kind, path} of a source tree, wheel or sdist, {kind, name} of an installed distribution, or {kind: spec_only}."""
    kind = ref.get("kind", "spec_only")
    if kind not in IMPLEMENTATIONS:
        raise ValueError(f"IMPLEMENTATION_KIND_UNKNOWN: {kind}")
    if kind == "spec_only":
        return record_hash("implementation", {"kind": kind})
    if kind == "installed_distribution":
        from importlib.metadata import PackageNotFoundError, distribution

        try:
            found = distribution(ref["name"])
        except PackageNotFoundError as error:
            raise ValueError(f"IMPLEMENTATION_MISSING: {ref['name']}") from error
        files = sorted((str(f), f.hash.value if f.hash else "") for f in found.files or ())
        return record_hash("implementation", {"kind": kind, "name": ref["name"], "version": found.version, "files": [list(f) for f in files]})
    path = Path(base, ref["path"])
    if not path.exists():
        raise ValueError(f"IMPLEMENTATION_MISSING: {ref['path']}")
    if kind == "source_tree":
        held = _files(path)
    elif kind == "wheel":
        with zipfile.ZipFile(path) as file:
            held = sorted((n, file.read(n)) for n in file.namelist() if not n.endswith("/"))
    else:
        held = [(path.name, path.read_bytes())]
    return record_hash("implementation", {"kind": kind, "files": [[n, hashlib.sha256(b).hexdigest()] for n, b in held]})


def environment_hash() -> str:
    return record_hash("environment", {"python": list(sys.version_info[:2]), "implementation": sys.implementation.name})


def token_hashes(pack: Pack, token: str, base: str = ".") -> dict[str, str]:
    found = pack.token(token)
    code = implementation_hash(pack.implementation, base)
    return {"spec": spec_hash(found), "pack": pack_hash(pack), "implementation": code, "behaviour": behaviour_hash(found, code), "environment": environment_hash()}


def verify_integrity(pack: Pack, token: str, base: str = ".") -> list[str]:
    """Codes of what is not as the pack declares; nothing is imported. Hashes that it does not declare are not compared."""
    try:
        now = token_hashes(pack, token, base)
    except (KeyError, ValueError) as error:
        return [str(error.args[0])]
    out = [f"INTEGRITY_{k.upper()}_DIFFERS" for k, v in sorted((pack.hashes.get(token) or {}).items()) if k in now and now[k] != v]
    if pack.implementation.get("kind", "spec_only") != "spec_only" and not re.fullmatch(r"[A-Za-z_][\w.]*:[A-Za-z_]\w*", pack.token(token).entrypoint):
        out.append("INTEGRITY_ENTRYPOINT_INVALID")
    return out


class Approvals:
    """Approvals in a JSON file, written as a whole."""

    def __init__(self, path: str):
        self.path = Path(path)

    def all(self) -> list[dict]:
        return json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else []

    def _write(self, records: list[dict]) -> None:
        part = self.path.with_name(f"{self.path.name}.{uuid.uuid4().hex}")
        part.write_text(json.dumps(records, sort_keys=True, indent=1), encoding="utf-8")
        os.replace(part, self.path)

    def save(self, record: dict) -> None:
        self._write([r for r in self.all() if (r["token"], r["profile"]) != (record["token"], record["profile"])] + [record])

    def revoke(self, token: str, profile: str | None = None) -> int:
        kept = [r for r in self.all() if r["token"] != token or profile not in (None, r["profile"])]
        gone = len(self.all()) - len(kept)
        self._write(kept)
        return gone

    def find(self, token: str, profile: str) -> dict | None:
        return next((r for r in self.all() if (r["token"], r["profile"]) == (token, profile)), None)


def approve(store: Approvals, pack: Pack, token: str, profile: str, allow_token: str, ack_risk: bool, base: str = ".") -> dict:
    """Approves a token as it is now; its name must be given again, and the risk acknowledged."""
    if allow_token != token or not ack_risk:
        raise PermissionError("APPROVAL_NOT_CONFIRMED")
    if broken := verify_integrity(pack, token, base):
        raise PermissionError(broken[0])
    record = {"token": token, "profile": profile, "hashes": token_hashes(pack, token, base)}
    store.save(record)
    return record


def check_authorization(store: Approvals, pack: Pack, token: str, profile: str, base: str = ".") -> tuple[str, list[str]]:
    """("authorized", []), ("requires_approval", why) or ("denied", why)."""
    if broken := verify_integrity(pack, token, base):
        return "denied", broken
    record = store.find(token, profile)
    if record is None:
        return "requires_approval", ["APPROVAL_MISSING"]
    now = token_hashes(pack, token, base)
    differ = [f"APPROVAL_{k.upper()}_DIFFERS" for k in sorted(now) if record["hashes"].get(k) != now[k]]
    return ("requires_approval", differ) if differ else ("authorized", [])


@dataclass(frozen=True)
class Grant:
    """Leave to run one token in one run, until a time."""

    token: str
    run_id: str
    profile: str
    hashes: tuple
    expires: float
    id: str


def issue_grant(store: Approvals, pack: Pack, token: str, run_id: str, profile: str, base: str = ".", ttl: float = TTL, now: float | None = None) -> Grant:
    state, why = check_authorization(store, pack, token, profile, base)
    if state != "authorized":
        raise PermissionError(f"{state}: {', '.join(why)}")
    body = {"token": token, "run_id": run_id, "profile": profile, "hashes": sorted(token_hashes(pack, token, base).items())}
    return Grant(token, run_id, profile, tuple(body["hashes"]), (time.time() if now is None else now) + ttl, record_hash("grant", {**body, "hashes": dict(body["hashes"])}))


def check_grant(grant: Grant, pack: Pack, token: str, run_id: str, base: str = ".", now: float | None = None) -> None:
    if (grant.token, grant.run_id) != (token, run_id):
        raise PermissionError("GRANT_FOR_ANOTHER_RUN")
    if (time.time() if now is None else now) > grant.expires:
        raise PermissionError("GRANT_EXPIRED")
    if dict(grant.hashes) != token_hashes(pack, token, base):
        raise PermissionError("GRANT_HASHES_DIFFER")


def audit_record(grant: Grant, event: str) -> dict:
    return {"event": event, "at": time.time(), **{k: v for k, v in asdict(grant).items() if k not in ("expires", "hashes")}}


def _kind(declared) -> str:
    text = declared.get("type") if isinstance(declared, dict) else str(declared)
    return re.sub(r".*\[(\w+)\]", r"\1", text)


def checked_outputs(found, outputs: dict, n: int) -> dict:
    """A function's result, with the declared ports, each a list of ``n`` values of its type."""
    if not isinstance(found, dict) or set(found) != set(outputs):
        raise ValueError("CUSTOM_OUTPUT_PORTS_DIFFER")
    kinds = {"float": (float, int), "int": (int,), "bool": (bool,), "string": (str,)}
    for port, values in found.items():
        kind = _kind(outputs[port])
        if not isinstance(values, list) or len(values) != n:
            raise ValueError(f"CUSTOM_OUTPUT_LENGTH_DIFFERS: {port}")
        if any(v is not None and (not isinstance(v, kinds[kind]) or (kind != "bool" and isinstance(v, bool))) for v in values):
            raise ValueError(f"CUSTOM_OUTPUT_TYPE_DIFFERS: {port}")
    return found


def execute(frame: DataFrame, pack: Pack, token: str, grant: Grant, run_id: str, inputs: dict[str, str], keys: list[str], order: list[str], params: dict | None = None, base: str = ".") -> DataFrame:
    """keys, order and the token's outputs for each row of ``frame``; inputs: port to column. A key's rows are one call, in order.

    The function's module must be importable on the executors (``addPyFile`` ships it)."""
    check_grant(grant, pack, token, run_id, base)
    found = pack.token(token)
    ports = {p: d for p, d in found.inputs.items() if p not in (params or {})}
    if set(inputs) != set(ports):
        raise ValueError("CUSTOM_INPUT_PORTS_DIFFER")
    module, _, function = found.entrypoint.partition(":")
    needed = list(dict.fromkeys([*keys, *order, *inputs.values()]))
    kinds = dict(frame.select(*needed).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in dict.fromkeys([*keys, *order])), *(f"`{p}` {TYPES[_kind(d)]}" for p, d in found.outputs.items())])
    outputs, given = dict(found.outputs), dict(params or {})

    def run(rows):
        import importlib

        rows = rows.sort_values(order, kind="stable")
        call = getattr(importlib.import_module(module), function)
        made = checked_outputs(call({p: rows[c].tolist() for p, c in inputs.items()} | given), outputs, len(rows))
        out = rows[list(dict.fromkeys([*keys, *order]))].copy()
        for port, values in made.items():
            out[port] = values
        return out

    return frame.select(*needed).groupBy(*keys).applyInPandas(run, schema)
