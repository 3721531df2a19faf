"""Token packs: manifests, registries, version ranges, locks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from .canonical import record_hash


@dataclass(frozen=True)
class Token:
    """A custom token: its ports, and the function ``module:name`` that computes it."""

    id: str
    version: str = "1"
    inputs: dict = field(default_factory=dict)
    outputs: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    entrypoint: str = ""
    maturity: str = "experimental"
    metadata: dict = field(default_factory=dict)

    def spec(self) -> dict:
        return {"id": self.id, "version": self.version, "inputs": self.inputs, "outputs": self.outputs, "params": self.params, "entrypoint": self.entrypoint, "maturity": self.maturity}


@dataclass(frozen=True)
class Pack:
    id: str
    version: str
    tokens: tuple[Token, ...]
    requires: dict = field(default_factory=dict)
    implementation: dict = field(default_factory=dict)
    hashes: dict = field(default_factory=dict)

    def token(self, name: str) -> Token:
        for t in self.tokens:
            if t.id == name:
                return t
        raise KeyError(f"TOKEN_UNKNOWN: {name}")


def load_pack(path: str) -> Pack:
    """A pack from a JSON or YAML manifest."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text)
    return pack_of(raw)


def pack_of(raw: dict) -> Pack:
    if not isinstance(raw, dict) or not isinstance(raw.get("id"), str) or not isinstance(raw.get("tokens"), list):
        raise ValueError("PACK_INVALID")
    known = set(Token.__dataclass_fields__)
    tokens = tuple(Token(**{k: v for k, v in t.items() if k in known}) for t in raw["tokens"])
    if len({t.id for t in tokens}) < len(tokens):
        raise ValueError("PACK_TOKEN_DUPLICATE")
    return Pack(raw["id"], str(raw.get("version", "1")), tokens, raw.get("requires") or {}, raw.get("implementation") or {}, raw.get("hashes") or {})


def spec_hash(token: Token) -> str:
    return record_hash("token_spec", token.spec())


def behaviour_hash(token: Token, implementation: str) -> str:
    """What a token does: its ports and parameters together with its code."""
    return record_hash("behaviour", {"spec": token.spec(), "implementation": implementation})


def pack_hash(pack: Pack) -> str:
    return record_hash("token_pack", {"id": pack.id, "version": pack.version, "tokens": [spec_hash(t) for t in sorted(pack.tokens, key=lambda t: t.id)], "requires": pack.requires, "implementation": pack.implementation})


def _numbers(version: str) -> tuple:
    found = re.fullmatch(r"v?(\d+(?:\.\d+)*)(?:(a|b|rc)(\d+))?", version.strip())
    if not found:
        raise ValueError(f"VERSION_INVALID: {version}")
    parts = [int(x) for x in found[1].split(".")]
    while len(parts) > 1 and parts[-1] == 0:
        parts.pop()
    return tuple(parts), ({"a": 0, "b": 1, "rc": 2}[found[2]], int(found[3])) if found[2] else (3, 0)


def matches(version: str, wanted: str) -> bool:
    """Whether a version lies in a range such as ``>=1.2,<2``, ``~=1.4`` or ``==1.*``; no range: any."""
    own = _numbers(version)
    for part in filter(None, (p.strip() for p in wanted.split(","))):
        found = re.fullmatch(r"(==|!=|>=|<=|~=|>|<)\s*(\S+)", part)
        if not found:
            raise ValueError(f"RANGE_INVALID: {part}")
        op, other = found.groups()
        if other.endswith(".*") and op in ("==", "!="):
            head = [int(x) for x in other[:-2].split(".")]
            same = list((own[0] + (0,) * len(head))[: len(head)]) == head
            if same != (op == "=="):
                return False
            continue
        that = _numbers(other)
        if op == "~=":
            head = [int(x) for x in re.split(r"[a-z]", other)[0].split(".")][:-1]
            if not head or own < that or list((own[0] + (0,) * len(head))[: len(head)]) != head:
                return False
        elif not {"==": own == that, "!=": own != that, ">=": own >= that, "<=": own <= that, ">": own > that, "<": own < that}[op]:
            return False
    return True


class Registry:
    """Packs by id and version."""

    def __init__(self):
        self._packs: dict[str, dict[str, Pack]] = {}

    def register(self, pack: Pack) -> None:
        if pack.version in self._packs.setdefault(pack.id, {}):
            raise ValueError(f"PACK_DUPLICATE: {pack.id} {pack.version}")
        taken = {t.id for packs in self._packs.values() for p in packs.values() if p.id != pack.id for t in p.tokens}
        if clash := sorted(t.id for t in pack.tokens if t.id in taken):
            raise ValueError(f"TOKEN_DUPLICATE: {clash[0]}")
        self._packs[pack.id][pack.version] = pack

    def find(self, name: str, wanted: str = "") -> Pack:
        """The newest version in a range."""
        fit = [v for v in self._packs.get(name, {}) if matches(v, wanted)]
        if not fit:
            raise KeyError(f"PACK_UNRESOLVED: {name} {wanted}".strip())
        return self._packs[name][max(fit, key=_numbers)]

    def resolve(self, wanted: dict[str, str]) -> list[Pack]:
        """The packs that are wanted and those that they require, each after what it requires; a circle is an error."""
        done: dict[str, Pack] = {}
        path: list[str] = []

        def visit(name: str, span: str) -> None:
            if name in path:
                raise ValueError(f"PACK_CYCLE: {' > '.join([*path[path.index(name):], name])}")
            if name in done:
                if not matches(done[name].version, span):
                    raise ValueError(f"PACK_CONFLICT: {name} {done[name].version} is not {span}")
                return
            pack = self.find(name, span)
            path.append(name)
            for other, needs in sorted(pack.requires.items()):
                visit(other, needs)
            path.pop()
            done[name] = pack

        for name, span in sorted(wanted.items()):
            visit(name, span)
        return list(done.values())


def lock(packs: list[Pack]) -> dict:
    """What was resolved, by hash."""
    return {"packs": [{"id": p.id, "version": p.version, "pack_hash": pack_hash(p), "tokens": {t.id: spec_hash(t) for t in p.tokens}} for p in sorted(packs, key=lambda p: p.id)]}


def verify_lock(locked: dict, packs: list[Pack]) -> list[str]:
    """What differs between a lock and packs, as codes with the pack's id."""
    now, then = {p["id"]: p for p in lock(packs)["packs"]}, {p["id"]: p for p in locked.get("packs", ())}
    out = [f"LOCK_PACK_MISSING: {i}" for i in sorted(set(then) - set(now))] + [f"LOCK_PACK_EXTRA: {i}" for i in sorted(set(now) - set(then))]
    for i in sorted(set(now) & set(then)):
        if now[i]["version"] != then[i]["version"]:
            out.append(f"LOCK_VERSION_DIFFERS: {i}")
        elif now[i]["pack_hash"] != then[i]["pack_hash"]:
            out.append(f"LOCK_HASH_DIFFERS: {i}")
    return out
