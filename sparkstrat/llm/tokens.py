"""Encoding by a public byte-level BPE vocabulary, a space-delimited piece at a time, with a cache in each worker.

The split pattern takes a space only as the first character of a match or in a run of white space, so a text can be cut before
every space that a visible character follows: the pieces' encodings, concatenated, are the text's encoding.

``flat`` encodes ordinary texts whole by ranks, which is a third of the work. It gives the same ids: where each token's id follows
its merge's place, no token can be reached by another pair than its own merge, for a span that became two tokens without a merge
across its ends has been merged as the token alone would be. Only Latin-1 texts go that way, so that both libraries' Unicode
tables agree, and none with the special string or of more than ``WHOLE_CHARS``, which a long run of white space could exhaust.
"""

from __future__ import annotations

import json
import re
from array import array

SPECIAL = "<|endoftext|>"
CACHED = 400_000
CACHED_CHARS = 48
WHOLE_CHARS = 100_000
# The split pattern of byte-level pre-tokenizers.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?= \S)")
_ENCODERS: dict = {}


def pieces_of(text: str) -> list[str]:
    """The text, cut before each space that a visible character follows."""
    if ODD.search(text):
        return [x for x in _CUT.split(text) if x]
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def by_ranks(path: str):
    """The vocabulary of ``path`` for encoding by ranks, or None where that could give other ids."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model, split = found["model"], found.get("pre_tokenizer") or {}
    if found.get("normalizer") or (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) != ("ByteLevel", True, False):
        return None
    vocab, merges = model.get("vocab"), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
    added = {t["content"] for t in found.get("added_tokens", [])}
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if added <= {SPECIAL} else None


class Encoder:
    """``cache`` maps a piece to what ``value`` makes of its ids; ``known`` is a broadcast table that is looked up first."""

    def __init__(self, path: str, value, special):
        from tokenizers import Tokenizer

        self.tokenizer, self.value, self.special, self.cache = Tokenizer.from_file(path), value, value(special), {}

    def learn(self, pieces) -> dict:
        """Values of pieces, by one call of the library."""
        pieces = list(pieces)
        return {p: self.value(e.ids) for p, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True)}

    def encode(self, texts: list[str], known: dict) -> list[list]:
        """For each text the values of its pieces, in order."""
        cut = [[pieces_of(part) for part in t.split(SPECIAL)] for t in texts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        cache = self.cache
        fresh = self.learn({p for parts in cut for part in parts for p in part if p not in known and p not in cache})
        out = []
        for parts in cut:
            values = []
            for i, part in enumerate(parts):
                if i:
                    values.append(self.special)
                for p in part:
                    v = known.get(p)
                    if v is None:
                        v = cache.get(p)
                        if v is None:
                            v = fresh[p]
                    values.append(v)
            out.append(values)
        cache.update((p, v) for p, v in fresh.items() if len(p) <= CACHED_CHARS)
        return out


class FlatEncoder(Encoder):
    """Texts to ids as bytes."""

    def __init__(self, path: str):
        super().__init__(path, as_bytes, special_ids(path))
        self.ranked = by_ranks(path)

    def flat(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, little-endian unsigned 32-bit."""
        whole = [self.ranked is not None and len(t) <= WHOLE_CHARS and SPECIAL not in t and _latin(t) for t in texts]
        rest = iter(self.encode([t for t, w in zip(texts, whole, strict=True) if not w], {}))
        return [self.ranked.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() if w else b"".join(next(rest)) for t, w in zip(texts, whole, strict=True)]


def as_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    import sys

    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def special_ids(path: str) -> list[int]:
    from tokenizers import Tokenizer

    return [Tokenizer.from_file(path).token_to_id(SPECIAL)]


def encoder(path: str, value) -> Encoder:
    """The worker's encoder; one for each file and kind of value."""
    return _kept((path, value.__name__), lambda: Encoder(path, value, special_ids(path)))


def flat_encoder(path: str) -> FlatEncoder:
    """The worker's encoder of texts into bytes; one for each file."""
    return _kept((path, "flat"), lambda: FlatEncoder(path))


def _kept(key: tuple, make):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if key not in _ENCODERS:
        _ENCODERS[key] = make()
    return _ENCODERS[key]
