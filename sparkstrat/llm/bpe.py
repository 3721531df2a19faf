"""Byte-level BPE encoding and decoding.

The distinct words of a task (words: the matches of the vocabulary's split pattern) are encoded by Spark higher-order functions. A
word is a byte array; its tokens are the characters of a string, at first one for each byte. A fold takes the ranked merges from the lowest
rank on and replaces each merge's pair by its token, all occurrences from the left. The merges are a literal: an array
of pairs and one of tokens, both by rank. That is the lowest pair first, as the library has it: a token's pair is what its bytes become by the merges of lower
ranks, so a merge never makes a pair of a lower rank, and no token is reached by another pair. Decoding replaces ids by the
binary pieces of a literal array and concatenates them.

A fold over all 50,000 merges would find nearly none in a word, so the words come with the ranks of the tokens that occur in their
bytes (a search for all tokens at once): only those can be merged, and all others are left out of the fold.

A task sends each distinct word to the fold once: blocks of documents (at most ``BLOCK_CHARS`` characters, one document at least)
carry the words that no earlier block of the task had, and every text as numbers of words. The last step keeps the words' ids and
fills them in. Both sides forget all words when more than ``CACHED`` words and pieces are held. All steps are narrow, so nothing is
shuffled, and a lost task repeats its own documents only.

Cases: null text counts as empty: no ids. Special strings are ordinary text. Texts of any script, length or white space are
encoded whole; repeated rows get a row each; ties of a merge go to the leftmost pair; extra columns, of any name, are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import ODD

BLOCK_CHARS = 1 << 19
CACHED = 800_000
_BLOCK = "fresh boolean, doc_id array<long>, n array<int>, at binary, words array<binary>, merges array<array<int>>"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _code(ranks: dict[bytes, int], token: bytes) -> str:
    """A token as a character: a single byte is the character of its value, others are that of their rank."""
    return chr(token[0] if len(token) == 1 else ranks[token])


def pairs_of(ranks: dict[bytes, int]) -> dict[int, tuple[bytes, bytes]]:
    """rank: (left, right) of each token of two or more bytes that merges of lower ranks bring down to two."""
    found = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if low >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found[rank] = (parts[0], parts[1])
    return found


def merge_literals(ranks: dict[bytes, int]) -> tuple[Column, Column]:
    """By rank: the two characters of a merge's pair, and the character of its token."""
    if sorted(ranks[bytes([b])] for b in range(256)) != list(range(256)) or max(ranks.values()) >= 0xD800:
        raise ValueError("the single bytes must have the ranks below 256, and ranks must be below 55296")
    pairs = pairs_of(ranks)
    text = [""] * (max(ranks.values()) + 1)
    for rank, (left, right) in pairs.items():
        text[rank] = _code(ranks, left) + _code(ranks, right)
    return F.from_json(F.lit(json.dumps(text)), "array<string>"), F.from_json(F.lit(json.dumps([chr(i) if t else "" for i, t in enumerate(text)])), "array<string>")


def byte_literal(ranks: dict[bytes, int]) -> Column:
    """The ids of the 256 bytes as a literal array."""
    return F.from_json(F.lit(json.dumps([ranks[bytes([i])] for i in range(256)])), "array<int>")


def encode_word(word: Column, merges: Column, pairs: Column, tokens: Column, letters: Column) -> Column:
    """The ids of a word, a byte array, by a fold over ranks of merges in ascending order."""
    start = F.decode(word, "ISO-8859-1")  # a character for each byte
    done = F.aggregate(merges, start, lambda s, r: F.replace(s, F.get(pairs, r), F.get(tokens, r)))
    codes = F.transform(F.when(F.length(done) > 0, F.split(done, "")).otherwise(F.array().cast("array<string>")), F.ascii)
    return F.transform(codes, lambda c: F.coalesce(F.get(letters, c), c))


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """The pieces of the ids as a literal array of byte arrays."""
    table = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = base64.b64encode(piece).decode()
    return F.from_json(F.lit(json.dumps(table)), "array<binary>")


def decode_word(ids: Column, pieces: Column) -> Column:
    """The bytes of an array of ids: their pieces, concatenated."""
    return F.aggregate(ids, F.lit(b""), lambda out, i: F.concat(out, F.get(pieces, i)))


class Words:
    """Numbers of the distinct words of a task, and of the pieces between spaces that they come in."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.piece: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)  # where a piece's words begin in ``held``
        self.held = np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.number) + len(self.piece)

    def numbers(self, words: list[str], new: list[str]) -> np.ndarray:
        known = self.number
        for w in dict.fromkeys(words):
            if w not in known:
                known[w] = len(known)
                new.append(w)
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def learn(self, pieces: list[str], new: list[str]) -> None:
        """Numbers pieces, each of which follows a space and begins with a visible character."""
        if not pieces:
            return
        words = self.find(" " + " ".join(pieces))
        heads = np.flatnonzero(np.fromiter((w[0] == " " for w in words), bool, len(words)))
        if len(heads) != len(pieces):
            parts = [self.find(" " + p) for p in pieces]
            words, heads = [w for p in parts for w in p], np.cumsum([0, *[len(p) for p in parts[:-1]]])
        self.piece.update(zip(pieces, range(len(self.piece), len(self.piece) + len(pieces)), strict=True))
        self.first = np.concatenate([self.first, len(self.held) + np.append(heads[1:], len(words))])
        self.held = np.concatenate([self.held, self.numbers(words, new)])

    def block(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """For each text the numbers of its words; the words that were not known."""
        new: list[str] = []
        cut = [None if ODD.search(t) else t.split(" ") for t in texts]
        fresh = set().union(*[p[1:] for p in cut if p]).difference(self.piece)
        self.learn(sorted(fresh), new)
        out = []
        for text, parts in zip(texts, cut, strict=True):
            if parts is None:
                out.append(self.numbers(self.find(text), new))
                continue
            at = np.fromiter(map(self.piece.__getitem__, parts[1:]), np.int64, len(parts) - 1)
            rest = gathered(self.held, self.first[at], self.first[at + 1] - self.first[at])
            out.append(np.concatenate([self.numbers(self.find(parts[0]), new), rest]) if parts[0] else rest)
        return out, new


def gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``first`` and are ``n`` long, laid end to end."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first - (ends - n), n) + np.arange(total)]


def _automaton(ranks: dict[bytes, int]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for token, rank in ranks.items():
        if len(token) > 1:
            found.add_word(token.decode("latin-1"), rank)
    found.make_automaton()
    return found


def _blocks(path: str, pattern: str, limit: int, cached: int):
    def run(batches):
        import pyarrow as pa

        words, tokens, fresh = Words(pattern), _automaton(ranks_of(path)).iter, True
        for batch in batches:
            for part in slices(batch, "text", limit):
                if len(words) > cached:
                    words.clear()
                    fresh = True
                at, new = words.block([t or "" for t in part.column("text").to_pylist()])
                spelt = [w.encode() for w in new]
                merges = [sorted({r for _, r in tokens(w.decode("latin-1"))}) for w in spelt]
                yield pa.record_batch({
                    "fresh": pa.array([fresh]),
                    "doc_id": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "n": pa.array([[len(x) for x in at]], pa.list_(pa.int32())),
                    "at": pa.array([np.concatenate(at).astype("<i4").tobytes()], pa.binary()),
                    "words": pa.array([spelt], pa.list_(pa.binary())),
                    "merges": pa.array([merges], pa.list_(pa.list_(pa.int32()))),
                })
                fresh = False

    return run


class Held:
    """Runs of values that grow by appending: run k is flat[first[k] : first[k + 1]]."""

    def __init__(self, kind):
        self.flat, self.first, self.size, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while len(self.flat) < self.size + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.first) < self.n + len(sizes) + 1:
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.flat[self.size : self.size + len(flat)] = flat
        self.first[self.n + 1 : self.n + len(sizes) + 1] = self.size + np.cumsum(sizes)
        self.size, self.n = self.size + len(flat), self.n + len(sizes)

    def runs(self, at: np.ndarray, owner_ends: np.ndarray) -> list[bytes]:
        """The runs ``at``, laid end to end, as bytes for each owner."""
        n = self.first[at + 1] - self.first[at]
        data = memoryview(gathered(self.flat, self.first[at], n).tobytes())
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], owner_ends])] * self.flat.itemsize
        return [bytes(data[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _assembled(batches):
    import pyarrow as pa

    ids = decoded = None
    for batch in batches:
        for r in range(batch.num_rows):
            if ids is None or batch.column("fresh")[r].as_py():
                ids, decoded = Held("<u4"), Held(np.uint8)
            lists, made = batch.column("ids")[r].values, batch.column("decoded")[r].values
            edges = lists.offsets.to_numpy()
            ids.add(lists.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]], np.diff(edges))
            edges = np.frombuffer(made.buffers()[1], np.int32)[made.offset : made.offset + len(made) + 1]
            decoded.add(np.frombuffer(made.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]], np.diff(edges))
            at = np.frombuffer(batch.column("at")[r].as_py(), "<i4").astype(np.int64)
            ends = np.cumsum(batch.column("n")[r].values.to_numpy(zero_copy_only=False))
            yield pa.record_batch({"doc_id": batch.column("doc_id")[r].values, "ids": pa.array(ids.runs(at, ends), pa.binary()), "decoded": pa.array(decoded.runs(at, ends), pa.binary())})


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, cached: int = CACHED) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded (the bytes that the ids stand for) for each row."""
    ranks = ranks_of(path)
    (pairs, tokens), letters, pieces = merge_literals(ranks), byte_literal(ranks), piece_literal(ranks)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = rows.mapInArrow(_blocks(path, pattern, block_chars, cached), _BLOCK)
    encoded = blocks.withColumn("ids", F.zip_with("words", "merges", lambda w, m: encode_word(w, m, pairs, tokens, letters)))
    decoded = encoded.select("fresh", "doc_id", "n", "at", "ids", F.transform("ids", lambda w: decode_word(w, pieces)).alias("decoded"))
    return decoded.mapInArrow(_assembled, "doc_id long, ids binary, decoded binary")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the concatenated pieces of an array<int> column of ids."""
    return encoded.withColumn("decoded", decode_word(F.col(ids_col), piece_literal(ranks_of(path))))
