"""Mixture-controlled packing: deficit round-robin over source queues.

1. Documents are encoded where they are scanned and written as chunks of one source: a chunk knows its place among its
   source's tokens of that scan task, and sums over the tasks give its place in the source's whole stream.
2. The streams are dealt into blocks of ``BLOCK`` tokens by ``Cuts``: units of ``UNIT`` tokens of all sources are put in the order
   in which the mixture comes to them, and every ``BLOCK`` tokens of that order are a block. So each block holds every source
   at its target share to about a unit, however the table is stored. Chunks are cut at the blocks' ends.
3. In a block, each round adds to every queue its share of 1024 tokens and takes pieces of at most ``PACKET`` tokens while the
   deficit covers them; what is left is carried to the next round. The stream is cut into windows of 1024 tokens. The shares are the
   block's own where they are the targets to two units, and the targets elsewhere (where a source runs out).

Every block but the last holds a whole number of windows; the last one's rest is cut into windows whose lengths are powers of
two, so that nothing is padded. When the targets make a source run out, the others share the rest of the stream.

Cases: null or empty text is the end token alone. A null source is a queue of its own, apart from the empty string. Targets default to the sources' shares
of all tokens; a source without a target gets its own share. Documents of any length, repeated rows and one source that
holds most rows, or tables stored by source, need nothing special; an empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rest, slices, small_batches, written
from .tokens import as_bytes, flat_encoder

WINDOW = 1024
PACKET = 256
BLOCK = 1 << 19
UNIT = 1024
CHUNK = 1 << 15
HELD = 1 << 20
BROADCAST_BASES = 50_000
_ROWS = "doc_id array<long>, start array<long>, n array<int>, doc_tokens array<long>, ids binary"
_CHUNKS = f"task int, source string, first long, tokens long, {_ROWS}"
_PARTS = f"block long, source string, at long, {_ROWS}"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _row_arrays(rows: list, ids: list) -> dict:
    """Arrow columns of lists of (doc_id, start, n, doc_tokens) and their ids."""
    import pyarrow as pa

    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n": pa.int32(), "doc_tokens": pa.int64()}
    return {k: pa.array([[x[i] for x in part] for part in rows], pa.list_(kind)) for i, (k, kind) in enumerate(kinds.items())} | {"ids": pa.array(ids, pa.binary())}


def _laid(path: str, end: int):
    """Chunks of at most ``CHUNK`` tokens of one source; at most ``HELD`` tokens wait for theirs to fill."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context, enc = TaskContext.get(), flat_encoder(path)
        task = context.partitionId() if context else 0
        open_rows: dict[str, list] = {}
        open_ids: dict[str, list] = {}
        size: dict[str, int] = {}
        first: dict[str, int] = {}

        def chunk(source: str):
            rows, ids, n = open_rows.pop(source), b"".join(open_ids.pop(source)), size.pop(source)
            at = first.get(source, 0)
            first[source] = at + n
            return pa.record_batch({"task": pa.array([task], pa.int32()), "source": pa.array([source], pa.string()), "first": pa.array([at], pa.int64()), "tokens": pa.array([n], pa.int64())} | _row_arrays([rows], [ids]))

        held = 0
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                values = enc.flat([t or "" for t in part.column("text").to_pylist()])
                for doc_id, source, value in zip(part.column("doc_id").to_pylist(), part.column("source").to_pylist(), values, strict=True):
                    data = value + as_bytes([end])
                    total, start = len(data) // 4, 0
                    while start < total:
                        n = min(total - start, CHUNK - size.get(source, 0))
                        open_rows.setdefault(source, []).append((doc_id, start, n, total))
                        open_ids.setdefault(source, []).append(data[4 * start : 4 * (start + n)])
                        size[source] = size.get(source, 0) + n
                        start, held = start + n, held + n
                        if size[source] == CHUNK:
                            held -= CHUNK
                            yield chunk(source)
                if held > HELD:
                    for source in sorted(size):
                        yield chunk(source)
                    held = 0
        for source in sorted(size):
            yield chunk(source)

    return run


class Cuts:
    """Where each source's stream is cut by the blocks.

    Unit k of a source with phase f is due at (k + f) x unit / share; the phases keep sources with little text apart. Blocks are
    cut from the tokens in that order, ties by source, so that a cut is exact to the token."""

    def __init__(self, tokens: list[int], share: list[float], block: int, unit: int = UNIT):
        self.tokens, self.share = np.array(tokens, np.int64), np.maximum(np.array(share, float), 1e-12)
        self.block, self.unit, self.total = block, unit, int(sum(tokens))
        self.phase = (np.arange(len(tokens)) * 0.6180339887498949 + 0.5) % 1
        self.whole = self.tokens // unit
        self.last_due = (self.whole * unit + self.phase * (self.tokens - self.whole * unit)) / self.share
        self.high = float((self.tokens / self.share).max()) * 2 + 1
        self.known: dict[int, np.ndarray] = {}

    def due(self, x: float) -> np.ndarray:
        """Tokens of each source that are due by ``x``."""
        units = np.clip(np.floor(x * self.share / self.unit - self.phase) + 1, 0, self.whole).astype(np.int64)
        return np.where((units == self.whole) & (x >= self.last_due), self.tokens, units * self.unit)

    def at(self, b: int) -> np.ndarray:
        """Tokens of each source before block ``b``."""
        if b * self.block >= self.total:
            return self.tokens
        if b <= 0:
            return np.zeros_like(self.tokens)
        if b not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            low, high = -1.0, self.high
            while low < (x := (low + high) / 2) < high:
                low, high = (low, x) if self.due(x).sum() >= b * self.block else (x, high)
            before, jump = self.due(low), self.due(high) - self.due(low)
            rest = b * self.block - before.sum()
            self.known[b] = before + np.clip(rest - (np.cumsum(jump) - jump), 0, jump)
        return self.known[b]

    def parts(self, source: int, first: int, n: int):
        """(block, low, high) of the parts of a source's tokens ``first`` to ``first + n``."""
        b = int(self.due(first / self.share[source]).sum()) // self.block
        while b > 0 and self.at(b)[source] > first:
            b -= 1
        low = first
        while low < first + n:
            high = min(first + n, int(self.at(b + 1)[source]))
            if high > low:
                yield b, low, high
            low, b = max(low, high), b + 1


def _dealt(mix):
    def run(batches):
        import pyarrow as pa

        names, tokens, share, block = mix.value
        number, cuts = {s: i for i, s in enumerate(names)}, Cuts(tokens, share, block)
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pydict()
                source, first, n, ids = row["source"][0], row["base"][0] + row["first"][0], row["tokens"][0], memoryview(row["ids"][0])
                todo, out = list(zip(row["doc_id"][0], row["start"][0], row["n"][0], row["doc_tokens"][0], strict=True))[::-1], []
                for b, low, high in cuts.parts(number[source], first, n):
                    rows, left = [], high - low
                    while left:
                        doc_id, start, k, total = todo.pop()
                        take = min(k, left)
                        rows.append((doc_id, start, take, total))
                        left -= take
                        if take < k:
                            todo.append((doc_id, start + take, k - take, total))
                    out.append((b, low, rows, bytes(ids[4 * (low - first) : 4 * (high - first)])))  # Arrow never lets go of a memoryview
                blocks, at, rows, data = zip(*out, strict=True)
                yield pa.record_batch({"block": pa.array(blocks, pa.int64()), "source": pa.array([source] * len(out), pa.string()), "at": pa.array(at, pa.int64())} | _row_arrays(rows, list(data)))

    return run


def drr(entries: list[tuple[str, int]], share: dict[str, float], owed: dict[str, float], window: int = WINDOW, packet: int = PACKET):
    """(entry number, first token in it, tokens) of each piece in the order of the stream; entries: (source, tokens)."""
    queues: dict[str, deque] = {}
    for i, (source, n) in enumerate(entries):
        queues.setdefault(source, deque()).append((i, 0, n))
    deficit = {s: owed.get(s, 0.0) for s in queues}
    ring = sorted(queues)
    while ring:
        active = sum(share[s] for s in ring)
        # In rounds in which no deficit covers a piece nothing is taken: they are all added at once.
        skip = max(0.0, min((min(packet, queues[s][0][2]) - deficit[s]) * active / (share[s] * window) for s in ring))
        rounds = max(1, -int(-skip // 1))
        for s in ring:
            deficit[s] += rounds * window * share[s] / active
            queue = queues[s]
            while queue:
                i, first, n = queue[0]
                take = min(packet, n)
                if take > deficit[s]:
                    break
                deficit[s] -= take
                yield i, first, take
                if take == n:
                    queue.popleft()
                else:
                    queue[0] = (i, first + take, n - take)
        ring = [s for s in ring if queues[s]]


def _packed(mix, window: int, packet: int):
    def run(table):
        import pyarrow as pa

        parts = sorted(table.to_pylist(), key=lambda r: (r["source"], r["at"]))
        block, ids = parts[0]["block"], memoryview(b"".join(p["ids"] for p in parts))
        rows = [(p["source"], *x) for p in parts for x in zip(p["doc_id"], p["start"], p["n"], p["doc_tokens"], strict=True)]
        held: dict[str, int] = {}
        base = [0]
        for source, _, _, n, _ in rows:
            held[source] = held.get(source, 0) + n
            base.append(base[-1] + n)
        total = base[-1]
        names, _, targets, _ = mix.value
        wanted = dict(zip(names, targets, strict=True))
        near = all(abs(n - total * wanted[s] / sum(targets)) <= 2 * UNIT for s, n in held.items())
        share = {s: n / total for s, n in held.items()} if near else wanted
        sequence, offset, left, out = block << 11, 0, total, []
        room = min(window, 1 << (left.bit_length() - 1))
        for i, first, take in drr([(r[0], r[3]) for r in rows], share, {}, window, packet):
            source, doc_id, start, _, doc_tokens = rows[i]
            while take:
                k = min(take, room - offset)
                at = 4 * (base[i] + first)
                out.append((doc_id, start + first, k, zlib.crc32(ids[at : at + 4 * k]), doc_tokens, sequence, offset, source))
                first, take, offset, left = first + k, take - k, offset + k, left - k
                if offset == room and left:
                    sequence, offset, room = sequence + 1, 0, min(window, 1 << (left.bit_length() - 1))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        return pa.table([pa.array(c, pa.string() if k == "source" else pa.int64()) for k, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

    return run


def _key(source: Column) -> Column:
    """A queue's key: null and the empty string are two sources."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source))


def _name(key: str) -> str | None:
    return None if key == "-" else key[1:]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str | None, float] | None = None, end: int = 0, window: int = WINDOW, packet: int = PACKET) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    window: a power of two of at most BLOCK; targets: wanted shares by source, of any sum."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _key(F.col(source_col).cast("string")).alias("source"))
    small_batches(docs.sparkSession)  # a chunk is a row of some 130 KB
    chunks = written(rows.mapInArrow(_laid(path, end), _CHUNKS))
    rest(docs.sparkSession)  # the tokenizers are done
    per_task = chunks.groupBy("source", "task").agg(F.sum("tokens").alias("t"))
    base = per_task.select("source", "task", (F.sum("t").over(Window.partitionBy("source").orderBy("task")) - F.col("t")).alias("base"))
    mix = sorted((r.source, r.t) for r in per_task.groupBy("source").agg(F.sum("t").alias("t")).collect())  # a row for each source
    total = sum(t for _, t in mix)
    share = [(targets or {}).get(_name(s), t / total) for s, t in mix]
    dealt = docs.sparkSession.sparkContext.broadcast(([s for s, _ in mix], [t for _, t in mix], share, BLOCK))
    small = base.count() <= BROADCAST_BASES  # rows of a source, a task and a sum
    placed = chunks.join(F.broadcast(base) if small else base, ["source", "task"])
    pieces = placed.mapInArrow(_dealt(dealt), _PARTS).groupBy("block").applyInArrow(_packed(dealt, window, packet), _PIECES)
    return pieces.withColumn("source", F.when(F.col("source") != "-", F.expr("substr(source, 2)")))
