"""Repeated substrings by hashed fixed-length fingerprints at content-defined anchors, in place of prefix doubling.

A byte is removed if a string of ``LENGTH`` bytes over it also starts earlier. No rank is sorted, doubled
or reranked: strings of fixed lengths at content-defined anchors are named by hashes and grouped by equality. The anchor of a window of LENGTH bytes is the 32-byte gram of the lowest hash in it, so
equal windows have equal anchors, and there is an anchor for every 35 bytes or so. Consecutive windows with one anchor are a
segment. Spark groups the pairs of hashes of strings of growing lengths, and drops those that are unique:

1. 32 bytes: anchors. A segment whose anchor occurs nowhere else is done.
2. anchor and segment (its windows' whole bytes). A segment that occurs earlier is removed; if all segments of an anchor are
   equal, its first one is done as well.
3. 83 bytes: the part that the windows of a quarter of the first segments of each kind share. Unique parts are done.
4. LENGTH bytes: windows, each known by a pair of ranks; those that occur earlier are removed. Windows are taken in ``SLICES`` parts
   by their shared part, one after another, and each step drops what the one before it left, so that steps do not add up on disk.

Ranks are 64-bit hashes; a verdict rests on a pair of them (128 bits). Only small rows are shuffled: per segment, not per byte.

Cases: null text counts as empty; texts shorter than LENGTH lose nothing. Earlier means a smaller doc_id (null first), or an
earlier start in the same row; rows that repeat a doc_id are not earlier than one another. Strings that thousands of documents
share are pre-aggregated in each task and joined through skew-proof exchanges. Very long texts are worked on in parts of
``PART`` windows. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, drop, slices, spread_join, sweep, written

LENGTH = 100
GRAM = 32
QUARTER = 18
PART = 1 << 20
BITS = 1 << 27
SLICES = 4
_CORE = LENGTH - QUARTER + 1
_FIRST = -(1 << 63)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
_SEGMENTS = "doc long, body long, start int, last int, gram long, whole long, again int"
_CORES = "doc long, body long, gram long, core long, core2 long, starts binary, names binary"
_PACKED = "doc_id long, doc long, body long, packed binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Ranks:
    """Names of substrings of some bytes: polynomial hashes modulo 2**64 of random letters, from prefix sums."""

    def __init__(self, data: bytes, which: int):
        rng = np.random.default_rng(7919 + which)
        letters = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 58, 1 << 60)) * 8 + 5
        n = len(data) + 1
        while len(_POWERS) <= which:
            _POWERS.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
        if len(_POWERS[which][0]) < n:
            back = pow(base, -1, 1 << 64)
            _POWERS[which] = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), x, np.uint64)])) for x in (base, back))
        up, self.down = _POWERS[which]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(letters[np.frombuffer(data, np.uint8)] * up[: n - 1], out=self.sums[1:])

    def names(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.uint64(1) * np.asarray(size, np.uint64))

    def grams(self, size: int) -> np.ndarray:
        out = self.sums[size:] - self.sums[:-size]
        out *= self.down[: len(out)]
        return out


def window_anchors(grams: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The lowest gram hash of each window."""
    least, width, n = grams, 1, length - gram + 1
    while 2 * width <= n:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return np.minimum(least[: len(grams) - n + 1], least[n - width :]) if n > width else least


def leftmost(grams: np.ndarray, start: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The first place of each value in the window that starts at ``start``."""
    out = np.empty(len(start), np.int64)
    reach = np.arange(LENGTH - GRAM + 1)
    for i in range(0, len(start), 8192):
        at = start[i : i + 8192]
        out[i : i + 8192] = at + (grams[at[:, None] + reach] == value[i : i + 8192, None]).argmax(1)
    return out


def segments(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, name of all bytes) of the segments of texts laid end to end; ends: where they end.

    No window crosses an end. Where the same gram comes again within a window, as in periodic text, its leftmost place is the
    anchor."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    ranks = Ranks(data, 0)
    grams = ranks.grams(GRAM)
    low = window_anchors(grams)
    inside = np.ones(len(low) + 1, bool)
    for e in ends.tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    inside[-1] = False
    change = np.concatenate([[True], low[1:] != low[:-1], [True]])
    # A segment starts where the anchor changes or the windows of a text begin, and ends before the next start or the text's end.
    edges = np.flatnonzero(change | np.concatenate([[False], inside[1:] != inside[:-1]]))
    start, last = edges[:-1], edges[1:] - 1
    valid = inside[start]
    start, last = start[valid], last[valid]
    anchor = leftmost(grams, start, low[start])
    late = np.flatnonzero(anchor < last)
    if len(late):
        runs = [np.stack([np.delete(start, late), np.delete(last, late)])]
        for s, e, c in zip(start[late].tolist(), last[late].tolist(), anchor[late].tolist(), strict=True):
            split, value = [], low[s]
            while s <= e:
                if c < s:
                    c = s + int(np.argmax(grams[s : s + LENGTH - GRAM + 1] == value))
                split.append((s, min(c, e)))
                s = c + 1
            runs.append(np.array(split, np.int64).T)
        start, last = np.concatenate(runs, axis=1)
        order = np.argsort(start)
        start, last = start[order], last[order]
    return start, last, low[start], Ranks(data, 1).names(start, last - start + LENGTH)


def _parts(size: int):
    """(start, end) of the parts of a text; each window is in one part."""
    for at in range(0, max(0, size - LENGTH + 1), PART):
        yield at, min(size, at + PART + LENGTH - 1)


def _pieces(batch):
    """(texts of about PART bytes laid end to end, their rows, where each starts in its row); long texts come in parts."""
    rows, starts, texts, held = [], [], [], 0
    for i, text in enumerate(arrow_bytes(batch.column("text"))):
        for at, end in _parts(len(text)):
            rows.append(i)
            starts.append(at)
            texts.append(text[at:end])
            held += end - at
            if held >= PART:
                yield texts, np.array(rows), np.array(starts)
                rows, starts, texts, held = [], [], [], 0
    if texts:
        yield texts, np.array(rows), np.array(starts)


def _segmented(wanted=None):
    """wanted: a broadcast bitmap of hashed anchors; rows whose anchor it surely has not are left out."""

    def run(batches):
        names = ["doc", "body", "start", "last", "gram", "whole", "again"]
        bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            doc, body, seen, out, held = batch.column("doc").to_numpy(), batch.column("body").to_numpy(), {}, [], 0
            for texts, rows, begins in _pieces(batch):
                ends = np.cumsum([len(t) for t in texts])
                start, last, gram, whole = segments(b"".join(texts), ends)
                which = np.searchsorted(ends, start, "right")
                shift, row = (ends - [len(t) for t in texts])[which] - begins[which], rows[which]
                pair = _mix(_mix(gram) ^ whole) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                again = np.ones(len(pair), np.int32)
                again[np.unique(pair, return_index=True)[1]] = 0
                for r in np.unique(rows[begins > 0]).tolist():  # parts of one long text
                    mine = row == r
                    for old in seen.get(r, ()):
                        again[mine] |= np.isin(pair[mine], old)
                for r in set(rows.tolist()) if len(texts) == 1 else {int(rows[0]), int(rows[-1])}:
                    seen.setdefault(r, []).append(np.unique(pair[row == r]))
                # Neighbours that all came earlier in the row are one row of the table.
                joined = (again == 1) & np.concatenate([[False], (again[:-1] == 1) & (which[1:] == which[:-1])])
                first = np.flatnonzero(~joined)
                final = last[np.concatenate([first[1:] - 1, [len(last) - 1]])] if len(last) else last
                keep = first
                if bits is not None:
                    bit = (gram[first] & np.uint64(BITS - 1)).astype(np.int64)
                    found = (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                    keep, final = first[found], final[found]
                out.append((doc[row[keep]], body[row[keep]], start[keep] - shift[keep], final - shift[keep], gram[keep].view(np.int64), whole[keep].view(np.int64), again[keep]))
                held += len(keep)
                if held > 200_000:
                    yield _table(out, names)
                    out, held = [], 0
            if out:
                yield _table(out, names)

    return run


def _bitmap(shared: DataFrame) -> bytes:
    """A bitmap of BITS bits (16 MB, whatever the data) of the low bits of anchors: it spares the shuffle of rows that have no
    partner, fewer of them the larger the corpus, and changes no result."""
    bit = F.col("gram").bitwiseAND(F.lit(BITS - 1)) + 1
    maps = shared.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    out = bytearray(BITS // 8)
    for r in maps:
        out[(r.k - 1) * 4096 : r.k * 4096] = r.map
    return bytes(out)


def _table(out, names):
    import pyarrow as pa

    kinds = {"doc": pa.int64(), "body": pa.int64(), "start": pa.int32(), "last": pa.int32(), "gram": pa.int64(), "whole": pa.int64(), "again": pa.int32()}
    return pa.record_batch([pa.array(np.concatenate(c), kinds[k]) for k, c in zip(names, zip(*out, strict=True), strict=True)], names=names)


def _cores(batches):
    """Of the segments in doubt: the shared part of each quarter, with the starts and names of its windows."""
    import pyarrow as pa
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out, held = [], 0
        for r in range(batch.num_rows):
            doubt, doc, body = batch.column("doubt")[r].values, batch.column("doc")[r].as_py(), batch.column("body")[r].as_py()
            text = expand(batch.column("packed")[r].as_py())
            start, last, gram = (doubt.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "last", "gram"))
            order = np.argsort(start)
            start, last, gram = start[order], last[order], gram[order]
            k, seen = 0, []
            while k < len(start):
                at = int(start[k])
                stop = max(k + 1, int(np.searchsorted(last, at + PART)))
                out += _doubtful(doc, body, text[at : int(last[stop - 1]) + LENGTH], at, start[k:stop], last[k:stop], gram[k:stop], seen)
                k = stop
            held += len(start)
            if held > 20_000:
                yield _rows(out)
                out, held = [], 0
        if out:
            yield _rows(out)


def _doubtful(doc: int, body: int, part: bytes, at: int, start: np.ndarray, last: np.ndarray, gram: np.ndarray, seen: list) -> list[tuple]:
    """The rows of ``_cores`` for the segments of a part that begins at ``at``."""
    one, two = Ranks(part, 0), Ranks(part, 1)
    n = last - start + 1
    anchor = leftmost(one.grams(GRAM), start - at, gram.view(np.uint64))
    window = np.repeat(start - at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    names = two.names(window, np.full(len(window), LENGTH)).view(np.int64)
    fresh = np.zeros(len(window), bool)
    fresh[np.unique(names, return_index=True)[1]] = True
    for old in seen:
        fresh &= ~np.isin(names, old)
    seen.append(names[fresh])
    rows = []
    if not fresh.all():  # they came earlier in this row
        rows.append((doc, body, 0, None, None, (window[~fresh] + at).astype("<i4").tobytes(), b""))
    owner, window, names = np.repeat(np.arange(len(start)), n)[fresh], window[fresh], names[fresh]
    share = anchor[owner] - (anchor[owner] - window) // QUARTER * QUARTER  # where the quarter's shared part starts
    first = np.concatenate([[0], np.flatnonzero((np.diff(share) != 0) | (np.diff(owner) != 0)) + 1]) if len(window) else np.zeros(0, np.int64)
    ends = np.concatenate([first[1:], [len(window)]])
    size = np.full(len(first), _CORE)
    c1, c2 = one.names(share[first], size).view(np.int64).tolist(), two.names(share[first], size).view(np.int64).tolist()
    starts, names = (window + at).astype("<i4").tobytes(), names.astype("<i8").tobytes()
    for g, a, b, i, j in zip(gram[owner[first]].tolist(), c1, c2, first.tolist(), ends.tolist(), strict=True):
        rows.append((doc, body, g, a, b, starts[4 * i : 4 * j], names[8 * i : 8 * j]))
    return rows


def _rows(out):
    import pyarrow as pa

    kinds = [pa.int64()] * 5 + [pa.binary()] * 2
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc", "body", "gram", "core", "core2", "starts", "names"])


def _single(batches):
    import pyarrow as pa

    for batch in batches:
        starts = [np.frombuffer(x, "<i4") for x in batch.column("starts").to_pylist()]
        n = np.array([len(x) for x in starts], np.int64)
        if len(n):
            start = pa.array(np.concatenate(starts), pa.int32())
            yield pa.record_batch({"doc": pa.array(np.repeat(batch.column("doc").to_numpy(), n)), "body": pa.array(np.repeat(batch.column("body").to_numpy(), n)), "start": start, "last": start})


def _unrolled(batches):
    """A row for each window of the parts that occur more than once."""
    import pyarrow as pa

    for batch in batches:
        starts = [np.frombuffer(x, "<i4") for x in batch.column("starts").to_pylist()]
        names = [np.frombuffer(x, "<i8") for x in batch.column("names").to_pylist()]
        n = np.array([len(x) for x in starts], np.int64)
        if len(n):
            spread = {k: pa.array(np.repeat(batch.column(k).to_numpy(), n)) for k in ("doc", "body", "core")}
            yield pa.record_batch({**spread, "start": pa.array(np.concatenate(starts), pa.int32()), "name": pa.array(np.concatenate(names), pa.int64())})


def covered(size: int, runs) -> np.ndarray:
    """Which bytes the windows (first, last) cover."""
    edge = np.zeros(size + 1, np.int32)
    if len(runs):
        first, last = np.asarray(runs, np.int64).T
        np.add.at(edge, first, 1)
        np.add.at(edge, last + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(batches):
    import pyarrow as pa
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out, held = [], 0
        for doc_id, packed, runs in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            text = expand(packed)
            gone = covered(len(text), [(x["start"], x["last"]) for x in runs or ()])
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
            out.append((doc_id, len(text), int(gone.sum()), spans, kept))
            held += len(text)
            if held > 8_000_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _bit(doc: np.ndarray, body: np.ndarray) -> np.ndarray:
    return (_mix(doc.astype(np.int64).view(np.uint64) ^ _mix(body.astype(np.int64).view(np.uint64))) & np.uint64(BITS - 1)).astype(np.int64)


def _marked(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.record_batch({"gram": pa.array(_bit(batch.column("doc").to_numpy(), batch.column("body").to_numpy()), pa.int64())})


def _sure(wanted, inside: bool):
    """Rows that the bitmap of documents may have (inside), with packed texts; or the results of the others, which lose nothing."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        squeeze, bits = zstandard.ZstdCompressor(level=3).compress, np.frombuffer(wanted.value, np.uint8)
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                bit = _bit(batch.column("doc").to_numpy(), batch.column("body").to_numpy())
                part = batch.filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool) == inside))
                texts = arrow_bytes(part.column("text"))
                if inside:
                    yield pa.record_batch({"doc_id": part.column("doc_id"), "doc": part.column("doc"), "body": part.column("body"), "packed": pa.array([squeeze(t) for t in texts], pa.binary())})
                else:
                    none = pa.array(np.zeros(len(texts), np.int64))
                    yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": none, "n_spans": none, "kept": pa.array(texts, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(_FIRST)).alias("doc"), F.xxhash64("text").alias("body"), "text")
    spark = docs.sparkSession
    source = base.select("doc", "body", "text")
    found = source.mapInArrow(_segmented(), _SEGMENTS)
    ends = found.groupBy("gram").agg(*[f(c).alias(f"{k}_{c}") for c in ("doc", "whole") for k, f in (("low", F.min), ("high", F.max))], F.max("again").alias("twice"))
    shared = written(ends.where("low_doc <> high_doc or low_whole <> high_whole or twice = 1").select("gram", "low_doc", (F.col("low_whole") == F.col("high_whole")).alias("alike")))
    sweep(spark)
    # Both sides are dealt anew by a hash of the anchor, so a hot one can be split.
    some = source.mapInArrow(_segmented(spark.sparkContext.broadcast(_bitmap(shared))), _SEGMENTS)
    doubted = lambda c: F.when(~F.col("alike"), F.col(c)).alias(c)
    hits = written(spread_join(some, shared, ["gram"]).where("not alike or doc > low_doc or again = 1").select("doc", "body", "start", "last", "again", "alike", doubted("gram"), doubted("whole")))
    drop(shared)
    kinds = hits.where("not alike").groupBy("gram", "whole").agg(F.min("doc").alias("first"))
    mixed = written(spread_join(hits.where("not alike"), kinds, ["gram", "whole"]).select("doc", "body", "start", "last", "gram", "again", "first"))
    alike = written(hits.where("alike").select("doc", "body", "start", "last"))
    drop(hits)
    later = [alike, mixed.where("doc > first or again = 1")]
    doubt = mixed.where("doc = first and again = 0").groupBy("doc", "body").agg(F.collect_list(F.struct("start", "last", "gram")).alias("doubt"))  # as many as the document has segments
    rows = lambda which: source.withColumn("doc_id", F.col("doc")).mapInArrow(_sure(_documents(which), True), _PACKED)
    cores = written(spread_join(rows(mixed.where("doc = first and again = 0")).select("doc", "body", "packed"), doubt, ["doc", "body"]).select("doc", "body", "packed", "doubt").mapInArrow(_cores, _CORES).withColumn("slice", F.coalesce(F.pmod("core", F.lit(SLICES)), F.lit(0)).cast("int")), by="slice")
    sweep(spark)
    later.append(cores.where("core is null").select("doc", "body", "starts").mapInArrow(_single, "doc long, body long, start int, last int"))
    lasts = []
    for k in range(SLICES):  # one after another, so that the rows of windows take a quarter of the disk
        mine = cores.where((F.col("slice") == k) & F.col("core").isNotNull())
        common = mine.groupBy("gram", "core", "core2").agg(F.count("*").alias("n")).where("n > 1").select("gram", "core", "core2")
        windows = written(spread_join(mine, common, ["gram", "core", "core2"]).select("doc", "body", "core", "starts", "names").mapInArrow(_unrolled, "doc long, body long, core long, start int, name long"))
        earliest = windows.groupBy("core", "name").agg(F.min("doc").alias("first"), F.max("doc").alias("final")).where("first <> final").select("core", "name", "first")
        lasts.append(written(spread_join(windows, earliest, ["core", "name"]).where("doc > first").select("doc", "body", "start").withColumn("last", F.col("start"))))
        drop(windows)
    later += lasts
    runs = later[0].select("doc", "body", "start", "last")
    for x in later[1:]:
        runs = runs.unionByName(x.select("doc", "body", "start", "last"))
    runs = written(runs.groupBy("doc", "body").agg(F.collect_set(F.struct("start", "last")).alias("runs")))  # as many as the document has windows
    for x in (cores, mixed, alike, *lasts):
        drop(x)
    touched = _documents(runs)
    clean = base.mapInArrow(_sure(touched, False), _RESULT)
    packed = base.mapInArrow(_sure(touched, True), _PACKED)
    return clean.unionByName(spread_join(packed, runs, ["doc", "body"], "left").select("doc_id", "packed", "runs").mapInArrow(_removed, _RESULT))


def _documents(rows: DataFrame):
    """A broadcast bitmap of the documents of ``rows`` (doc, body): it spares the shuffle of the others, and changes no result."""
    return rows.sparkSession.sparkContext.broadcast(_bitmap(rows.select("doc", "body").distinct().mapInArrow(_marked, "gram long")))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
