"""Near-duplicate detection by min-max hashing.

A document is the set of its five-word shingles. Each permutation of the hashed shingles gives two values, the minimum and the
maximum, so ``BANDS`` bands of two permutations take 2 x BANDS permutations for 4 x BANDS values. Documents with the same set
are one class; a class's bands are its buckets. A pair at the threshold of 0.75 shares a band with a probability above 0.3 (0.25
for the smallest sets), so all 48 bands miss it with one of less than 1e-5.

Links are confirmed on full sets, and no bucket is ever expanded into all its pairs:
1. each bucket's first class is compared with the others of the bucket (a star);
2. components are formed; a bucket whose classes are all in one component is done;
3. in each other bucket, the classes outside the component of its first one are compared with two classes of that component;
4. for the classes of buckets that still hold several components, every pair that can be linked is found exactly: shingles are
   ordered from rare to frequent, and a linked pair's first common shingle must leave both enough shingles for the overlap (a
   prefix filter with positions). A shingle's rows outside its main component are joined with its other rows; the bound is a
   condition of the join, so that the unlike pairs of a large group of near copies are not made.
Pairs that sizes rule out, and pairs that were compared before, are not compared.

Cases: ASCII letters are lower-cased, words are separated by space and tab to carriage return. A text of fewer than five words
is one shingle; without words (or null) its set is empty and it is linked with nothing. Equal sets of any number, and groups of
near copies of any size, are joined through skew-proof exchanges. Of rows that repeat a doc_id one at most is kept; null ids come
last. Very long texts are shingled whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bytes, boxed, rest, slices, small_batches, spread_join, unboxed, written
from .components import components

WORDS = 5
PERCENT = 75
BANDS = 48
_CACHE_BYTES = 32_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "row long, doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, packed binary"
_HASHES: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > 400_000:
        _HASHES.clear()
    known, digest = _HASHES, xxhash.xxh3_64_intdigest
    for w in set(words).difference(known):
        known[w] = digest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total = _mix(total * _BASE + h[k : len(h) - n + 1 + k])
    return np.unique(total)


def _permutations(bands: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1 << 62, 1 << 63, 2 * bands, np.uint64) | np.uint64(1)


def signature(found: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation (multiplication by an odd number), as rows of two."""
    out = np.empty((len(multipliers), 2), np.uint64)
    step = max(1, 4_000_000 // max(1, len(found)))
    with np.errstate(over="ignore"):
        for i in range(0, len(multipliers), step):
            all_of = multipliers[i : i + step, None] * found[None, :]
            out[i : i + step, 0], out[i : i + step, 1] = all_of.min(1), all_of.max(1)
    return out


def band_keys(found: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of two permutations."""
    values = signature(found, multipliers).reshape(-1, 4)
    with np.errstate(over="ignore"):
        key = np.arange(len(values), dtype=np.uint64)
        for k in range(4):
            key = _mix(key * _BASE + values[:, k])
    return key.view(np.int64)


def _signed(bands: int):
    def run(batches):
        import pyarrow as pa
        import xxhash
        import zstandard

        squeeze, multipliers = zstandard.ZstdCompressor(level=3).compress, _permutations(bands)
        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                n, hi, lo, keys, packed = [], [], [], [], []
                for text in arrow_bytes(part.column("text")):
                    found = shingles(text)
                    name = xxhash.xxh3_128_digest(found.tobytes())
                    n.append(len(found))
                    hi.append(int.from_bytes(name[:8], "big", signed=True))
                    lo.append(int.from_bytes(name[8:], "big", signed=True))
                    keys.append(band_keys(found, multipliers) if len(found) else None)
                    packed.append(squeeze(text) if len(found) else None)
                yield pa.record_batch([part.column("row"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())], names=["row", "doc_id", "n_shingles", "set_hi", "set_lo", "bands", "packed"])

    return run


def _confirmed(percent: int):
    def run(batches):
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        cache: dict[int, np.ndarray] = {}
        held = 0

        def found(node, packed):
            nonlocal held
            if node not in cache:
                if held > _CACHE_BYTES:
                    cache.clear()
                    held = 0
                cache[node] = shingles(expand(packed.as_py()))
                held += cache[node].nbytes
            return cache[node]

        for batch in batches:
            a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            left, right = batch.column("left"), batch.column("right")
            for i in range(len(a)):
                x, y = found(a[i], left[i]), found(b[i], right[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(keep, pa.bool_())})

    return run


def _tested(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, without those whose sizes rule a link out; the text of a class travels to its pairs."""
    for side in ("a", "b"):
        pairs = spread_join(pairs, sizes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}")), [side])
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")
    half = spread_join(pairs, texts.select(F.col("node").alias("b"), F.col("packed").alias("right")), ["b"])
    whole = spread_join(half, texts.select(F.col("node").alias("a"), F.col("packed").alias("left")), ["a"])
    return whole.select("a", "b", "left", "right").mapInArrow(_confirmed(percent), "a long, b long, linked boolean")


def _classes(rows: DataFrame) -> DataFrame:
    """row, node of the rows with shingles; the node is the first row with the same set."""
    held = rows.where("n_shingles > 0").select("row", "set_hi", "set_lo")
    return spread_join(held, held.groupBy("set_hi", "set_lo").agg(F.min("row").alias("node")), ["set_hi", "set_lo"]).select("row", "node")


def _exploded(batches):
    import pyarrow as pa
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for node, component, packed in zip(batch.column("node").to_pylist(), batch.column("component").to_pylist(), batch.column("packed"), strict=True):
            found = shingles(expand(packed.as_py())).view(np.int64)
            n = len(found)
            yield pa.record_batch({"node": np.full(n, node), "component": np.full(n, component), "n": np.full(n, n), "shingle": found})


def _possible(texts: DataFrame, at: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of ``at`` (node, component) in different components, with all those that are linked."""
    held = written(spread_join(at, texts.select("node", "packed"), ["node"]).mapInArrow(_exploded, "node long, component long, n long, shingle long"))
    shared = held.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    # A shingle's place from the end of its document: as many shingles can be common if it is the first common one.
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("times"), F.desc("shingle")))
    prefix = written(spread_join(held, shared, ["shingle"]).withColumn("rest", place).where(F.col("rest") * 100 >= F.col("n") * percent).drop("times"))
    by = prefix.groupBy("shingle", "component").agg(F.count("*").alias("times"))
    main = by.groupBy("shingle").agg(F.max_by("component", F.struct("times", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    rows = written(spread_join(prefix, main, ["shingle"]))
    other = rows.select("shingle", F.col("node").alias("o_node"), F.col("component").alias("o_component"), F.col("n").alias("o_n"), F.col("rest").alias("o_rest"))
    enough = F.least("rest", "o_rest") * (100 + percent) >= (F.col("n") + F.col("o_n")) * percent
    once = (F.col("o_component") == F.col("main")) | (F.col("node") < F.col("o_node"))
    met = spread_join(rows.where("component <> main"), other, ["shingle"]).where((F.col("component") != F.col("o_component")) & once & enough)
    return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def links(rows: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes that are linked with another class."""
    first = classes.where("row = node").select("node")
    buckets = rows.where("n_shingles > 0").select(F.col("row").alias("node"), F.explode("bands").alias("key")).join(first, "node", "left_semi")
    lead = buckets.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    members = written(spread_join(buckets, lead, ["key"]))
    texts = written(rows.select(F.col("row").alias("node"), "packed", "n_shingles").join(members.select("node").distinct(), "node", "left_semi"))
    sizes = texts.select("node", "n_shingles")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return written(_tested(pairs, texts, sizes, percent))

    def joined(new: DataFrame, found: DataFrame) -> DataFrame:
        return components(new.where("linked").select("a", "b").unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    def mixed(members: DataFrame, found: DataFrame) -> DataFrame:
        at = spread_join(members.select("key", "node"), found, ["node"], "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        several = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "node").alias("main")).where("low <> high")
        return written(spread_join(at, several.select("key", "main"), ["key"]))

    stars = confirmed(members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    found = components(stars.where("linked").select("a", "b"))
    rest(rows.sparkSession)
    members = mixed(members, found)
    order = F.xxhash64("node")
    pivots = members.where("component = main").groupBy("key").agg(F.min_by("node", order).alias("low"), F.max_by("node", order).alias("high"))
    met = spread_join(members.where("component <> main").select("key", "node"), pivots, ["key"]).select("node", F.explode(F.array("low", "high")).alias("other"))
    more = confirmed(_fresh(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), stars))
    found = joined(more, found)
    rest(rows.sparkSession)
    at = mixed(members, found).select("node", "component").distinct()
    last = confirmed(_fresh(_possible(texts, at, percent), stars.unionByName(more)))
    return joined(last, found)


def _fresh(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """``pairs`` (a, b) without those in ``tested``."""
    return spread_join(pairs, tested.select("a", "b", F.lit(1).alias("seen")), ["a", "b"], "left").where("seen is null").select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, class_id (rows with equal sets) and row.

    row: a column of ``docs`` with unique integers; rows are numbered here if it is not given."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    small_batches(docs.sparkSession)
    base = docs.select(number.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rest(docs.sparkSession)
    rows = written(base.mapInArrow(_signed(bands), _ROWS))
    classes = written(_classes(rows))
    rest(docs.sparkSession)
    found = links(rows, classes, percent)
    joined = spread_join(classes, found, ["node"], "left").select("row", "node", F.coalesce("component", "node").alias("component"))
    placed = written(rows.select("row", "doc_id", "n_shingles").join(joined, "row", "left").withColumn("component", F.coalesce("component", "row")))
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("row").alias("r"))).alias("first"))
    return spread_join(placed, first, ["component"]).select(
        "doc_id", "n_shingles", F.col("first.id").alias("component_id"), (F.col("first.r") == F.col("row")).alias("kept"), F.coalesce("node", "row").alias("class_id"), "row"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; same columns."""
    numbered = written(boxed(docs).withColumn("_row", F.monotonically_increasing_id()))  # the numbers must not change when a scan is repeated
    stay = near_groups(numbered, f"_doc.`{id_col}`", f"_doc.`{text_col}`", percent, row="_row").where("kept").select(F.col("row").alias("_row"))
    return unboxed(numbered.join(stay, "_row", "left_semi"), docs.columns)
