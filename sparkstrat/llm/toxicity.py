"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

The ordinary dictionary is trained by zstandard (``train_dictionary``) on windows of ordinary rows. Most words of a toxic text are
ordinary, so the toxic dictionary is the ordinary one with a beginning made from the telling words of toxic rows: words with a gram of
``GRAM`` characters that stands in more toxic rows than chance allows (Dunning's log-likelihood ratio) and at least ``LIFT`` times
as often as in ordinary rows. What is left of those words without their most telling gram begins the ordinary dictionary, which is the end of
both. So both compress ordinary text alike. The toxic beginning is either trained by zstandard on those words of each row, after the words that
the trainer left out, or a list of the words alone; the ratio's level is one of ``LEVELS``. Folds choose among these.

Each overlapping window of a lower-cased text is compressed with both dictionaries. The largest difference of the lengths, the
sum of those above ``SLACK`` bytes, by itself and for each window, and the number of windows go through a logistic curve, whose 0.5
is the threshold. Choice and curve rest on folds: a training row's differences come from dictionaries that were made without the row's
fold (copies and near copies share a fold), so the curve sees what unseen rows look like. Both classes weigh alike in it.

Dictionaries and curve are fitted on at most ``sample`` labelled rows of each label (those with the smallest hashed ids), which are
written once; of rows that begin and end alike in shingle hashes one stays. ``WINDOWS`` windows of each ordinary row are trained on.
All texts are scored whole. Language is no input.

Cases: null and empty texts get the score of a text without any difference. Rows without a label are scored like others; labels
other than 0 and 1 and rows without id are not learnt from; a doc_id that repeats in ``labels`` or ``docs`` is learnt from once for
each shingle hash, and repeated rows of ``docs`` get a score each. If no row is labelled, or only one label occurs, every score is 0.
Ties of hashed ids go to the smaller id. Texts of any length are windowed to the end. Extra columns, of any name, are ignored.
Empty tables give an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

SAMPLE = 3000
FOLDS = 3
WINDOW = 64
OVERLAP = 16
LEVEL = 9
GRAM = 5
SLACK = 2
SIZE = 16384
LIFT = 4.0
LEVELS = (12.0, 24.0, 60.0)
WAYS = ("trained", "listed")
CHOICES = tuple(itertools.product(WAYS, LEVELS))
WINDOWS = 4
_EDGE = ".,;:!?()[]{}\"'|*#$%&"
_LEARN = "doc_id long, toxic int, text string, lo long, hi long"


def hash_of(*words: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def words_of(text: str) -> set[str]:
    return {w for w in (x.strip(_EDGE) for x in text.lower().split()) if 2 < len(w) < 32}


def grams_of(word: str) -> set[str]:
    marked = f" {word}"
    return {marked[i : i + GRAM] for i in range(max(1, len(marked) - GRAM + 1))}


def _ends(batches):
    """Rows with the smallest and the largest hash of their five-word shingles."""
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch, "text", 4_000_000):
            lo, hi = [], []
            for text in part.column("text").to_pylist():
                words = text.lower().split()
                found = [hash_of(*words[i : i + 5]) for i in range(max(1, len(words) - 4))]
                lo.append(min(found))
                hi.append(max(found))
            yield pa.record_batch([part.column("doc_id"), part.column("toxic"), part.column("text"), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["doc_id", "toxic", "text", "lo", "hi"])


def _grams(batches):
    """How many rows of a class and a fold hold a gram."""
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch, "text", 4_000_000):
            seen: dict[tuple, int] = {}
            for text, toxic, fold in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                for g in set().union(*map(grams_of, words_of(text))):
                    seen[g, toxic, fold] = seen.get((g, toxic, fold), 0) + 1
            g, toxic, fold = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.record_batch({"gram": pa.array(g, pa.string()), "toxic": pa.array(toxic, pa.int32()), "fold": pa.array(fold, pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})


def rests(word: str, ratios: dict[str, float]) -> list[str]:
    """What is left of a telling word on either side of its most telling gram, where that is long enough to be found again."""
    gram = max(grams_of(word), key=lambda g: (ratios.get(g, 0.0), g))
    before, _, after = f" {word}".partition(gram)
    return [x for x in (before.strip(), after) if len(x) > 2]


def _samples(telling):
    """What dictionaries are made from: (fold left out, level, sample); fold ``FOLDS`` leaves nothing out. The level is -1 for ordinary
    windows, and larger by the number of levels for what is left of telling words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                folds = sorted(set(range(FOLDS + 1)) - {fold})
                if toxic:
                    held = [(w, grams_of(w)) for w in sorted(words_of(text))]
                    for left, level in itertools.product(folds, range(len(LEVELS))):
                        grams = telling.value[left][level]
                        found = [w for w, g in held if not grams.keys().isdisjoint(g)]
                        rest = [x for w in found for x in rests(w, grams)]
                        out += [(left, k, " " + " ".join(x)) for k, x in ((level, found), (level + len(LEVELS), rest)) if x]
                else:
                    data = " ".join(text.lower().split())
                    parts = sorted({data[i : i + WINDOW] for i in range(0, len(data), WINDOW)}, key=hash_of)[:WINDOWS]
                    out += [(left, -1, f" {p}") for left in folds for p in parts]
            yield pa.record_batch({k: pa.array(c, t) for k, t, c in zip(("left", "level", "sample"), (pa.int32(), pa.int32(), pa.string()), zip(*out, strict=True) if out else ((),) * 3, strict=True)})

    return run


def trained(samples: list[str], size: int = SIZE) -> bytes:
    """A dictionary that zstandard trains; where it finds too little to train on, the samples themselves."""
    import zstandard

    data = [s.encode() for s in sorted(samples)]
    raw = b"".join(data)
    try:
        return zstandard.train_dictionary(min(size, max(256, len(raw) // 4)), data, k=48, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return raw[-size:]


def listed(samples: list[str], size: int = SIZE) -> bytes:
    """The words of the samples, the most frequent ones last."""
    times = Counter(w for s in samples for w in s.split())
    return "".join(f" {w}" for w in sorted(times, key=lambda w: (times[w], w))).encode()[-size:]


def complete(samples: list[str]) -> bytes:
    """A dictionary that zstandard trains, after the words of the samples that it left out."""
    known = trained(samples)
    return listed([w for s in samples for w in s.split() if w.encode() not in known]) + known


def dictionaries(samples: dict[int, list[str]], way: str, level: int) -> tuple[bytes, bytes]:
    """(toxic, ordinary); samples: by level, as ``_samples`` gives them."""
    common = listed(samples.get(level + len(LEVELS), [])) + trained(samples.get(-1, []))
    return {"trained": complete, "listed": listed}[way](samples.get(level, [])) + common, common


class Distance:
    """Differences of compressed lengths of a text's windows."""

    def __init__(self, toxic: bytes, ordinary: bytes, window: int = WINDOW, overlap: int = OVERLAP):
        import zstandard

        make = lambda x: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        self.toxic, self.ordinary, self.window, self.step = make(toxic).compress, make(ordinary).compress, window, window - overlap

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Largest difference of a window; roots of the sum of those above SLACK bytes and of its mean; logarithm of the number of windows."""
        data = f" {(text or "").lower()} ".encode()
        most = total = n = 0
        for i in range(0, max(1, len(data) - self.window + self.step), self.step):
            part = data[i : i + self.window]
            d = len(self.ordinary(part)) - len(self.toxic(part))
            most = max(most, d)
            total += d if d > SLACK else 0
            n += 1
        return most / 8, math.sqrt(total) / 4, math.log(n + 1) / 4, math.sqrt(total / n)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (constant first) of a logistic regression with a slight ridge, by Newton's steps; both classes weigh alike."""
    a = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(len(w)), a.T @ (weight * (y - p)) - 0.01 * w)
    return w


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Logarithmic loss, both classes alike."""
    p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
    return float(-np.log(p[y == 1]).mean() - np.log(1 - p[y == 0]).mean())


def _featured(pairs):
    """toxic, choice and features of each row, by each choice's dictionaries that leave its fold out."""

    def run(batches):
        import pyarrow as pa

        distances: dict[tuple, Distance] = {}
        for batch in batches:
            out = []
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                for choice in range(len(CHOICES)):
                    if (choice, fold) not in distances:
                        distances[choice, fold] = Distance(*pairs.value[choice][fold])
                    out.append((toxic, choice, distances[choice, fold].features(text)))
            toxic, choice, x = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(toxic, pa.int32()), pa.array(choice, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "choice", "x"])

    return run


def _ratio(t: str, o: str, share: float):
    """Dunning's log-likelihood ratio of a gram in ``t`` toxic and ``o`` ordinary rows, where ``share`` of the text is toxic; 0 below LIFT."""
    part = lambda n, p: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col(t) + F.col(o)) * p))).otherwise(0.0)
    lifted = F.col(t) * (1 - share) >= LIFT * (F.col(o) + 0.5) * share
    return F.when(lifted, 2 * (part(t, share) + part(o, 1 - share))).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE):
    """(toxic dictionary, ordinary dictionary, weights of the curve); None where the labels are not of both kinds.

    labels: rows to learn from, with the id and a label of 0 or 1; others are left out."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    ids = {(r.doc_id, r.toxic) for y in (0, 1) for r in marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if len({y for _, y in ids}) < 2:
        return None
    chosen = F.broadcast(spark.createDataFrame(sorted(ids), "doc_id long, toxic int"))  # at most 2 x sample rows
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id").where("text is not null")
    rows = written(rows.select("doc_id", "toxic", "text").mapInArrow(_ends, _LEARN))
    # Copies and near copies would make the words of one text look frequent: one of them is enough to learn from.
    single = rows.groupBy("toxic", "lo").agg(F.min_by("hi", "doc_id").alias("hi"), F.min("doc_id").alias("doc_id")).groupBy("toxic", "hi").agg(F.min("doc_id").alias("doc_id"))
    rows = written(rows.join(F.broadcast(single.select("doc_id", "toxic")), ["doc_id", "toxic"]).withColumn("fold", F.pmod(F.xxhash64("lo"), F.lit(FOLDS)).cast("int")))
    chars = {(r.toxic, r.fold): r.n for r in rows.groupBy("toxic", "fold").agg(F.sum(F.length("text")).alias("n")).collect()}
    if len({y for y, _ in chars}) < 2:
        return None
    of = lambda y, left: sum(n for (t, fold), n in chars.items() if t == y and fold != left) or 1
    counts = rows.select("text", "toxic", "fold").mapInArrow(_grams, "gram string, toxic int, fold int, n long").groupBy("gram").agg(
        *[F.coalesce(F.sum(F.when((F.col("toxic") == y) & (F.col("fold") != left), F.col("n"))), F.lit(0)).alias(f"{c}{left}") for left in range(FOLDS + 1) for y, c in ((1, "t"), (0, "o"))]
    )
    ratios = counts.select("gram", *[_ratio(f"t{k}", f"o{k}", of(1, k) / (of(1, k) + of(0, k))).alias(f"g{k}") for k in range(FOLDS + 1)])
    found = ratios.where(F.greatest(*[F.col(f"g{k}") for k in range(FOLDS + 1)]) >= min(LEVELS)).collect()  # bounded by the sample
    telling = spark.sparkContext.broadcast([[{r.gram: r[f"g{k}"] for r in found if r[f"g{k}"] >= level} for level in LEVELS] for k in range(FOLDS + 1)])
    samples: dict[int, dict[int, list[str]]] = {k: {} for k in range(FOLDS + 1)}
    for r in rows.select("text", "toxic", "fold").mapInArrow(_samples(telling), "left int, level int, sample string").collect():  # of at most 2 x sample rows
        samples[r.left].setdefault(r.level, []).append(r.sample)
    pairs = [[dictionaries(samples[k], way, LEVELS.index(level)) for k in range(FOLDS + 1)] for way, level in CHOICES]
    table = rows.select("text", "toxic", "fold").mapInArrow(_featured(spark.sparkContext.broadcast(pairs)), "toxic int, choice int, x array<double>").toPandas()
    fitted = []
    for choice in range(len(CHOICES)):
        mine = table[table["choice"] == choice]
        x, y = np.array(mine["x"].tolist(), float), mine["toxic"].to_numpy(float)
        w = _logistic(x, y)
        fitted.append((_loss(x, y, w), choice, w))
    _, best, w = min(fitted, key=lambda f: f[:2])
    return *pairs[best][FOLDS], w


def _scored(model):
    def run(batches):
        import pyarrow as pa

        distance, w = Distance(*model.value[:2]), model.value[2]
        for batch in batches:
            x = np.array([distance.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(w) - 1)
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        out = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        out = rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
