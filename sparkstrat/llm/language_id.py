"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 code points of lower-cased text in ``BUCKETS`` hash buckets for each language; the smoothed
log-probabilities are a matrix of languages x buckets, of at most ``max_langs`` x ``BUCKETS`` numbers, which is
broadcast. Scoring turns each Arrow batch into sparse (document, bucket) counts in numpy and multiplies them with the matrix.

The model is fitted on about ``sample`` labelled rows of each language (all rows of a language that has fewer), chosen by a hash of
the id, so that rare languages are learnt as well; everything else covers all rows. More than ``max_langs`` languages are an error.

Cases: a text that is null, empty or without a letter is ``und`` with score 0, as is every text if no row is labelled. Ties
between languages go to the alphabetically first. Very long texts are scored whole, a part at a time. The score is the
posterior of the chosen language at ``EVIDENCE`` n-grams, so that it does not saturate with length. Repeated rows count, and are
scored, each by itself. Null ids are learnt from like others. Extra columns, of any name, are ignored. Empty tables give an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, slices, unboxed

BUCKETS = 1 << 16
SAMPLE = 2000
MAX_LANGS = 256
EVIDENCE = 30.0
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, bucket) of every n-gram of 1 to 3 code points; n-grams do not cross documents."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in low], np.int64)
    doc = np.repeat(np.arange(len(low)), lengths)
    owners, buckets = [], []
    h = np.zeros(len(codes), np.uint32)
    for n in range(3):
        if len(codes) <= n:
            break
        h = (h[: len(codes) - n] ^ codes[n:]) * _MUL[n]
        h ^= h >> np.uint32(15)
        whole = doc[: len(codes) - n] == doc[n:]
        owners.append(doc[: len(codes) - n][whole])
        buckets.append((h & np.uint32(BUCKETS - 1))[whole].astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _counted(langs: list[str]):
    def run(batches):
        import pyarrow as pa

        at, total = {x: i for i, x in enumerate(langs)}, np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                owner, bucket = ngram_buckets(texts)
                lang = np.array([at[x] for x in part.column("lang").to_pylist()], np.int64)
                total += np.bincount(lang[owner] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.record_batch({"lang": pa.array([langs[i] for i in lang], pa.string()), "bucket": pa.array(bucket, pa.int32()), "n": pa.array(total[lang, bucket], pa.int64())})

    return run


def _vector(table):
    """One row for a language: its counts of all buckets."""
    import pyarrow as pa

    counts = np.zeros(BUCKETS, "<f4")
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return pa.table({"lang": [table.column("lang")[0].as_py()], "counts": [counts.tobytes()]})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, max_langs: int = MAX_LANGS):
    """(languages, float32 matrix of log-probabilities) from about ``sample`` rows of each language with text and language."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than max_langs = {max_langs} languages")
    langs = sorted(r.lang for r in sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    share = F.broadcast(labelled.sparkSession.createDataFrame([(r.lang, min(1.0, sample / r.n)) for r in sizes], "lang string, share double"))  # a row for each language
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    some = rows.join(share, "lang").where(place < F.col("share")).select("text", "lang")
    table = some.mapInArrow(_counted(langs), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = {r.lang: np.frombuffer(bytes(r.counts), "<f4") for r in table.groupBy("lang").applyInArrow(_vector, "lang string, counts binary").collect()}  # at most max_langs vectors
    counts = np.stack([found.get(x, np.zeros(BUCKETS, np.float32)) for x in langs]).astype(float) + 0.5
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def score(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    letters = [_has_letter(t) for t in texts]
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    total, n = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    owner, bucket = ngram_buckets([t if ok else "" for t, ok in zip(texts, letters, strict=True)])
    n += np.bincount(owner, minlength=len(texts))
    for k in range(len(langs)):
        total[:, k] = np.bincount(owner, weights=matrix[k][bucket], minlength=len(texts))
    best = total.argmax(1)
    mean = total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
    p = 1 / np.exp(mean - mean[np.arange(len(texts)), best][:, None]).sum(1)
    return [langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [float(x) if ok else 0.0 for x, ok in zip(p, letters, strict=True)]


def _scored(model):
    def run(batches):
        import pyarrow as pa

        langs, matrix = model.value
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                lang, p = score(part.column("text").to_pylist(), langs, matrix)
                keep = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"]
                yield pa.record_batch([*keep, pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=[*[x for x in part.schema.names if x != "text"], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``; model: what ``fit`` returns."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scored(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that have no letter or whose language is less sure than ``least`` (by default: it must be likelier than all
    others together); same columns. Without a model, all rows with a letter stay."""
    if not model[0]:
        return docs.where(F.col(text_col).cast("string").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def judged(text):
        import pandas as pd

        langs, matrix = shared.value
        texts, out, held, start = list(text), [], 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held > 2_000_000 or i == len(texts) - 1:
                out += list(zip(*score(texts[start : i + 1], langs, matrix), strict=True))
                start, held = i + 1, 0
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    verdict = judged(F.col(f"_doc.`{text_col}`").cast("string"))
    rows = boxed(docs).withColumn("_judged", verdict)
    return unboxed(rows.where((F.col("_judged.lang_pred") != "und") & (F.col("_judged.score") >= least)), docs.columns)
