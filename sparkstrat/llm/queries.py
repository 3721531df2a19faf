"""The registered queries of the text operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, line_quality, near_dedup, packing, pii, substring_dedup, token_counts, toxicity
from .common import documents


def _crc(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("row")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(_crc("doc_id") % 3 != 1))
    held = (_crc("doc_id") % 3 == 1).alias("held_out")
    return language_id.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(documents(spark, sf_dir)).drop("gone", "host", "body")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir)).drop("row", "class_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pii.annotate(documents(spark, sf_dir).select("doc_id", "text")).withColumn("base", F.col("pii.base_spans"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    every = F.array_sort(F.concat(F.col("base"), F.col("pii.secret_spans"), F.col("pii.term_spans")))
    return marked.select("doc_id", *[count(k) for k in range(4)], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(every).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(_crc("doc_id") % 5 != 0))
    held = F.coalesce(_crc("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
