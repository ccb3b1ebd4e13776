"""The ``opN_*`` queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, quality
from trackloom.llm.chat import conversation_digests, format_windows
from trackloom.llm.decontamination import find_contamination
from trackloom.llm.exact_dedup import exact_dedup
from trackloom.llm.hard_negatives import mine_hard_negatives
from trackloom.llm.license_scan import scan_licenses
from trackloom.llm.media import media_columns
from trackloom.llm.ngram_join import near_duplicates
from trackloom.llm.substring_dedup import dedup_digests
from trackloom.llm.toxicity import score_toxicity
from trackloom.llm.url_filter import with_verdicts
from trackloom.llm.whitening import fit_whitening, whiten

# The rules of op5.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
# The conversation that op3 adds.
MARKERS = "</s>[INST] ok [/INST]"
VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", MARKERS), (-1, 1, "assistant", MARKERS)], turns.schema)
    return conversation_digests(format_windows(turns.union(more)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels"), "quality", lambda i: quality.fold(i, 5) == 0)
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = quality.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), lambda i: quality.fold(i, 4) == 2)
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it doesn't fit a long."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit_whitening(rows, components=4)
    n, explained, error = (model.n, model.explained.tolist(), model.identity_error) if model else (0, [], 0.0)
    out = whiten(rows, model).select("vec_id", F.posexplode("whitened").alias("k", "whitened"), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"))
    share = F.element_at(F.array(*[F.lit(x) for x in explained]).cast("array<double>"), F.col("k") + 1)
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine_hard_negatives(rows, lambda i: i % 50 == 0)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
