"""From raw documents to tokens: five stages, each one operator over all that the stage before kept.

Nulls and edge cases: a null or empty text goes through all stages as it is (its
score is the intercept's) and ends with no tokens; a null id is kept; of near
copies with one id or none, one stays; extra columns of any name stay until the
last stage; an empty table gives an empty result. The stages' results stay in the
shared folder with their session's checkpoints; what a stage stores on its way
goes when its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, quality
from trackloom.llm.decontamination import drop_contaminated
from trackloom.llm.ngram_join import keep_first_of_each
from trackloom.llm.substring_dedup import substring_dedup
from trackloom.plans.lineage import scratch, shared_dir

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAST_QUALITY = 0.3
#: Training, the joins and the decoding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality score of ``LEAST_QUALITY`` or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.train(docs, labels, "quality", lambda i: quality.fold(i, 5) == 0)
    return quality.keep_good(docs, weights, LEAST_QUALITY)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id (null last), then the smallest hash of its text; rows without words all stay."""
    return keep_first_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages of 13 words or more that a smaller id has too; n_chars is counted anew."""
    return substring_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than 5 % of the words stand in benchmark items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and the digests of ids and decoded bytes; a null text has no tokens."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", keep_uncontaminated),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
