"""From raw documents to token ids: quality rules, quality classifier, near duplicates, source mix, byte BPE.

Every stage takes what its predecessor kept. All but the last return the
columns of ``documents``; the last returns one row of token ids per document of
the mix.
"""

from __future__ import annotations

import uuid
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import bpe, cotraining, mixing, ngram_join, quality_rules
from cohortwise.session import materialize, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    verdict = quality_rules.assess(docs, _labels(spark, sf_dir), keep=COLUMNS)
    return verdict.where("kept").select(*COLUMNS)


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it learns from the unfiltered table, which still has bad ones."""
    examples = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cotraining.classify(docs, _labels(spark, sf_dir), examples=examples).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of Jaccard 0.8 or more: the one of the smallest id.

    Of rows of one id in a group one stays, and of equal rows one. Texts without
    words, null ones too, are linked with nothing and stay.
    """
    rows = docs.select(*COLUMNS)
    row_key = F.xxhash64(*COLUMNS)
    stay = materialize(ngram_join.representatives(rows, row_key).withColumnRenamed("id", "stays"), "near_duplicates")

    def kept(which: str) -> DataFrame:
        chosen = stay.where(which).select("stays", F.col("key").alias("stays_key"))
        return rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("stays")) & (row_key == F.col("stays_key")), "left_semi")

    # Only rows that are known to repeat are shuffled with their texts to become one.
    return kept("rows = 1").unionByName(kept("rows > 1").dropDuplicates())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids."""
    pieces = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, pieces, public_tokenizers.PATTERN).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

# The learned stages can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        name, apply = stage
        path = new_path(spark, f"pipeline-{name}-{uuid.uuid4().hex[:8]}")
        apply(spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
