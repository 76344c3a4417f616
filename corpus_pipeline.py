"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality -> exact dedup -> near dedup -> mixing -> BPE.  All but the last return the columns of
``documents``; the last returns one row per document that is left, with its tokens' digests.

Every stage gives a result for null or empty texts, repeated rows and empty tables, as its operator's
module states; extra columns pass through the first four.  SQL cannot express the stages, so the
tests hold ``run`` against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm import bpe, exact_dedup, mixing, near_dedup, quality
from tracefold.llm.common import clean, mark, materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), least=0.3)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier stays."""
    return exact_dedup.deduplicate(docs, keep="smallest")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, one document stays."""
    return near_dedup.deduplicate(docs, words=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by probabilities calibrated to source, language and topic targets."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that is left: doc_id, n_tokens and digests of ids and decoded text."""
    return bpe.digests(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage and its operator have written goes once the next one is stored."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clean(spark, since, keep=docs)
    return docs
