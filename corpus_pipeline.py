"""The corpus pipeline: documents that are identified, unique, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from assaykit.llm.shared import small_batches, table, written

ORACLE_SQL = None   # language models and tokenizers are not SQL; see tests/llm/test_queries.py


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the rest go."""
    small_batches(spark)
    model = language_id.fit(docs, ~language_id.held_out())
    return language_id.keep_identified(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    small_batches(spark)
    return exact_dedup.deduplicate(docs)


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language_id", identify), ("exact_dedup", deduplicate), ("jaccard_join", join_near),
          ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each reading what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
