"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from votelake.llm import decontamination, mixing, quality, sharding, simhash
from votelake.llm.common import cut_wide, small_batches, table

#: Near copies share this much of their shingles of so many words.
WIDTH, SIMILARITY = 5, 0.8


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs, WIDTH, SIMILARITY)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot."""
    return sharding.shard_rows(docs, [c for c in ("doc_id", "n_chars", "source") if c in docs.columns], wide=True)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mixing", mixed), ("sharding", sharded)]
#: Fingerprints, singular vectors and balanced draws aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_wide(docs)
    return docs
