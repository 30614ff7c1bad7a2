"""The corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents.

Defined results: null and empty texts fail the quality rules' word count and go; long texts are judged
whole; of equal texts and repeated rows near-dedup keeps one, by the smallest doc_id, a null id last;
an empty table gives an empty table with all columns; further columns of any name stay, but for
``shard`` and ``slot``, which the last stage sets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratagrid.llm import decontam, mixing, neardup, quality, sharding
from stratagrid.session import shared_dir, table

SHARDS = 24


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bad lines go, and documents that fail the rules or lost too much with their lines."""
    return quality.clean(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return neardup.keep(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, so that domains meet their target weights."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard and the slot that the uniform shuffle gives them."""
    return sharding.shuffled(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_neardup", neardup_stage),
    ("decontamination", decontam_stage),
    ("mixing", mixing_stage),
    ("sharding", shard_stage),
]

#: Drawing, hashing and clustering have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
