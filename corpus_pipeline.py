"""From raw documents to training shards: five stages, each one operator over all rows that its predecessor kept.

Rejects documents by quality, keeps one document of each near-duplicate class, removes contaminated documents, mixes
the sources to their target weights (a document may then stand in several copies), and deals the rest into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontamination, mixing, near_dedup, quality, sharding
from sparkloom.llm.common import stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = [c for c in docs.columns if c != "shard"]
    return sharding.assign(docs, keep=columns).select("row.*", "shard")


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: The stages' decisions (a fitted classifier, signatures, random rounding) are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `documents` that come through all stages, with their shard."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
