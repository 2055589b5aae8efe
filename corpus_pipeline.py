"""Corpus preparation in five stages, each written as Parquet and read again for the next.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and but
for the last returns the columns of `documents`:

1. quality_rules: rows that the base rule or the learned decision list rejects go.
2. near_dedup: one row of each near-duplicate class stays, that of the smallest id.
3. decontamination: rows that hold an item of the benchmark go.
4. mixture: rows are dropped, kept or repeated by rates that move the expected tokens of
   the domains, four languages and toxic texts, to the target shares.
5. shard_ring: every row gets its shard and slot.

SQL cannot express the learned stages, so there is no SQL for the whole. The tests hold the
operators of all stages against brute force or plain Python on small tables, and the stages
against each other's decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almagest.llm import decontamination, mixture, order_minhash, quality_rules, sharding
from almagest.llm.common import documents, settled

SHARDS = 24
#: Shares of tokens that the mixture aims at.
WEIGHTS = {"en": 0.62, "fr": 0.145, "de": 0.13, "es": 0.105, "toxic": 0.0}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs, mixture.language_domains(docs, _labels(spark, sf_dir)), WEIGHTS)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixture", mixture_stage),
    ("shard_ring", shard_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
