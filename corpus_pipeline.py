"""From raw documents to training shards: five stages, each one operator over all that the one before kept.

Null and empty texts are judged like any other (the network scores an empty text; all of them are one near duplicate),
null ids sort last and are kept, equal rows count once after the near-duplicate stage, very long texts are read whole
and in pieces, an empty table gives an empty result, and further columns are carried along until the last stage, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parcelwise.llm import decontaminate, mixing, quality, sharding, simhash
from parcelwise.session import shared_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, eight tenths or more alike."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and its slot there."""
    return sharding.digest(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mix", mixed), ("shards", sharded)]

# SQL cannot express the network, the fingerprints and the draws; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
