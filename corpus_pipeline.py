"""A corpus pipeline of five stages: toxicity, exact dedup, near dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents, others beside them included; the last returns the pieces of the packed windows.

Null and empty texts aren't toxic; empty texts are copies of each other, null ones of nothing, and neither has near
copies; both are packed as pieces of length 0 if the mixture keeps them. Rows without an id pass the first three stages
unless they are exact copies; they stay or go together in the mixture. Of repeated rows one stays. Very long texts are
read whole. Of equal candidates the one with the least id stays. Columns may have any names. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from grovecut.llm import common, exact, mixing, ngramjoin, packing, toxicity
from grovecut.sources import paths

#: The share of the tokens that the mixture keeps.
KEEP_TOKENS = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, doesn't reject."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard connects."""
    return ngramjoin.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of KEEP_TOKENS of the tokens whose sources are in proportion to the square roots of what they have; sources with less than that are taken whole."""
    return mixing.mixed(docs, KEEP_TOKENS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix_sources), ("packing", pack_windows)]

#: Toxicity and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder and read again, and deleted when the next one is written."""
    common.shared(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            paths.delete(spark, f"{folder}/{k - 1}")
    return docs
