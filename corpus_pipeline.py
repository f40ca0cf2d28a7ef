"""A corpus from documents: five stages, each written and read again before the next.

Stages 1 to 4 return the columns of documents, the last one adds slot and shard. Each works on all
rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkframe.llm import leaks, mixing, sharding, simhash, toxicity
from talkframe.llm.common import read
from talkframe.session import run_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.civil(docs, read(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return leaks.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence of the sources' mix; a repeated document has several rows."""
    return mixing.mixture(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with virtual slot and shard."""
    return sharding.shard_rows(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_leaks),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: A learned model and fingerprints of 64-bit hashes are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = run_folder(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
