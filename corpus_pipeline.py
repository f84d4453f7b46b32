"""A corpus pipeline of five stages, each one operator of ``crategraph.llm`` over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir). ``run`` writes each stage's result as Parquet in the shared folder and reads it
back for the next. All stages but the last return the columns of ``documents``; the last adds shard, depth, shard_bytes and
n_bytes. Null and empty texts pass all stages; repeated rows fall to the near-duplicate stage; extra columns are kept,
those that are named like one of the last stage's as ``input_`` and their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crategraph.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from crategraph.shared import scratch, table

#: Score from which a document is rejected, repetitions of a source at most, bytes of text in a shard at most.
TOXIC, REPETITIONS, SHARD_BYTES = 0.3, 2.0, 32 << 20


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose nearest labelled examples are toxic; learns from the labelled rows among ``docs``."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each near-duplicate class."""
    return near_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a passage of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Read every document once and those of small sources again, as the tempered weights ask; rows repeat accordingly."""
    return mixing.apply(docs, mixing.plan(docs, repetition_limit=REPETITIONS))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard each goes to."""
    return sharding.shard(docs, limit=SHARD_BYTES)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The first three stages are models, sketches and alignments; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
