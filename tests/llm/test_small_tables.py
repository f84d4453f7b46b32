"""Many partitions of few rows: near-duplicate classes read settled tables in few tasks and leave no shuffle files behind."""

import time

import pytest
from pyspark.sql import functions as F

from crategraph.llm import near_dedup
from crategraph.shared import settle

WORDS = [f"w{k}" for k in range(60)]


@pytest.fixture
def scattered(spark):
    """A shuffle has 24 partitions, which stay."""
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _docs(spark):
    """Six texts of sixty words that differ in one, near the ends of most, and another text."""
    texts = [" ".join(WORDS[:k] + [f"x{k}"] + WORDS[k + 1 :]) for k in (0, 1, 30, 58, 59)] + ["quite another text of a few words", " ".join(WORDS)]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_settled_tables_are_read_in_few_tasks(scattered):
    _, bags, _ = near_dedup._classes(_docs(scattered), "doc_id", "text", 0.8)
    assert bags.rdd.getNumPartitions() == 1
    assert bags.count() == 7


def test_shuffle_files_go_with_their_query(scattered):
    docs = _docs(scattered)
    assert {r["doc_id"] for r in near_dedup.keep_one(docs).collect()} == {0, 5}
    before = _shuffle_files(scattered)
    assert settle(docs.groupBy("text").agg(F.min("doc_id"))).count() == 7
    until = time.monotonic() + 10  # they are removed in the background
    while (left := _shuffle_files(scattered) - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
