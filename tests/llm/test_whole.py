"""Operators do their whole job on inputs that once made them lose some of it."""

import zlib

import pyarrow as pa
import pytest

from crategraph.llm import near_dedup, toxicity
from crategraph.llm import text as T

from .conftest import prose


@pytest.mark.parametrize("n", range(8))
def test_shingles_of_a_chunk_of_few_words(n):
    (chunk,) = T.chunks(pa.array([" ".join("abcdefgh"[:n])]))
    doc, value = T.shingles(T.words(chunk))
    assert len(doc) == len(set(value.tolist())) == (max(1, n - 4) if n else 0)


def test_near_duplicates_of_three_words(spark):
    rows = [(3, "one two three"), (4, "x " * 400_000), (5, "one two three")]  # the long text is a chunk of its own
    for some in (rows[:1], rows):
        docs = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()} == ({3: 3} if len(some) == 1 else {3: 3, 4: 4, 5: 3})


def test_nearest_examples_of_a_small_sample_under_all_words(spark):
    """Without words tied to the label there are neighbours still: a toxic example's near copy is told apart."""
    docs = [(k, prose(k, 60)) for k in range(200)]
    toxic = [k for k in range(0, 200, 10) if zlib.crc32(str(k).encode()) % 4 != 2]
    copies = [(1000 + k, docs[k][1] + " indeed") for k in range(200)]
    frame = spark.createDataFrame(docs + copies, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in toxic)) for k in range(200)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score(frame, toxicity.fit(frame, labels)).collect()}
    assert all(rows[1000 + k]["evidence"][0]["cosine"] > 0.9 for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2)
    assert min(rows[1000 + k]["score"] for k in toxic) > max(rows[1000 + k]["score"] for k in range(200) if k not in toxic)
