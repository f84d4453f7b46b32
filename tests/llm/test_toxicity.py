"""What scoring by nearest examples costs, with the same neighbours."""

import numpy as np
import pytest

from crategraph import shared
from crategraph.llm import toxicity

from .conftest import prose


@pytest.mark.parametrize("in_a_row", [0.0, 0.3, 1.0])
def test_blocks_are_not_tried_again_where_they_spared_nothing(monkeypatch, in_a_row):
    for name, value in (("OFTEN", 0.5), ("COMMON", 4), ("BLOCK", 8), ("DENSE", in_a_row)):
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(2)
    dense = rng.random((400, 40)) * (rng.random((400, 40)) < 0.15)
    dense[np.arange(400), rng.integers(0, 40, 400)] += 0.1
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows, terms = np.nonzero(dense)
    index = toxicity.Index.build(rows, terms, dense[rows, terms], np.zeros(400, int), 40)
    whole, sums = index._lists, toxicity.Index._sums
    calls = []
    monkeypatch.setattr(index, "_lists", lambda *x: calls.append("lists") or whole(*x))
    monkeypatch.setattr(toxicity.Index, "_sums", lambda *x: calls.append("sums") or sums(*x))
    for q in dense[:128]:
        t = np.flatnonzero(q)
        s, e = index.nearest(t, q[t], 10)
        assert np.allclose(s, np.sort(dense @ q)[::-1][:10]) and np.allclose(dense[e] @ q, s)
    if in_a_row == 0:  # rare terms' sums for each text, blocks for one in 32
        assert calls.count("lists") == 128 and calls.count("sums") == 128 + 128 // (toxicity.PAUSE + 1)
    if in_a_row == 1:
        assert "lists" not in calls


def test_terms_are_found_among_hashes_of_equal_beginnings():
    rng = np.random.default_rng(3)
    terms = np.unique(np.concatenate([rng.integers(0, 1 << 64, 5_000, np.uint64), np.arange(40, dtype=np.uint64), (np.uint64(77) << np.uint64(44)) + np.arange(0, 60, 3, dtype=np.uint64), np.array([(1 << 64) - 1], np.uint64)]))
    asked = np.concatenate([terms, terms + np.uint64(1), rng.integers(0, 1 << 64, 5_000, np.uint64)])
    asked = asked[rng.permutation(len(asked))]
    known, at = toxicity.Vocabulary(terms[::-1], np.zeros(0, np.int64)).find(asked)
    assert known.tolist() == np.flatnonzero(np.isin(asked, terms)).tolist() and np.array_equal(terms[at], asked[known])
    assert all(len(x) == 0 for x in toxicity.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64)).find(asked))


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_is_given_back():
    """Blocks too small for maps of their own, with one kept at the top, stay with the process unless it is asked to return them."""
    held = [bytearray(100_000) for _ in range(1_500)]
    last = bytearray(100_000)
    full = resident()
    del held
    shared.give_back()
    assert full - resident() > 100_000_000 and len(last)


def test_fit_gives_memory_back(spark, monkeypatch):
    times = []
    monkeypatch.setattr(toxicity, "give_back", lambda: times.append(1))
    docs = spark.createDataFrame([(k, prose(k, 40)) for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(80)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).index is not None and len(times) == 2
