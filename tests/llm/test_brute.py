"""Operators that SQL can't express, against plain versions of themselves or held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from crategraph.llm import decontaminate, language_model, mixing, near_dedup, quality_classifier, sharding, toxicity, url_filter, warc
from crategraph.llm import text as T
from crategraph.llm.queries import QUERIES, shard_sql
from crategraph.shared import table
from tests.compare import assert_same

from .conftest import prose

BLANKS = r"[^\x20\x09-\x0D]+"


def shingles(text):
    w = re.findall(BLANKS, text or "")
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    bags = {i: shingles(t) for i, t in rows}
    having = defaultdict(list)
    for i, b in bags.items():
        for s in b:
            having[s].append(i)
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in {(x, y) for v in having.values() for x in v for y in v if x < y}:
        if similarity(bags[a], bags[b]) >= 0.8 - 1e-9:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in bags}


@pytest.mark.parametrize("seed", range(3))
def test_words_and_shingles(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab é\t\n.#日") for _ in range(rng.randrange(60))) for _ in range(50)] + ["", None]
    seen = {}
    for size in (7, 1 << 20):
        for chunk in T.chunks(pa.array(texts), size):
            w = T.words(chunk)
            for k in range(chunk.size):
                got = [bytes(chunk.data[s:e]).decode() for s, e, d in zip(w.start, w.end, w.doc) if d == k]
                assert got == re.findall(BLANKS, texts[chunk.first + k] or "")
            for s, e, h in zip(w.start, w.end, w.hash.tolist()):
                assert seen.setdefault(bytes(chunk.data[s:e]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_near_duplicates_match_all_pairs(spark, medium):
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op4_bag_min_hash_classes"](spark, medium).collect()}
    assert got == brute_classes([(r[0], r[1]) for r in table(spark, medium, "documents").select("doc_id", "text").collect()])


def test_near_duplicates_in_a_crowded_family(spark):
    """Many variants of one text, of which only some are within reach of one another."""
    rng = random.Random(3)
    base = prose(11, 100).split()
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10_000)}"
        rows.append((k, " ".join([*w, f"end{k}"])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_classes(rows)
    got = near_dedup.classes(frame).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == expected
    sizes = Counter(expected.values())
    assert all(r["class_rows"] == sizes[r["class_id"]] and (r["n_links"] > 0 or sizes[r["class_id"]] == 1) for r in got if len(set(rows)) == len(rows))
    bags = {i: shingles(t) for i, t in rows}
    found = near_dedup.links(frame).collect()
    assert found and all(math.isclose(r["similarity"], similarity(bags[r["left_id"]], bags[r["right_id"]])) and r["similarity"] >= 0.8 for r in found)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 63, 200).astype(T.U64)
    a, b = rng.integers(1, 9, 200), rng.integers(0, 9, 200)
    docs = np.concatenate([np.zeros(200, int), np.ones(int((b > 0).sum()), int)])
    signature = near_dedup.bag_min_hash(docs, np.concatenate([shared, shared[b > 0]]), np.concatenate([a, b[b > 0]]), 2, 4096)
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signature[0] == signature[1]).mean() - expected) < 4 * math.sqrt(expected * (1 - expected) / 4096)


def test_decontamination_tolerates_substitutions(spark):
    items = [(k, prose(100 + k, 30 + k)) for k in range(8)]
    docs = []
    for k, (_, t) in enumerate(items):
        w = t.split()
        for j in range(2, len(w), 6 if k % 2 else 5):
            w[j] = "changed"
        docs.append((k, f"{prose(300 + k, 50)} {' '.join(w).upper()}, {prose(400 + k, 50)}"))
    docs += [(100 + k, f"{prose(500 + k)} {' '.join(items[k][1].split()[:8])} {prose(600 + k)}") for k in range(8)]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=60).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(k, k) for k in range(8)]
    assert all(r["doc_start"] == 50 and r["item_start"] == 0 for r in found)


def test_decontamination_finds_the_exact_passages(spark, medium):
    items = [(r[0], re.findall(r"\w+", r[1].lower())) for r in table(spark, medium, "benchmark").collect()]
    grams = defaultdict(set)
    for i, w in items:
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(i)
    expected = {(r[0], i) for r in table(spark, medium, "documents").select("doc_id", "text").collect() for w in [re.findall(r"\w+", r[1].lower())] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_spaced_seed_decontamination"](spark, medium).collect()}
    assert expected and expected <= got and len(got) <= len(expected) + 3


@pytest.mark.parametrize("limit", [20_000, 300_000])
def test_shards_match_sql(spark, medium, limit):
    docs = table(spark, medium, "documents").select("doc_id", "text")
    assert_same(sharding.shard(docs, limit=limit).drop("text"), shard_sql(limit), medium)


def test_mixture_meets_its_budget(spark, medium):
    docs = table(spark, medium, "documents").where("source IN ('src1', 'src2', 'src3') OR doc_id % 3 = 0")
    p = mixing.plan(docs, repetition_limit=1.5)
    sources = {r["__mix_key"][1:]: r for r in p.sources.collect()}
    most = max(r["tokens"] for r in sources.values())
    assert abs(max((most / r["tokens"]) ** (1 - p.exponent) for r in sources.values()) - 1.5) < 1e-6
    assert abs(sum(r["weight"] for r in sources.values()) - 1) < 1e-9
    rows = mixing.realise(docs, p, block_tokens=20_000).collect()
    read, blocks = Counter(), defaultdict(Counter)
    for r in rows:
        read[r["source"]] += r["n_tokens"]
        blocks[r["block"]][r["source"]] += r["n_tokens"]
    longest = max(r["n_tokens"] for r in rows)
    for s, r in sources.items():
        assert r["weight"] * p.budget - 1e-6 <= read[s] <= r["weight"] * p.budget + longest
        assert all(abs(b[s] - r["weight"] * 20_000) <= longest for k, b in blocks.items() if k < max(blocks))
    copies = Counter((r["doc_id"], r["epoch"]) for r in rows)
    assert set(copies.values()) == {1} and len({r["doc_id"] for r in rows}) == docs.count()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in mixing.apply(docs, p).select("doc_id").collect())


def test_readings_by_plain_prefix_sums(spark, small):
    """Every reading of every document, from a sort of each source's documents and running sums in plain Python."""
    docs = table(spark, small, "documents").where("source IN ('src1', 'src2', 'src3', 'src4') OR doc_id % 3 = 0")
    p = mixing.plan(docs, repetition_limit=1.3)
    size = 5_000
    keyed = mixing._keyed(docs, "doc_id", "text", "source")
    last = max(math.ceil(r["epochs"]) for r in p.sources.collect())
    places = [mixing._place(p.seed, mixing.F.lit(e)).alias(f"p{e}") for e in range(last)]
    rows = keyed.select("doc_id", "text", mixing.KEY, mixing.MARK, *places).collect()
    expected = Counter()
    for s in p.sources.collect():
        mine = [(r, len(re.findall(BLANKS, r["text"] or ""))) for r in rows if r[mixing.KEY] == s[mixing.KEY]]
        assert sum(n for _, n in mine) == s["tokens"] and len(mine) == s["docs"]
        for e in range(math.ceil(s["epochs"])):
            start = e * s["tokens"]
            for r, n in sorted(mine, key=lambda x: (x[0][f"p{e}"], x[0][mixing.MARK], x[0]["doc_id"])):
                if e == 0 or start < s["epochs"] * s["tokens"]:
                    expected[r["doc_id"], e, math.floor(start / (s["weight"] * size)) if s["weight"] else 0, n] += 1
                start += n
    got = Counter((r["doc_id"], r["epoch"], r["block"], r["n_tokens"]) for r in mixing.realise(docs, p, block_tokens=size).collect())
    assert got == expected and last > 1


def test_exponent_meets_an_entropy(spark):
    docs = spark.createDataFrame([(k, "a " * (10 * 4 ** (k % 3)), f"s{k % 3}") for k in range(9)], "doc_id long, text string, source string")
    p = mixing.plan(docs, target_entropy=1.0)
    w = [r["weight"] for r in p.sources.collect()]
    assert abs(-sum(x * math.log(x) for x in w) - 1.0) < 1e-6


def test_cascade_is_exact(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = keys.where("hash(key) % 7 = 0")
    from pyspark.sql import functions as F

    for bits in (1 << 23, 512):
        cascade = url_filter.Cascade(listed, keys, 3000, bits)
        assert len(cascade.levels) >= 2 and (cascade.levels[0].filters > 1) == (bits == 512)
        got = {r[0] for r in keys.where(cascade.member(F.col("key"))).collect()}
        assert got == {r[0] for r in listed.collect()}


def test_warc_holds_every_payload(spark, medium):
    pages = table(spark, medium, "pages")
    back = {r["page_id"]: r for r in warc.read(warc.write(pages, file_bytes=50_000, shard_bytes=200_000)).collect()}
    for r in pages.collect():
        b = back[r["page_id"]]
        whole = b if b["record_type"] == "response" else back[b["refers_to"]]
        assert whole["payload"].decode() == r["html"] and b["url"] == r["url"]


def auc(pairs):
    ranked = [y for _, y in sorted(pairs)]
    ones = sum(ranked)
    return (sum(k for k, y in enumerate(ranked) if y) - ones * (ones - 1) / 2) / (ones * (len(ranked) - ones))


@pytest.mark.parametrize(("name", "label", "least"), [("op7_random_indexing_quality", "quality", 0.95), ("op10_nearest_example_toxicity", "toxic", 0.75)])
def test_held_out_labels(spark, medium, name, label, least):
    rows = QUERIES[name](spark, medium).join(table(spark, medium, "labels"), "doc_id").where("held_out").select("doc_id", "score", "predicted", label).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert auc([(r["score"], r[label]) for r in rows]) >= least
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= 0.9


@pytest.mark.parametrize(("often", "common", "block", "in_a_row"), [(1 / 8, 256, 64, 1 / 8), (0.2, 4, 8, 1.0), (0.2, 4, 8, 0.0), (1.0, 0, 1, 0.5)])
def test_neighbours_are_exact(monkeypatch, often, common, block, in_a_row):
    for name, value in (("OFTEN", often), ("COMMON", common), ("BLOCK", block), ("DENSE", in_a_row)):
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(1)
    dense = rng.random((300, 40)) * (rng.random((300, 40)) < 0.15)
    dense[np.arange(300), rng.integers(0, 40, 300)] += 0.1
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows, terms = np.nonzero(dense)
    index = toxicity.Index.build(rows, terms, dense[rows, terms], np.zeros(300, int), 40)
    for q in dense[:60]:
        t = np.flatnonzero(q)
        s, e = index.nearest(t, q[t], 10)
        assert np.allclose(s, np.sort(dense @ q)[::-1][:10])
        assert np.allclose(dense[e] @ q, s)
    for x in range(20):
        t = np.flatnonzero(dense[x])
        s, e = index.nearest(t, dense[x][t], 10, skip=x)
        assert x not in e and np.allclose(s, np.sort(np.delete(dense @ dense[x], x))[::-1][:10])


def test_language_model_counts_and_probabilities(spark, medium):
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    texts = {r[0]: [*re.findall(BLANKS, (r[1] or "").translate(lower)), None] for r in table(spark, medium, "documents").select("doc_id", "text").collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    total, words = sum(counts.values()), len(counts)
    model = language_model.fit(table(spark, medium, "documents"), head=500)
    for r in language_model.score(table(spark, medium, "documents"), model).collect():
        t = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in counts for w in t), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + words + 1)) for w in t), rel_tol=1e-9)
    assert np.allclose((10.0**model.transition).sum(1), 1)  # each class's successors


def test_language_model_scores_by_hand(spark, small):
    """Class bigrams counted and scores summed in plain Python, from the classes alone."""
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    docs = table(spark, small, "documents")
    texts = {r[0]: re.findall(BLANKS, (r[1] or "").translate(lower)) for r in docs.select("doc_id", "text").collect()}
    model = language_model.fit(docs, head=500, types=200, classes=12)
    (chunk,) = T.chunks(pa.array([" ".join(sorted({w for t in texts.values() for w in t}))]), 1 << 30)
    tokens = language_model._tokens(chunk)
    names = bytes(chunk.data).decode().split(" ")
    at, in_head, context = model.look_up(tokens)
    rare = {r["h"]: r["class"] for r in model.counts.collect()}
    hashes = tokens.hash.view(np.int64).tolist()
    own = {w: int(model.head_own[at[k]]) if in_head[k] else rare.get(hashes[k], int(context[k])) for k, w in enumerate(names)}
    context = dict(zip(names, context.tolist()))
    counts, pairs = Counter(), np.zeros((14, 14))
    learnt = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    for t in learnt:
        counts.update(t)
        for before, now in zip([12, *(context[w] for w in t)], [*(own[w] for w in t), 13]):
            pairs[before, now] += 1
    share = np.insert(np.delete(pairs.sum(0) + 1, 12) / (pairs.sum() + 13), 12, 0)
    chance = (pairs + 20 * share) / (pairs.sum(1, keepdims=True) + 20)
    kinds, sizes = Counter(own[w] for w in counts), pairs.sum(0)
    assert sum(kinds[c] > 5 for c in range(12)) >= 6  # words are spread over the classes
    for r in language_model.score(docs, model).collect():
        t, total = texts[r["doc_id"]], 0.0
        for before, w in zip([12, *(context[w] for w in t)], [*t, None]):
            total += math.log10(chance[before, 13] if w is None else chance[before, own[w]] * (counts[w] + 1) / (sizes[own[w]] + kinds[own[w]] + 1))
        assert math.isclose(r["score"], total, rel_tol=1e-9)


def test_exchange_gains_are_those_of_the_whole_likelihood():
    rng = np.random.default_rng(4)
    n = rng.integers(0, 30, (9, 4)) * (rng.random((9, 4)) < 0.6)  # word by context class
    n[n.sum(1) == 0, 0] = 3
    group = rng.integers(0, 3, 9)

    def likelihood(group, without=()):
        table = np.zeros((5, 5))
        for w in set(range(9)) - set(without):
            table[:4, group[w]] += n[w]
        return table, sum((x * np.log(x)).sum() for x in [table[table > 0]]) - sum(x * np.log(x) for x in table.sum(0) if x)

    word, context = np.nonzero(n)
    got = language_model.gains(word, context, n[word, context], group, likelihood(group)[0])
    for w in range(9):
        for c in range(3):
            moved = group.copy()
            moved[w] = c
            assert math.isclose(got[w, c], likelihood(moved)[1] - likelihood(group, [w])[1], abs_tol=1e-9)


def test_language_model_beats_unigrams_on_held_out_text(spark, medium):
    from pyspark.sql import functions as F

    base, own = QUERIES["op9_brown_class_scores"](spark, medium).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert own > base


def test_word_vectors_by_a_double_loop(spark, small):
    """Context vectors of words, and a text's pooled vector, from plain loops over the words."""
    texts = [r[0] for r in table(spark, small, "documents").select("text").limit(60).collect()]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words, vectors, sums = [], {}, defaultdict(lambda: np.zeros(64, int))
    for t in texts:
        (chunk,) = T.chunks(pa.array([t or ""]))
        hashes = T.words(chunk, T.RUNS, lower=True).hash
        words.append(hashes.tolist())
        vectors.update(zip(words[-1], quality_classifier.index_vectors(hashes).astype(int)))
    for w in words:
        for k, x in enumerate(w):
            for j in range(max(0, k - 2), min(len(w), k + 3)):
                if j != k:
                    sums[x] += vectors[w[j]]
    counts = Counter(x for w in words for x in w)
    head, n, _ = language_model.frequent(language_model.word_counts(frame, T.RUNS), 300)
    assert 0 < len(head) <= 300 and dict(zip(head.tolist(), n.tolist())) == {x: counts[x] for x in head.tolist()}
    assert min(n) >= max(c for x, c in counts.items() if x not in set(head.tolist()))
    context = quality_classifier.context_vectors(frame, head)
    assert all((context[k] == sums[x]).all() for k, x in enumerate(head.tolist()))
    model = quality_classifier.Model.of(head, context)
    table_ = dict(zip(head.tolist(), model.table.astype(float)))
    (chunk,) = T.chunks(pa.array([t or "" for t in texts]), 1 << 30)
    for got, w in zip(model.pooled(chunk), words):
        local = defaultdict(lambda: np.zeros(64))
        for k, x in enumerate(w):
            for j in range(max(0, k - 2), min(len(w), k + 3)):
                local[x] += vectors[w[j]] * (j != k)
        of = {x: table_[x] if x in table_ else v / np.linalg.norm(v) - model.centre if v.any() else v for x, v in local.items()}
        expected = [*(sum((of[x] for x in w), np.zeros(64)) / max(1, len(w))), math.log1p(len(w)), math.log1p(len(set(w)))]
        assert np.allclose(got, expected, atol=1e-4)


def test_exchange_separates_two_vocabularies():
    rng = np.random.default_rng(2)
    bigrams = np.zeros((42, 42))
    for a in range(40):
        for b in range(a // 20 * 20, a // 20 * 20 + 20):
            bigrams[a, b] = rng.integers(1, 9)
    group = language_model.exchange(bigrams, 2)
    assert len(set(group[:20])) == len(set(group[20:40])) == 1 and group[0] != group[20]


def test_pipeline(spark, medium):
    docs = table(spark, medium, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], medium).cache())
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    toxic = QUERIES["op10_nearest_example_toxicity"](spark, medium)
    assert ids[1] == {r[0] for r in toxic.where("predicted = 0").select("doc_id").collect()}
    classes = brute_classes([(r[0], r[1]) for r in kept[1].select("doc_id", "text").collect()])
    assert ids[2] == set(classes.values())
    leaks = {r["doc_id"] for r in decontaminate.overlaps(kept[2], table(spark, medium, "benchmark")).collect()}
    assert leaks and ids[3] == ids[2] - leaks
    assert ids[4] == ids[3] and kept[4].count() > len(ids[4])
    last = corpus_pipeline.run(spark, medium)
    assert last.count() == kept[4].count() and last.agg({"shard_bytes": "max"}).first()[0] <= corpus_pipeline.SHARD_BYTES
