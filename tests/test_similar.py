"""Similarity and containment joins against all pairs."""

import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from crategraph.operators import match, similar


def titles(n, seed=0, words=14):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeilnorstuéx") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    out = [" ".join(rng.choice(base) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return [x if rng.random() < 0.6 or len(x) < 3 else x[: (k := rng.randrange(len(x)))] + rng.choice("abé ") + x[k + 1 :] for x in out]


def all_pairs(left, right, floor, keep, above=False):
    out = set()
    for by, a in {(b, x) for b, x in left if b is not None and x is not None}:
        found = sorted((-SequenceMatcher(None, a, x).ratio(), i) for b, x, i in right if b == by and x is not None and (x > a or not above))
        out |= {(by, a, i, round(-s, 12)) for s, i in found[:keep] if -s >= floor}
    return out


@pytest.mark.parametrize("side", [7, 1_000])
@pytest.mark.parametrize("floor", [0.47, 0.87])
def test_nearest_loses_no_pair(spark, side, floor):
    left = [(k % 3, x) for k, x in enumerate(titles(240))] + [(None, "a"), (1, None), (9, "alone"), (1, "")]
    right = [(k % 3, x, k) for k, x in enumerate(titles(240, 1))] + [(k % 3, x, 1_000 + k) for k, x in enumerate(titles(30))] + [(1, None, 5_000), (1, "", 5_001), (8, "alone", 5_002)]
    a = spark.createDataFrame(left, "artist int, text string")
    b = spark.createDataFrame(right, "artist int, text string, right_id long")
    got = {(r["artist"], r["text"], r["right_id"], round(r["score"], 12)) for r in similar.nearest(a, b, ["artist"], floor=floor, keep=2, side=side).collect()}
    assert got == all_pairs(left, right, floor, 2)


def test_a_table_with_itself(spark):
    rows = [(1, x) for x in set(titles(150, 4))]
    df = spark.createDataFrame(rows, "b int, text string")
    got = {(r["b"], r["text"], r["right_id"], round(r["score"], 12)) for r in similar.nearest(df, df.withColumn("right_id", F.col("text")), ["b"], floor=1e-9, keep=3, above=True, side=40).collect()}
    assert got == all_pairs(rows, [(b, x, x) for b, x in rows], 1e-9, 3, above=True)


def test_squares_bound_what_a_task_holds(spark):
    """An artist of 2,000 titles: no square has more than about ``side`` texts on a side, and every pair of sides meets once."""
    n, side = 2_000, 100
    df = spark.range(n).select(F.lit(1).alias("artist"), F.concat(F.lit("title "), F.hex("id")).alias("text"), F.col("id").alias("right_id"))
    cells = Counter()

    def count(l, r):  # noqa: E741
        import pyarrow as pa

        return pa.table({"l": pa.array([l.num_rows]), "r": pa.array([r.num_rows])})

    rows, cols = similar.squares(df.select("artist", "text"), df, ["artist"], keep=2, side=side)
    for r in rows.groupBy("__cell").cogroup(cols.groupBy("__in")).applyInArrow(count, "l long, r long").collect():
        cells[(r["l"] <= 2 * side, r["r"] <= 2 * side)] += 1
        cells["pairs"] += r["l"] * r["r"]
    assert cells[(True, True)] == (n // side) ** 2 and cells["pairs"] == n * n


def test_containing_against_all_pairs(spark):
    short = [(k % 2, x[: random.Random(k).randint(0, 9)], k) for k, x in enumerate(titles(200, 2))] + [(0, None, 900), (0, "", 901)]
    long = [(k % 2, x, k) for k, x in enumerate(titles(200, 3))] + [(1, None, 900), (0, "", 901)]
    a, b = spark.createDataFrame(short, "artist int, piece string, i long"), spark.createDataFrame(long, "artist int, text string, j long")
    got = sorted((r["i"], r["j"]) for r in similar.containing(a, b, ["artist"], "piece", "text").collect())
    assert got == sorted((i, j) for p, x, i in short for q, y, j in long if p == q and x and y is not None and x in y)
    assert {(r["piece"], r["text"]) for r in similar.unblocked(a, b, "piece", "text").collect()} == {(x, y) for _, x, _ in short for _, y, _ in long if x and y is not None and x in y}


def test_what_meets_is_little_more_than_what_fits(spark):
    """One artist with 3,000 titles on either side: the equi-join on pieces gives a small multiple of the hits, not 9,000,000 rows."""
    names = [f"{x} {k * 7919 % 10007:05d}" for k, x in enumerate(titles(3_000, 6))]
    certs = spark.createDataFrame([("a", f"the {x} live", k) for k, x in enumerate(names)], "artist string, text string, j long")
    tracks = spark.createDataFrame([("a", x, k) for k, x in enumerate(names)], "artist string, piece string, i long")
    held = certs.select("artist", "text", F.explode(similar._pieces("text", F.lit(similar.PIECE))).alias("p"))
    rarest = tracks.select("piece", F.explode(similar._pieces("piece", F.lit(similar.PIECE))).alias("p")).join(held.groupBy("p").count(), "p").groupBy("piece").agg(F.min("count").alias("n"))
    met = rarest.agg(F.sum("n")).first()[0]
    hits = similar.containing(tracks, certs, ["artist"], "piece", "text").count()
    assert hits >= 3_000 and met <= 8 * hits


def test_ratio_in_sql():
    import duckdb

    some = titles(60, 8) + ["", "aaaa", "aa", "abcabc", "cabcab"]
    con = duckdb.connect()
    con.execute("CREATE TABLE x (a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", [(a, b) for a in some for b in some[::5]])
    for a, b, r in con.execute(f"WITH RECURSIVE {similar.ratio_sql('x')} SELECT * FROM alike").fetchall():
        assert abs(r - SequenceMatcher(None, a, b).ratio()) < 1e-12, (a, b)


def test_memory_decides_per_title(spark):
    """A confirmed title goes to its track, if that is there; a title decided on, either way, is suggested no more."""
    tracks = spark.createDataFrame([(1, 7, None, "midnight train home", "x"), (2, 7, None, "twin", "p"), (3, 7, None, "twin", "q")], "track_id long, artist_id long, external_id string, title_key string, primary_key string")
    entries = spark.createDataFrame([(k, 7, None, x, None) for k, x in enumerate(["midnight train hxxe yy", "midnight tra", "nothing like it", "twin", "gone"])], "entry_id long, artist_id long, external_id string, title_key string, credited array<string>")
    memory = spark.createDataFrame([(7, "midnight tra", None, False), (7, "nothing like it", 1, True), (7, "twin", 3, True), (7, "gone", 99, True)], "artist_id long, entry_title_key string, track_id long, accepted boolean")
    got = {(r["entry_id"], r["track_id"], r["stage"]) for r in match.staged_match(entries, tracks, memory).collect()}
    assert got == {(0, 1, "suggested"), (2, 1, "remembered"), (3, 3, "remembered")}
    assert (1, 1, "suggested") in {(r["entry_id"], r["track_id"], r["stage"]) for r in match.staged_match(entries, tracks).collect()}


@pytest.mark.parametrize("pairs", [100, 1 << 20])
@pytest.mark.parametrize(("keep", "floor", "above"), [(2, 0.47, False), (3, 1e-9, True), (1, 0.9, True)])
def test_partners_by_beginnings_lose_none(monkeypatch, keep, floor, above, pairs):
    """Short and long, empty and equal texts, several ids of a text, against every ratio."""
    monkeypatch.setattr(similar, "PAIRS", pairs)
    left = [*dict.fromkeys(titles(120, 5)), "", "a", "ß" * 70, "x" * 63]
    right = titles(300, 6) + ["", "ß" * 80, "x" * 62, "x" * 64] + titles(40, 5)
    ids = random.Random(1).sample(range(1_000), len(right))
    for x, got in zip(left, similar.Partners(right, ids).best(left, [floor] * len(left), keep, above)):
        every = sorted((-SequenceMatcher(None, x, y).ratio(), i) for y, i in zip(right, ids) if y > x or not above)
        assert got == [(-s, i) for s, i in every[:keep] if -s >= floor]


def coded(n):
    names = [f"{a} {b}" for a in ("hot", "cold", "small", "large", "red", "blue", "old", "new") for b in ("ring", "bolt", "rod", "gear", "plate", "gizmo", "widget", "anvil")]
    return list(dict.fromkeys(f"{random.Random(k).choice(names)} {str(k * 7919 % 9973).translate(str.maketrans('0123456789', 'bcdfghjklm'))}" for k in range(n)))


def test_ratios_are_counted_for_few_of_an_artists_pairs(monkeypatch):
    """4,000 titles of one artist: of 800,000 pairs with 200 texts a few hundred get a ratio, and few beginnings are met."""
    tracks, calls, met = coded(4_000), [], []
    ratio, walk = similar.Partners._ratio, np.bitwise_count
    monkeypatch.setattr(similar.Partners, "_ratio", lambda self, *x: calls.append(1) or ratio(self, *x))
    monkeypatch.setattr(similar.np, "bitwise_count", lambda x: met.append(len(x)) or walk(x))
    left = [x[:5] + x[6:] for x in tracks[:200]]
    found = similar.Partners(tracks, list(range(len(tracks)))).best(left, [0.47] * 200, 2, False)
    assert all(len(x) == 2 for x in found) and len(calls) < 3_000 and sum(met) < 200 * 4_000 / 4


def test_closest_pairs_of_a_block(spark):
    rows = [(k % 3, x) for k, x in enumerate(titles(150, 8))] + [(None, "a"), (1, None), (9, "alone"), (8, "ab"), (8, "cd")]
    df = spark.createDataFrame(rows, "b int, text string")
    expected = set()
    for b in range(10):
        own = sorted({x for k, x in rows if k == b and x is not None})
        every = sorted((-SequenceMatcher(None, x, y).ratio(), x, y) for x in own for y in own if x < y)
        expected |= {(b, x, y, round(-s, 12), n) for n, (s, x, y) in enumerate(every[:3], 1) if s < 0}
    assert {(r["b"], r["text"], r["right_id"], round(r["score"], 12), r["n"]) for r in similar.closest(df, ["b"], keep=3).collect()} == expected
