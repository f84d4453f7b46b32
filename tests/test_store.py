"""Upserts, bucketed tables, verified versions and backfills on small cases."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from crategraph.operators import accumulate, resolve
from crategraph.sources import sinks

RULES = {"overwrite": ("feat",), "sticky": ("lyr",), "insert_only": ("page",), "empty": {"certs": "[]"}}


def one_by_one(base, feed):
    """The table after the feed's rows were upserted one after another."""
    out = {r["k"]: dict(r) for r in base}
    for n in sorted(feed, key=lambda r: r["seq"]):
        n = {c: n[c] for c in ("k", "title", "certs", "feat", "lyr", "page")}
        old = out.get(n["k"])
        if old is None:
            out[n["k"]] = {**n, "lyr": bool(n["lyr"]), "certs": None if n["certs"] == "[]" else n["certs"]}
            continue
        old["title"] = n["title"] if n["title"] is not None else old["title"]
        old["certs"] = n["certs"] if n["certs"] not in (None, "[]") else old["certs"]
        old["feat"], old["lyr"] = n["feat"], bool(old["lyr"]) or bool(n["lyr"])
    return sorted(map(str, ([r[c] if c != "lyr" else bool(r[c]) for c in ("k", "title", "certs", "feat", "lyr", "page")] for r in out.values())))


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(1)
    row = lambda k: {"k": k, "title": rng.choice([None, "a", "b"]), "certs": rng.choice([None, "[]", "x"]), "feat": rng.choice([None, True, False]), "lyr": rng.choice([None, True, False]), "page": rng.choice(["p", "q"])}
    base = [row(k) for k in [None, *range(40)]]
    feed = [{**row(rng.choice([None, *range(0, 60, 3)])), "seq": s} for s in range(120)]
    kind = "k long, title string, certs string, feat boolean, lyr boolean, page string"
    rows = lambda xs, cols: [tuple(x[c] for c in cols) for x in xs]
    cols = ["k", "title", "certs", "feat", "lyr", "page"]
    return base, feed, spark.createDataFrame(rows(base, cols), kind), spark.createDataFrame(rows(feed, [*cols, "seq"]), kind + ", seq long")


def shown(df):
    return sorted(map(str, ([r["k"], r["title"], r["certs"], r["feat"], bool(r["lyr"]), r["page"]] for r in df.collect())))


def test_repeated_and_null_keys(case):
    base, feed, b, f = case
    assert shown(accumulate.upsert(b, f.repartition(5), ["k"], order="seq", **RULES)) == one_by_one(base, feed)
    assert shown(accumulate.upsert(b, f.limit(0), ["k"], order="seq", **RULES)) == one_by_one(base, [])
    assert shown(accumulate.upsert(b.limit(0), f, ["k"], order="seq", **RULES)) == one_by_one([], feed)


def test_buckets_of_the_feed_alone_are_read_and_written(spark, case, tmp_path):
    base, feed, b, f = case
    path = str(tmp_path / "t")
    accumulate.create_bucketed(b, path, ["k"], 8)
    stamp = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/{accumulate.BUCKET}=*/*.parquet")}
    before = stamp()
    small = f.where("k = 3 OR k IS NULL")
    touched = accumulate.upsert_bucketed(spark, path, small, ["k"], 8, order="seq", **RULES)
    assert 1 <= len(touched) <= 2
    after = stamp()
    of = lambda p: int(p.split(f"{accumulate.BUCKET}=")[1].split("/")[0])
    assert {p for p in before if of(p) not in touched} == {p for p in after if of(p) not in touched and before.get(p) == after[p]}
    assert not {p for p in before if of(p) in touched} & set(after)
    few = [x for x in feed if x["k"] in (3, None)]
    assert shown(accumulate.read_bucketed(spark, path)) == one_by_one(base, few)
    accumulate.upsert_bucketed(spark, path, small, ["k"], 8, order="seq", **RULES)  # once more changes nothing
    assert shown(accumulate.read_bucketed(spark, path)) == one_by_one(base, few)
    plan = spark.read.parquet(path).where(F.col(accumulate.BUCKET).isin(touched))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" + accumulate.BUCKET in plan
    assert accumulate.upsert_bucketed(spark, path, f.limit(0), ["k"], 8, order="seq", **RULES) == []


def test_damaged_versions_are_refused_and_skipped(spark, tmp_path):
    root = str(tmp_path / "v")
    for v in range(1, 6):
        sinks.save_version(spark.range(v * 10).withColumn("m", F.create_map(F.lit("v"), F.lit(v))), root, v)
    count = lambda *v: sinks.load_version(spark, root, *v).count()
    assert count() == 50 and sinks.current_version(spark, root) == 5 and all(sinks.is_sound(spark, root, v) for v in range(1, 6))
    os.remove(max(glob.glob(f"{root}/version=000005/*.parquet"), key=os.path.getsize))
    with open(max(glob.glob(f"{root}/version=000004/*.parquet"), key=os.path.getsize), "r+b") as f:
        f.truncate(50)
    os.remove(f"{root}/version=000003/{sinks.MANIFEST}")  # never finished
    assert sinks.versions(spark, root) == [1, 2, 4, 5] and [sinks.is_sound(spark, root, v) for v in (1, 2, 3, 4, 5)] == [True, True, False, False, False]
    assert count() == 20
    for v in (3, 4, 5, 9):
        with pytest.raises(FileNotFoundError):
            count(v)
        with pytest.raises(FileNotFoundError):
            sinks.restore_version(spark, root, v)
    sinks.restore_version(spark, root, 1)
    assert count() == 10 and count(2) == 20
    assert sinks.prune_versions(spark, root, keep=2) == [2] and count() == 10  # the current one stays
    with pytest.raises(FileNotFoundError):
        sinks.load_version(spark, str(tmp_path / "none"))


def test_new_ids_do_not_follow_the_partitioning(spark):
    tracks = spark.range(30).select(F.col("id").alias("track_id"), F.lit(None).cast("long").alias("n"))
    known = spark.createDataFrame([(3, "n", "1", "s", None, 7)], "track_id long, field string, value string, source string, confidence double, obs_id long")
    counters = spark.range(30).select(F.col("id").alias("track_id"), (F.col("id") * 2).alias("n"))
    ids = [sorted((r["track_id"], r["obs_id"], r["value"]) for r in accumulate.write_through(tracks, known, counters.repartition(p), "n", "s")[1].collect()) for p in (1, 7)]
    assert ids[0] == ids[1] and ids[0][:4] == [(0, 8, "0"), (1, 9, "2"), (2, 10, "4"), (3, 7, "6")]


@pytest.mark.parametrize("a, b, valid, match", [("2001-02-03", None, True, None), ("2001-02-03", "", True, None), ("2001-02-03", "3/2/2001", True, True), ("2001-02-03", "2001/02/03", True, True), ("2001-02-03", "03-02-2001", True, True), ("2001-02-03", "2001-02-04", True, False), ("2001-02-03", "Feb 2001", False, False), ("x", "2001-02-03", False, False), ("2001-02-03", "2001-02-30", False, False)])
def test_dates_in_four_forms(spark, a, b, valid, match):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(resolve.dates_agree(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert (r["valid"], r["match"]) == (valid, match)
