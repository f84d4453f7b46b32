"""Keys that many rows share cost no more than their rows, and what makes many pairs makes them only at the end."""

import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from crategraph.operators import match, resolve, rollup
from crategraph.plans import ORACLE_SQL, QUERIES
from tests.compare import assert_same

MANY = 60_000


def within(seconds: float, work):
    begin = time.time()
    out = work()
    assert time.time() - begin < seconds
    return out


def test_one_id_of_many_tracks(spark):
    t = spark.range(MANY).select(F.col("id").alias("track_id"), F.lit("x").alias("external_id"), F.when(F.col("id") == 0, "a").otherwise("b").alias("title_key"))
    free = within(40, lambda: match.id_is_free(t, t).where("free").collect())
    assert [r["track_id"] for r in free] == []
    few = t.where("track_id < 3").unionAll(spark.createDataFrame([(9, "y", "c"), (7, None, "d")], "track_id long, external_id string, title_key string"))
    assert {r["track_id"]: r["free"] for r in match.id_is_free(few, few).collect()} == {0: False, 1: False, 2: False, 9: True, 7: True}


def test_counters_are_rounded_half_to_even(spark, tmp_path):
    spark.createDataFrame([(3,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 5, "view", 2.5), (2, 6, "view", 3.5), (4, 6, "view", 4.5), (5, 7, "view", 0.49)], "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert_same(QUERIES["counter_ids"](spark, str(tmp_path)), ORACLE_SQL["counter_ids"], str(tmp_path))


def test_stamps_beyond_99_minutes(spark, tmp_path):
    rows = [(59, "old plate"), (5_999, "red rod"), (6_000, "hot ring"), (7_261, "x"), (90_061, "y z")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    assert_same(QUERIES["lyric_texts"](spark, str(tmp_path)), ORACLE_SQL["lyric_texts"], str(tmp_path))


@pytest.mark.parametrize("name", ["certification_match", "certification_match_any", "album_certification_match"])
def test_pairs_of_one_title_are_made_last(spark, name):
    side = 15_000
    tracks = spark.range(side).select(F.col("id").alias("track_id"), F.lit("ANN").alias("artist"), F.lit("SOME TITLE").alias("title"), F.array(F.lit("ANN"), F.lit("BO")).alias("artists"))
    certs = spark.range(side).select(F.col("id").alias("cert_id"), F.lit("ANN").alias("artist_clean"), F.lit("SOME TITLE II").alias("title_clean"), F.lit("album").alias("cat"))
    if name == "album_certification_match":
        tracks = tracks.withColumnRenamed("track_id", "album_id")
    assert within(40, lambda: getattr(match, name)(tracks, certs).count()) == side * side


def test_one_title_of_many_entries(spark):
    k = F.col("id")
    none = F.lit(None).cast("string").alias("external_id")
    tracks = spark.range(MANY).select(k.alias("track_id"), F.lit("a").alias("artist_id"), none, F.lit("t").alias("title_key"), F.when(k == 5, "ann").otherwise("bo").alias("primary_key"))
    entries = spark.range(MANY).select(k.alias("entry_id"), F.lit("a").alias("artist_id"), none, F.lit("t").alias("title_key"), F.when(k % 2 == 0, F.array(F.lit("ann x"))).when(k % 3 == 0, F.array(F.lit("bo"))).alias("credited"))
    found = within(60, lambda: match.staged_match(entries, tracks).groupBy("track_id", "stage").count().collect())
    assert [tuple(r) for r in found] == [(5, "credited", MANY // 2)]


def test_one_title_of_many_imports(spark):
    none = F.lit(None).cast("bigint").alias("genius_id")
    incoming = spark.range(MANY).select(F.col("id").alias("incoming_id"), none, F.lit("T").alias("title"), F.lit("").alias("album"))
    known = spark.range(MANY).select(F.col("id").alias("track_id"), none, F.lit("t").alias("title"), F.lit("x").alias("album"), F.lit(1).alias("bpm"), F.lit(True).alias("has_lyrics"), (F.col("id") % 50).alias("credits"))
    found = within(40, lambda: match.import_match(incoming, known).groupBy("track_id", "level").count().collect())
    assert [tuple(r) for r in found] == [(49, "title", MANY)]


def test_timed_lyrics_are_read_once_a_row(spark, small):
    plan = QUERIES["timed_lyrics"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract") <= 10  # the parts of a line for each of two texts


def test_members_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(rollup, "CREDITS", 50)
    credits = spark.range(1_000).select((F.col("id") % 300).alias("track_id"), F.concat(F.lit("m"), F.col("id") % 7).alias("name"), F.col("id").alias("pos"))
    m = rollup.members(credits, F.col("name"))
    assert m.rdd.getNumPartitions() == 20
    pairs = {}
    for t in range(300):
        names = sorted({f"m{k % 7}" for k in range(t, 1_000, 300)})
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["weight"] for r in rollup.collaboration_edges(m).collect()} == pairs


def test_documents_travel_in_small_batches(spark, small):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, 10_000)
    QUERIES["document_keys"](spark, small)
    assert int(spark.conf.get(conf)) <= 1_000


def test_similar_lines_are_compared_only_where_they_can_be(spark):
    """Against every ratio in plain Python: the lines behind the last equal one, with blurred, short and far ones among them."""
    wanted = [["abcdefgh", "ab", "longer line of it"], ["abcdefgh", "ünïcödé line", ""]]
    keys = ["abcdefgh", "abcdefg", "hgfedcba", "abcdxefgh", "longer line of", "longer lime of it", "unicode line", "ünïcödé lin", "ab", "", "abcdefgh ii", "it longer line of"]
    equal = [[[p for p, x in enumerate(keys) if x == w] for w in ws] for ws in wanted]
    df = spark.createDataFrame([(wanted, equal, keys)], "w array<array<string>>, e array<array<array<int>>>, k array<string>")
    (row,) = df.select(resolve._near_lines("w", "e", "k").alias("near")).collect()
    near = [[[x["p"] for x in ps] for ps in lines] for lines in row["near"]]
    alike = lambda w, p: SequenceMatcher(None, w, keys[p]).ratio() >= resolve.SUNG
    for ws, es, found in zip(wanted, equal, near):
        for w, e, ps in zip(ws, es, found):
            assert [p for p in ps if alike(w, p)] == [p for p in range(max(e, default=-1) + 1, len(keys)) if len(w) >= 3 and alike(w, p)]
            assert "hgfedcba" not in [keys[p] for p in ps]
    assert sum(len(ps) for lines in near for ps in lines) < 3 * 2 * len(keys) / 4
