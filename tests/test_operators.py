"""Operators on small tables with known outcomes."""

import random

import pytest
from pyspark.sql import functions as F

from crategraph.operators import accumulate, match, quality, resolve, rollup
from crategraph.sources import csv, pages, sinks
from crategraph.sources import json as json_source
from crategraph.streaming import ingest

OBS = "track_id long, obs_id long, field string, value string, source string, confidence double"


def obs(spark, rows):
    return spark.createDataFrame([(1, k, *r, None)[:6] if len(r) == 3 else (1, k, *r) for k, r in enumerate(rows)], OBS)


@pytest.mark.parametrize(
    ("votes", "expected"),
    [
        ([("deezer", "74"), ("reccobeats", "145")], (145, 74, "reccobeats+deezer", 2)),
        ([("getsongbpm", "88"), ("deezer", "88")], (88, 176, "getsongbpm+deezer", 2)),
        ([("deezer", "71")], (142, 71, "deezer", 1)),
        ([("deezer", "120")], (120, 60, "deezer", 1)),
        ([("deezer", "100"), ("songbpm", "101"), ("reccobeats", "150")], (101, None, "songbpm+deezer", 2)),
        ([("deezer", "100"), ("reccobeats", "150")], (150, 75, "reccobeats", 1)),
        ([("deezer", "900"), ("songbpm", "abc"), ("getsongbpm", "120")], (120, 60, "getsongbpm", 1)),
    ],
)
def test_tempo_vote(spark, votes, expected):
    row = resolve.tempo_vote(obs(spark, [("bpm", v, s) for s, v in votes])).first()
    assert (row["bpm"], row["bpm_alt"], row["source"], row["confidence"]) == expected


def test_tempo_vote_against_a_plain_loop(spark):
    rng = random.Random(4)
    rank = {"reccobeats": 3, "getsongbpm": 2, "songbpm": 1, "deezer": 0}
    rows = [(t, k, "bpm", str(rng.choice([60, 62, 64, 67, 70, 88, 90, 120, 124, 127, 140, 180, 210])), rng.choice(list(rank)), None) for t in range(300) for k in range(rng.randrange(1, 6))]
    near = lambda a, b: min(abs(a - b), abs(a - 2 * b), abs(2 * a - b)) <= 3
    got = {r["track_id"]: (r["bpm"], r["bpm_alt"], r["confidence"]) for r in resolve.tempo_vote(spark.createDataFrame(rows, OBS).repartition(3)).collect()}
    for t in range(300):
        groups = []
        for _, _, _, v, s, _ in (r for r in rows if r[0] == t):
            home = next((g for g in groups if any(near(int(v), w) for _, w in g)), None)
            if home is None:
                home = []
                groups.append(home)
            home.append((rank[s], int(v)))
        best = sorted(groups, key=lambda g: (-len(g), -max(r for r, _ in g)))[0]
        low, high = min(v for _, v in best), max(v for _, v in best)
        first = lambda xs: next(v for r, v in xs if r == max(q for q, _ in xs))
        if 2 * high >= 3 * low:
            expected = first([x for x in best if 2 * x[1] >= 3 * low]), low
        else:
            v = first(best)
            doubled = v < 90 and 2 * v <= 220
            expected = (2 * v, v) if doubled and len(best) == 1 else (v, 2 * v if doubled else v // 2 if v // 2 >= 55 else None)
        assert got[t] == (*expected, len(best))


def test_reconcile(spark):
    rows = [("bpm", "88", "legacy"), ("bpm_alt", "176", "legacy"), ("key", "5", "reccobeats"), ("key", "7", "songbpm"), ("mode", "1", "songbpm"), ("album", "A", "x", 0.2), ("album", "B", "y", 0.9), ("album", "C", "legacy", 1.0)]
    got = {r["field"]: (r["value"], r["source"], r["alt"]) for r in resolve.reconcile(obs(spark, rows)).collect()}
    assert got == {"bpm": ("88", "legacy", "176"), "key": ("7", "songbpm", None), "mode": ("1", "songbpm", None), "album": ("B", "y", None)}
    rows += [("bpm", "120", "manual"), ("bpm", "100", "deezer"), ("key", "2", "manual")]
    got = {r["field"]: (r["value"], r["source"]) for r in resolve.reconcile(obs(spark, rows)).collect()}
    assert got["bpm"] == ("120", "manual") and got["key"] == ("2", "manual") and got["mode"] == ("1", "songbpm")
    tracks = spark.createDataFrame([(1, None, 3)], "track_id long, bpm int, duration int")
    row = resolve.apply_to_tracks(tracks, resolve.reconcile(obs(spark, rows))).first()
    assert (row["bpm"], row["key"], row["mode"], row["musical_key"], row["duration"]) == (120, 2, 1, "Ré majeur", 3)


def lrc(times, shift=0):
    return "\n".join(f"[{(t + shift) // 60:02d}:{(t + shift) % 60:02d}.00] line {k}" for k, t in enumerate(times))


@pytest.mark.parametrize(
    ("one", "two", "duration", "expected"),
    [(lrc([5, 10, 20, 30]), lrc([5, 10, 20, 30], 1), None, ("LRCLIB", 2.0)), (lrc([5, 10, 20, 30], 60), lrc([5, 40, 90, 95]), 92.0, ("LRCLIB", 1.0)), (lrc([5, 10, 20, 150]), lrc([5, 40, 90, 95]), 100.0, ("YouTube Music", 1.0)), (lrc([5]), None, None, ("LRCLIB", 1.0)), (None, lrc([5]), None, ("YouTube Music", 1.0)), (None, "words", None, (None, None))],
)
def test_cross_check(spark, one, two, duration, expected):
    row = resolve.cross_check(spark.createDataFrame([(one, two, duration)], "lrclib string, ytmusic string, duration double")).first()
    assert (row["source"], row["confidence"]) == expected


def test_annotate_sections(spark):
    structured = "[Intro]\nhello there\n[Verse]\nall night long\n[Hook]\nhello there"
    timed = "[00:05.00] Hello there\n[00:12.00] all nite long\n[00:30.00] hello there\n[00:41.00] end"
    row = resolve.annotate_sections(spark.createDataFrame([(1, structured, timed), (2, structured, None)], "track_id long, lyrics string, lrc string")).orderBy("track_id").collect()
    assert row[0]["annotated"].splitlines()[::2] == ["[Intro  ⏱ 0:05 → 0:12]", "[Verse  ⏱ 0:12 → 0:30]", "[Hook  ⏱ 0:30 → 0:41]"]
    assert row[1]["annotated"] == structured


def test_votes_and_gates(spark):
    c = spark.createDataFrame([(1, "a", 0, 2, 5), (1, "b", 1, 3, 0), (2, "a", 0, 0, 0), (2, "b", 1, 0, 4), (3, "a", 0, 0, 0), (3, "b", 1, 0, 0)], "q long, candidate string, position int, overlap int, albums int")
    assert {r["q"]: r["choice"] for r in resolve.homonym_choice(c, "q").collect()} == {1: "b", 2: "b", 3: "a"}
    tracks = spark.createDataFrame([(k, 100, 5, 1, "La majeur") for k in range(4)], "track_id long, bpm int, key int, mode int, musical_key string")
    tries = spark.createDataFrame([(0, False), (0, False), (1, False), (1, None), (2, True)], "track_id long, ok boolean")
    assert {r["track_id"]: r["bpm"] for r in resolve.clear_after_failure(tracks, tries).collect()} == {0: None, 1: 100, 2: 100, 3: 100}
    dates = spark.createDataFrame([(1, 0, "2020-05-01", False), (1, 1, "x", False), (1, 2, "2019-05-01T00:00:00Z", False), (2, 0, "2020-05-01", False), (2, 1, "2021-01-01", True)], "track_id long, obs_id long, release_date string, forced boolean")
    assert {r["track_id"]: r["release_date"].year for r in resolve.earliest_release(dates).collect()} == {1: 2019, 2: 2021}


def test_belgian_and_american_lists(spark):
    be = spark.createDataFrame([(0, "A ", "T", "S", "Or", "2020"), (1, "a", "t", "S", "Or", "2020"), (2, "A", "T", "S", "", "2020"), (3, "A", "T", "S", "Platine", "2020"), (4, "B", "T", "S", None, "2020")], "pos long, artist string, title string, category string, certification_level string, certification_date string")
    assert sorted((r["pos"], r["certification_level"]) for r in accumulate.clean_belgian(be).collect()) == [(0, "Or"), (3, "Platine"), (4, "")]
    us = spark.createDataFrame([(0, "A", "T", "4x Multi-Platinum", "May 1, 2020", "SINGLE"), (1, "a", "T ", "4x Platinum", "2020-05-01", "Single"), (2, "A", " ", "Gold", "x", "Album"), (3, "A", "T", "Gold", "2020-05-01", "Single")], "pos long, Artist string, Title string, Certification_Type string, Certification_Date string, Format_Type string")
    assert sorted(r["pos"] for r in accumulate.clean_american(us).collect()) == [0, 3]
    nested = spark.createDataFrame([("a", "Gold", "2020", [("Gold", "2019"), ("", "2018"), ("Platinum", "")]), ("b", "Gold", "2020", [])], "t string, level string, date string, history array<struct<level:string,date:string>>")
    assert sorted(tuple(r) for r in accumulate.flatten_history(nested).collect()) == [("a", "Gold", "2019"), ("a", "Platinum", "2020"), ("b", "Gold", "2020")]
    fr = spark.createDataFrame([("A  b", "or", None), ("B", "bronze", "Albums")], "artist string, level string, category string")
    assert [tuple(r) for r in accumulate.canonical_french(fr).collect()] == [("A b", "Or", "Singles")]


def test_clean_with_report(spark):
    rows = [(0, "A  a", "L?or", "singles", "or", "d", False), (1, "a a", "l'or", "Singles", "Or", "d", False), (2, "", "x", "Singles", "Or", "d", False), (3, "odd  row", "?", "q", "q", "q", True)]
    df = spark.createDataFrame(rows, "pos long, artist string, title string, category string, level string, date string, odd boolean")
    clean, report = accumulate.clean_with_report(df)
    assert sorted((r["pos"], r["artist"], r["title"], r["level"]) for r in clean.collect()) == [(0, "A a", "L'or", "Or"), (3, "odd  row", "?", "q")]
    r = report.first()
    assert (r["rows"], r["blanks"], r["marks"], r["empty"], r["repeats"]) == (4, 1, 1, 1, 1)


def test_writes(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", "x")], "id long, name string, note string")
    more = accumulate.insert_or_ignore(base, spark.createDataFrame([("a",), ("c",), ("b",)], "name string"), "name", "id")
    assert sorted((r["id"], r["name"]) for r in more.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    renamed = accumulate.rename(spark.createDataFrame([(1, 9, "a"), (2, 9, "b"), (3, 8, "c")], "id long, artist long, title string"), spark.createDataFrame([(1, "b"), (3, "b")], "id long, title string"), "id", "title", "artist")
    assert sorted((r["id"], r["title"], r["renamed"]) for r in renamed.collect()) == [(1, "a", False), (2, "b", None), (3, "b", True)]
    root = f"{tmp_path}/t"
    for v in range(1, 5):
        sinks.save_version(base.withColumn("v", F.lit(v)), root, v)
    assert sinks.load_version(spark, root).first()["v"] == 4 and sinks.load_version(spark, root, 2).first()["v"] == 2
    assert sinks.prune_versions(spark, root, 2) == [1, 2] and sinks.versions(spark, root) == [3, 4]
    artists = spark.createDataFrame([(1, 10, None)], "artist_id long, spotify_listeners long, ytm_listeners long")
    history = spark.createDataFrame([], "artist_id long, spotify_listeners long, ytm_listeners long, total_estimated long, recorded_at string")
    a, h = accumulate.snapshot_listeners(artists, history, spark.createDataFrame([(1, None, 25, "now")], "artist_id long, spotify_listeners long, ytm_listeners long, recorded_at string"))
    assert tuple(a.first()) == (1, 10, 25) and h.first()["total_estimated"] == 100


def test_matching(spark):
    e = spark.createDataFrame([(1, 1, "X", "other", None), (2, 1, None, "song", None), (3, 1, None, "twin", ["b"]), (4, 1, None, "rhythm of rain", None), (5, 1, None, "matrix intro", None), (6, 1, None, "nothing alike", None)], "entry_id long, artist_id long, external_id string, title_key string, credited array<string>")
    t = spark.createDataFrame([(10, 1, "X", "zzz", "a"), (11, 1, None, "song", "a"), (12, 1, None, "twin", "a"), (13, 1, None, "twin", "b"), (14, 1, None, "rythm of rain", "a"), (15, 1, None, "matrix", "a")], "track_id long, artist_id long, external_id string, title_key string, primary_key string")
    got = {r["entry_id"]: (r["track_id"], r["stage"]) for r in match.staged_match(e, t).collect()}
    assert got == {1: (10, "id"), 2: (11, "title"), 3: (13, "credited"), 4: (14, "fuzzy"), 5: (15, "suggested")}
    memory = spark.createDataFrame([("matrix intro", 1, 15, True)], "entry_title_key string, artist_id long, track_id long, accepted boolean")
    assert {r["entry_id"]: r["stage"] for r in match.staged_match(e, t, memory).collect()}[5] == "remembered"
    refused = memory.withColumn("accepted", F.lit(False))
    assert 5 not in {r["entry_id"] for r in match.staged_match(e, t, refused).collect()}
    tracks = spark.createDataFrame([(1, "IAM", "DEMAIN"), (2, "IAM", "DEMAIN FEAT X"), (3, "IAM", "UNE CHANSON TRES LONGUE"), (4, "IAM", ""), (5, "AB", "Z")], "track_id long, artist string, title string")
    certs = spark.createDataFrame([(1, "IAM", "DEMAIN", "SNEP", "single"), (2, "IAM ET X", "DEMAIN C EST LOIN", "SNEP", "single"), (3, "IAM", "UNE CHANSON", "SNEP", "single"), (4, "IAM", "", "SNEP", "single"), (5, "WILLIAMS", "DEMAINX", "SNEP", "single"), (6, "CAB", "Z", "SNEP", "album")], "cert_id long, artist_clean string, title_clean string, body string, cat string")
    got = {(r["track_id"], r["cert_id"]) for r in match.certification_match(tracks, certs).collect()}
    assert got == {(1, 1), (1, 2), (1, 5), (2, 1), (3, 3), (4, 4), (5, 6)}
    audit = match.certification_audit(spark.createDataFrame([(7, "IAM")], "artist_id long, artist string"), certs, spark.createDataFrame([(7, "track", "DEMAIN"), (7, "track", "UNE CHANTON")], "artist_id long, kind string, title string"))
    got = {r["cert_id"]: (r["matched"], r["closest"]) for r in audit.collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, "UNE CHANTON")}


def test_scored_choices(spark):
    c = spark.createDataFrame([(1, 0, "Song", "Ann", 200, "Song (Live)", "Ann", 260), (1, 1, "Song", "Ann", 200, "Song", "Ann", 201), (1, 2, "Song", "Ann", 200, "Other", "Ann", 200)], "track_id long, position int, title string, artist string, duration int, hit_title string, hit_artist string, hit_duration int")
    row = match.lyrics_hit(c).first()
    assert row["position"] == 1 and row["score"] == pytest.approx(2.5)
    s = spark.createDataFrame([("Booska Pogo", "A", None, "FREESTYLE BOOSKA-POGO", "a", None), ("X", "A", "i", "X", "A", "j"), ("X", "B", None, "X", "A", None), ("Songs of a", "A", "", "Songs of b", "A", "k")], "result_title string, result_artist string, result_id string, title string, artist string, id string")
    assert [r["accepted"] for r in match.song_accepted(s).collect()] == [True, False, False, True]


def test_rollups(spark):
    t = spark.createDataFrame([(1, "Ann", 3, 50, True, None, 120, 0.0, "Ré mineur", 200), (2, "Bob", 0, 50, True, None, 120, 1.0, None, 200)], "track_id long, x string, key int, y int, has_lyrics boolean, disabled boolean, bpm int, mode double, musical_key string, duration int")
    t = t.withColumns({"release_date": F.lit("2020"), "music_credits": F.lit(2)})
    assert [r[0] for r in t.select(rollup.track_status(t)).collect()] == ["complete", "partial"]
    assert [r[0] for r in t.select(rollup.track_status(t, strict=True)).collect()] == ["complete", "complete"]
    tracks = spark.createDataFrame([(1, "Own", False), (2, "own ", False), (3, "Host", True), (4, None, True), (5, None, False), (6, "Comp", False)], "track_id long, album string, is_featuring boolean")
    for c, k in (("disabled", "boolean"), ("credits", "int"), ("has_lyrics", "boolean"), ("duration", "int"), ("release_date", "date"), ("streams", "bigint")):
        tracks = tracks.withColumn(c, F.lit(None).cast(k))
    moved = spark.createDataFrame([("comp", "single")], "album_key string, target string")
    albums = spark.createDataFrame([("own", 77)], "album_key string, streams long")
    got = {r["group"]: (r["n"], r["streams"], r["rank"]) for r in rollup.album_rollup(tracks, albums, moved).collect()}
    assert got == {"own": (2, 77, 0), "featurings": (2, None, 1), "singles": (2, None, 2)}


def test_lists_and_pages(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_bytes("Interprète;Titre;Éditeur / Distributeur;Catégorie;Certification;Date de sortie;Date de constat\nA;T;One;Two;Singles;Or;01/02/2020;03/04/2021\nB;\"U;V\";P;Albums;Platine;;05/06/2022\n".encode("latin-1"))
    rows = csv.french_list(spark, str(path)).orderBy("pos").collect()
    assert [(r["artist"], r["title"], r["publisher"], r["level"], r["certification_date"]) for r in rows] == [("A", "T", "One;Two", "Or", "2021-04-03"), ("B", "U;V", "P", "Platine", "2022-06-05")]
    unified = csv.unified(csv.french_list(spark, str(path)), "SNEP").orderBy("artist_clean").collect()
    assert [(r["cat"], r["country"], r["date"]) for r in unified] == [("single", "FR", "2021-04-03"), ("album", "FR", "2022-06-05")]
    html = '<table class="addpos"><tr><th>T</th></tr><tr><td>* <a href="https://o/track/abc.html">So &amp; So</a></td><td>1,234</td><td></td></tr><tr><td>No link</td><td>5</td><td>1</td></tr></table>'
    row = pages.stream_rows(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r["title"], r["streams"], r["daily"], r["external_id"], r["is_feature"]) for r in row] == [("So & So", 1234, 0, "abc", True)]
    block = '<div class="certification"><p class="artist">A</p><p class="title">T</p><p class="level">Or</p><p class="date">2020</p></div><div class="certification"><p class="artist">B</p></div>'
    assert [(r["artist"], r["level"]) for r in pages.certification_blocks(spark.createDataFrame([(1, block)], "page_id long, html string")).collect()] == [("A", "Or")]
    df = spark.createDataFrame([('[{"type":"samples","songs":[{"id":1,"title":"x"}]},{"type":"cover","songs":[]}]', "{bad", '{"content":[{"id":5}]}')], "a string, b string, c string")
    r = df.select(F.size(json_source.relationships(F.col("a"))), F.size(json_source.relationships(F.col("b"))), json_source.first_track(F.col("c"))).first()
    assert tuple(r) == (1, 0, '{"id":5}')


def test_streaming_ingest_is_repeatable(spark, tmp_path, small):
    source, root = str(tmp_path / "in"), str(tmp_path / "table")
    events = spark.read.parquet(f"{small}/events.parquet").selectExpr("user_id AS track_id", "event_id AS obs_id", "'bpm' AS field", "cast(value AS string) AS value", "event_type AS source", "value AS confidence")
    for part in range(2):
        events.where(F.col("obs_id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        ingest.into_versions(stream, root, str(tmp_path / "check"), accumulate.upsert_observations).awaitTermination()
    assert sinks.load_version(spark, root).count() == events.select("track_id", "field", "source").distinct().count()
    late = spark.readStream.schema(spark.read.parquet(f"{small}/events.parquet").schema).parquet(f"{small}/events.parquet*")
    q = ingest.windowed_counts(late, "ts", "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 1000


def test_audits(spark):
    rows = spark.createDataFrame([("a", "2020-01-05"), ("a", "2020-04-05"), ("b", "2020-02-01")], "k string, d string").withColumn("d", F.col("d").cast("date"))
    got = sorted((r["k"], str(r["month"]), r["n"]) for r in quality.month_calendar(rows, "d", ["k"]).collect())
    assert got == [("a", "2020-01-01", 1), ("a", "2020-02-01", 0), ("a", "2020-03-01", 0), ("a", "2020-04-01", 1), ("b", "2020-02-01", 1)]
    with pytest.raises(ValueError):
        quality.by_tempo(rows, 20)
