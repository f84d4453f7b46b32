"""Queries of bucketed tables, feeds with repeated keys, backfills, coverage, statistics, listing orders and cross-checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crategraph.functions import catalog, text
from crategraph.operators import accumulate, quality, resolve, rollup, similar
from crategraph.plans.catalog_queries import query
from crategraph.shared import scratch, table
from crategraph.sources import csv

# a feed of one to three rows for some customers and for no one, applied in the order of the orders
_FEED = (
    "WITH b AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k, any_value(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END ORDER BY c_custkey) AS title, bool_or(c_custkey % 5 = 0) AS lyr, any_value('page ' || c_custkey ORDER BY c_custkey) AS page FROM customer WHERE c_custkey % 4 <> 1 AND (c_custkey % 50 <> 0 OR c_custkey = 0) GROUP BY 1), "
    "f AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey AS seq, CASE WHEN o_orderkey % 3 <> 0 THEN 'title ' || o_orderkey END AS title, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 2 = 0 END AS feat, o_orderkey % 11 = 0 AS lyr, 'page of ' || o_orderkey AS page FROM orders WHERE o_custkey % 10 < 2), "
    "n AS (SELECT k, arg_max(title, seq) FILTER (title IS NOT NULL) AS title, arg_max({v: feat}, seq).v AS feat, bool_or(lyr) AS lyr, arg_min(page, seq) AS page FROM f GROUP BY k) "
    "SELECT CASE WHEN b.page IS NULL THEN n.k ELSE b.k END AS track_id, coalesce(n.title, b.title) AS title, CASE WHEN n.page IS NOT NULL THEN n.feat ELSE true END AS is_featuring, coalesce(b.lyr, false) OR coalesce(n.lyr, false) AS has_lyrics, coalesce(b.page, n.page) AS page_title FROM b FULL JOIN n ON b.k IS NOT DISTINCT FROM n.k"
)


@query(_FEED)
def bucketed_upsert(spark, d):
    """A table in 16 buckets takes a feed with repeated and null keys; only buckets of the feed's keys are rewritten."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    base = table(spark, d, "customer").where((c % 4 != 1) & ((c % 50 != 0) | (c == 0)))
    base = base.select(F.when(c % 50 != 0, c).alias("track_id"), F.when(c % 3 != 0, F.col("c_name")).alias("title"), F.lit(True).alias("is_featuring"), (c % 5 == 0).alias("has_lyrics"), F.concat(F.lit("page "), c).alias("page_title"))
    feed = table(spark, d, "orders").where(F.col("o_custkey") % 10 < 2)
    feed = feed.select(F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("track_id"), o.alias("at"), F.when(o % 3 != 0, F.concat(F.lit("title "), o)).alias("title"), F.when(o % 7 != 0, o % 2 == 0).alias("is_featuring"), (o % 11 == 0).alias("has_lyrics"), F.concat(F.lit("page of "), o).alias("page_title"))
    path = scratch(spark, "bucketed")
    accumulate.create_bucketed(base, path, ["track_id"], 16)
    accumulate.upsert_bucketed(spark, path, feed, ["track_id"], 16, order="at", overwrite=("is_featuring",), sticky=("has_lyrics",), insert_only=("page_title",))
    return accumulate.read_bucketed(spark, path)


@query(
    "WITH c AS (SELECT c_custkey AS k, c_custkey * 7 AS streams FROM customer WHERE c_custkey % 3 = 0), o AS (SELECT user_id AS k, event_id AS i, value::BIGINT AS v FROM events WHERE event_type = 'view'), "
    "known AS (SELECT k, min(i) AS i, arg_max(v, i) AS v FROM o GROUP BY k), fresh AS (SELECT k, streams, row_number() OVER (ORDER BY k) + (SELECT max(i) FROM o) AS i FROM c) "
    "SELECT coalesce(fresh.k, known.k) AS track_id, coalesce(known.i, fresh.i) AS obs_id, coalesce(streams, v)::VARCHAR AS value FROM known FULL JOIN fresh ON known.k = fresh.k"
)
def counter_ids(spark, d):
    """Counters become observations that are numbered behind the known ones in the order of their tracks."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.lit(None).cast("bigint").alias("spotify_streams"))
    known = table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("track_id"), F.lit("spotify_streams").alias("field"), F.bround("value").cast("bigint").cast("string").alias("value"), F.lit("kworb").alias("source"), F.lit(None).cast("double").alias("confidence"), F.col("event_id").alias("obs_id"))
    counters = c.where("track_id % 3 = 0").select("track_id", (F.col("track_id") * 7).alias("spotify_streams"))
    return accumulate.write_through(c, known, counters, "spotify_streams", "kworb")[1].select("track_id", "obs_id", "value")


@query(
    "WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unreadable' ELSE ['Do', 'Do#/Réb', 'Ré', 'Ré#/Mib', 'Mi', 'Fa', 'Fa#/Solb', 'Sol', 'Sol#/Lab', 'La', 'La#/Sib', 'Si'][c_custkey % 12 + 1] || CASE WHEN c_custkey % 2 = 1 THEN ' majeur' ELSE ' mineur' END END AS k FROM customer), "
    "o AS (SELECT user_id AS id, CASE event_type WHEN 'view' THEN 'key' WHEN 'click' THEN 'mode' ELSE 'bpm' END AS field, CASE WHEN event_id % 4 = 0 THEN 'deezer+songbpm' ELSE 'deezer' END AS source, event_id::VARCHAR AS value FROM events WHERE user_id % 6 = 0) "
    "SELECT id AS track_id, field, value, source FROM o WHERE NOT (field = 'bpm' AND contains(source, '+')) UNION ALL SELECT id, f.field, CASE f.field WHEN 'key' THEN id % 12 ELSE id % 2 END::VARCHAR, 'legacy' FROM t, (VALUES ('key'), ('mode')) f(field) WHERE k IS NOT NULL AND k <> 'unreadable' AND id NOT IN (SELECT id FROM o WHERE field IN ('key', 'mode'))"
)
def key_backfill(spark, d):
    """Orphaned keys back to pitch and mode, then tempi of combined sources purged."""
    k = F.col("c_custkey")
    key = catalog.french_key(k % 12, k % 2)
    tracks = table(spark, d, "customer").select(k.alias("track_id"), F.when(k % 5 == 1, "unreadable").when(k % 5 != 0, key).alias("musical_key"))
    field = F.when(F.col("event_type") == "view", "key").when(F.col("event_type") == "click", "mode").otherwise("bpm")
    obs = table(spark, d, "events").where("user_id % 6 = 0").select(F.col("user_id").alias("track_id"), field.alias("field"), F.col("event_id").cast("string").alias("value"), F.when(F.col("event_id") % 4 == 0, "deezer+songbpm").otherwise("deezer").alias("source"))
    return accumulate.without_combined(accumulate.backfill_keys(tracks, obs))


_DAYS = "WITH d AS (SELECT o_orderdate::DATE AS day FROM orders WHERE year(o_orderdate) <> 1997 AND NOT (year(o_orderdate) = 1999 AND month(o_orderdate) IN (2, 5)) AND (year(o_orderdate) <> 2000 OR day(o_orderdate) = 7 AND o_orderkey % 4 = 0)), "


@query(
    _DAYS + "y AS (SELECT y, count(day) AS n FROM range((SELECT min(year(day)) FROM d), (SELECT max(year(day)) + 1 FROM d)) r(y) LEFT JOIN d ON year(day) = y GROUP BY y), w AS (SELECT *, coalesce(lag(n) OVER (ORDER BY y), 0) + coalesce(lead(n) OVER (ORDER BY y), 0) AS near FROM y), "
    "m AS (SELECT y.y, m, count(day) AS n, any_value(y.n) AS of_year FROM y JOIN range(1, 13) q(m) ON true LEFT JOIN d ON year(day) = y.y AND month(day) = m WHERE make_date(y.y, m, 1) <= DATE '2001-09-15' GROUP BY 1, 2) "
    "SELECT 'year' AS kind, y::INT AS year, NULL::INT AS month, n FROM y UNION ALL SELECT 'missing', y, NULL, n FROM w WHERE n = 0 AND near > 0 UNION ALL SELECT 'gap', y, m, n FROM m WHERE of_year >= 12 AND n = 0 UNION ALL SELECT 'low', y, m, n FROM m WHERE y IN (2000, 2001) AND n BETWEEN 1 AND 2 UNION ALL SELECT 'fresh', NULL, NULL, date_diff('day', max(day), DATE '2001-09-15') FROM d"
)
def coverage_report(spark, d):
    """Orders without one year and two months of another, few in a third, as of a fixed day."""
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").where((F.year(day) != 1997) & ~((F.year(day) == 1999) & F.month(day).isin(2, 5)) & ((F.year(day) != 2000) | ((F.dayofmonth(day) == 7) & (F.col("o_orderkey") % 4 == 0))))
    return quality.coverage(rows.select(day.alias("day")), "day", F.lit("2001-09-15").cast("date"), (2000, 2001))


@query(
    "SELECT 'artists' AS name, count(*) AS n FROM customer UNION ALL SELECT 'tracks', count(*) FROM orders UNION ALL SELECT 'credits', count(*) FROM lineitem UNION ALL "
    "SELECT 'complete tracks', count(*) FROM (SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2) UNION ALL SELECT 'recent errors', count(*) FILTER (ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY) FROM events WHERE event_type = 'error'"
)
def global_statistics(spark, d):
    """As of the last event."""
    events = table(spark, d, "events")
    now = events.agg(F.max("ts")).scalar()
    errors = events.where("event_type = 'error'").select(F.col("ts").alias("error_time"))
    credits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_returnflag").alias("role"))
    return quality.global_statistics(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id")), credits, errors, now, ("A", "R"))


# the eleven keys in SQL; texts of the tables are plain, but for accents that are put in
_KEYS = {
    "title": "lower(strip_accents(title))", "album": "lower(strip_accents(coalesce(album, '')))", "artist": "lower(strip_accents(coalesce(nullif(prim, ''), artist)))", "release_date": "coalesce(released, DATE '0001-01-01')",
    "credits": "coalesce(credits, 0)", "lyrics": "(lyr::INT * 2 + (lyr AND sync)::INT)", "bpm": "coalesce(bpm, 0)", "duration": "coalesce(secs, 0)",
    "certification": "CASE WHEN cert IS NULL THEN 12 WHEN cert = 'Gold' THEN 11 ELSE list_position(['Quadruple Diamant', 'Triple Diamant', 'Double Diamant', 'Diamant', 'Triple Platine', 'Double Platine', 'Platine', 'Triple Or', 'Double Or', 'Or'], cert) END",
    "streams": "coalesce(CASE WHEN sp > 0 AND yt > 0 THEN (sp + yt) / (0.4::DOUBLE + 0.25::DOUBLE) WHEN sp > 0 THEN sp / 0.4::DOUBLE WHEN yt > 0 THEN yt / 0.25::DOUBLE END, -1)::DOUBLE", "status": "list_position(['complete', 'partial', 'disabled'], status)",
}
_LISTED = (
    "WITH t AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', 'É') ELSE p_name END || ' ' || p_partkey % 10 AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS album, CASE WHEN p_partkey % 5 = 0 THEN p_type WHEN p_partkey % 5 = 1 THEN '' END AS prim, 'Nobody' AS artist, "
    "CASE WHEN p_partkey % 6 <> 0 THEN DATE '2001-01-01' + (p_partkey * 37 % 1000)::INT END AS released, nullif(p_size, 3) AS credits, p_partkey % 3 <> 1 AS lyr, p_partkey % 2 = 0 AS sync, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey * 13 % 180 END AS bpm, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey * 11 % 400 END AS secs, "
    "CASE WHEN p_partkey % 12 = 11 THEN 'Gold' WHEN p_partkey % 12 < 10 THEN ['Quadruple Diamant', 'Triple Diamant', 'Double Diamant', 'Diamant', 'Triple Platine', 'Double Platine', 'Platine', 'Triple Or', 'Double Or', 'Or'][p_partkey % 12 + 1] END AS cert, CASE WHEN p_partkey % 9 > 2 THEN p_partkey * 17 % 1009 END AS sp, CASE WHEN p_partkey % 9 > 5 THEN p_partkey * 19 % 1013 END AS yt, CASE p_partkey % 5 WHEN 0 THEN 'disabled' WHEN 1 THEN 'complete' ELSE 'partial' END AS status FROM part) "
)


@query(_LISTED + " UNION ALL ".join(f"SELECT '{c}' AS by, {down} AS descending, pos, place FROM (SELECT pos, (row_number() OVER (ORDER BY {key} {'DESC' if down == 'true' else 'ASC'}, pos))::INT AS place FROM t) WHERE place <= 40" for c, key in _KEYS.items() for down in ("false", "true")))
def listing_orders(spark, d):
    """The first 40 rows of a listing by each of its eleven columns, both ways."""
    k = F.col("p_partkey")
    levels = F.array(*(F.lit(x) for x in ("Quadruple Diamant", "Triple Diamant", "Double Diamant", "Diamant", "Triple Platine", "Double Platine", "Platine", "Triple Or", "Double Or", "Or")))
    tracks = table(spark, d, "part").select(
        k.alias("pos"), F.concat(F.when(k % 3 == 0, F.replace("p_name", F.lit("e"), F.lit("É"))).otherwise(F.col("p_name")), F.lit(" "), k % 10).alias("title"), F.when(k % 4 != 0, F.col("p_brand")).alias("album"),
        F.when(k % 5 == 0, F.col("p_type")).when(k % 5 == 1, "").alias("primary_artist"), F.lit("Nobody").alias("artist"), F.when(k % 6 != 0, F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (k * 37 % 1000).cast("int")), "yyyy-MM-dd")).alias("release_date"),
        F.nullif("p_size", F.lit(3)).alias("credits"), (k % 3 != 1).alias("has_lyrics"), ((k % 3 != 1) & (k % 2 == 0)).alias("synced"), F.when(k % 7 != 0, k * 13 % 180).alias("bpm"), F.when(k % 8 != 0, k * 11 % 400).cast("string").alias("duration"),
        F.when(k % 12 == 11, "Gold").otherwise(F.get(levels, (k % 12).cast("int"))).alias("certification"), F.when(k % 9 > 2, k * 17 % 1009).alias("spotify_streams"), F.when(k % 9 > 5, k * 19 % 1013).alias("ytm_streams"), F.when(k % 5 == 0, "disabled").when(k % 5 == 1, "complete").otherwise("partial").alias("status"),
    )

    def top(column: str, descending: bool) -> DataFrame:
        some = rollup.listing(tracks, column, descending).limit(40)
        key = rollup.listing_key(column)
        place = F.row_number().over(Window.orderBy(key.desc() if descending else key.asc(), "pos"))  # 40 rows
        return some.select(F.lit(column).alias("by"), F.lit(descending).alias("descending"), "pos", place.alias("place"))

    return reduce(DataFrame.unionAll, (top(c, down) for c in rollup.LISTING for down in (False, True)))


@query(
    "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 5 THEN false ELSE true END AS valid, CASE o_orderkey % 7 WHEN 4 THEN NULL WHEN 5 THEN false WHEN 6 THEN false ELSE true END AS same, abs(o_orderkey % 5 - 2) <= 1 AS length FROM orders"
)
def release_checks(spark, d):
    """Dates in four forms, none, unreadable and another day; durations a few seconds apart."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    said = F.when(k % 7 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 7 == 1, F.date_format(day, "yyyy/M/d")).when(k % 7 == 2, F.date_format(day, "dd-MM-yyyy")).when(k % 7 == 3, F.date_format(day, "d/M/yyyy")).when(k % 7 == 5, F.date_format(day, "MMM yyyy")).when(k % 7 == 6, F.date_format(F.date_add(day, 1), "yyyy-MM-dd"))
    check = resolve.dates_agree(F.date_format(day, "yyyy-MM-dd"), said)
    return table(spark, d, "orders").select(k.alias("id"), check["valid"].alias("valid"), check["match"].alias("same"), resolve.duration_agrees(F.lit(200) + k % 5, F.lit(202), 1).alias("length"))


_HEARD = "h AS (SELECT p_partkey AS id, lower(p_name) AS want, lower(CASE p_partkey % 3 WHEN 0 THEN p_name ELSE left(p_name, 3) || substr(p_name, 5) || ' x' END) AS got, lower(p_type) AS who, lower(CASE WHEN p_partkey % 4 <> 0 THEN left(p_type, 4) END) AS one, CASE WHEN p_partkey % 4 <> 0 THEN 'nobody' END AS two FROM part)"


@query(
    f"WITH RECURSIVE {_HEARD}, pairs AS (SELECT want AS a, got AS b FROM h UNION SELECT who, one FROM h WHERE one IS NOT NULL UNION SELECT who, two FROM h WHERE two IS NOT NULL), {similar.ratio_sql('pairs')} "
    "SELECT id, round(x.ratio * 0.6::DOUBLE + coalesce(greatest(y.ratio, z.ratio), 0) * 0.4::DOUBLE, 6) AS score FROM h JOIN alike x ON x.a = want AND x.b = got LEFT JOIN alike y ON y.a = who AND y.b = one LEFT JOIN alike z ON z.a = who AND z.b = two"
)
def relevance_scores(spark, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    got = F.when(k % 3 == 0, n).otherwise(F.concat(F.left(n, F.lit(3)), F.substring(n, 5, 99), F.lit(" x")))
    artists = F.when(k % 4 != 0, F.array(F.left("p_type", F.lit(4)), F.lit("Nobody")))
    score = text.relevance(F.upper(got), artists, n, F.col("p_type"))
    return table(spark, d, "part").select(k.alias("id"), F.round(score, 6).alias("score"))


@query(
    "WITH t AS (SELECT c_custkey AS k, 100 + c_custkey % 50 AS v, CASE WHEN c_custkey % 10 < 5 THEN 15 ELSE 19 END AS d FROM customer) "
    "SELECT k AS track_id, 'bpm' AS field, CASE WHEN k % 4 = 0 THEN 60 + k % 120 WHEN k % 3 = 0 THEN v ELSE 90 END::VARCHAR AS value, CASE WHEN k % 4 = 0 THEN 'manual' WHEN k % 3 = 0 THEN 'reccobeats' ELSE 'legacy' END AS source, CASE WHEN k % 4 = 0 THEN 0.9 WHEN k % 3 = 0 THEN 1.0 END::DOUBLE AS confidence, "
    "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 3 = 0 THEN CASE WHEN v // 2 >= 55 THEN v // 2 END ELSE 45 END::VARCHAR AS alt FROM t WHERE k % 4 = 0 OR k % 3 = 0 OR k % 5 = 0 "
    "UNION ALL SELECT k, 'lyrics_synced', CASE s WHEN 'LRCLIB' THEN '[00:10.00] a' WHEN 'YouTube Music' THEN '[00:20.00] b' ELSE '[00:30.00] c' END, s, 1.0, NULL FROM (SELECT k, CASE WHEN k % 2 = 0 AND (k % 3 <> 0 OR d = 15) THEN 'LRCLIB' WHEN k % 3 = 0 THEN 'YouTube Music' WHEN k % 7 <> 0 THEN 'Musixmatch' END AS s FROM t) WHERE s IS NOT NULL "
    "UNION ALL SELECT k, 'release_date', '2001-01-02', 'manual', 0.8, NULL FROM t WHERE k % 6 = 0"
)
def reconciled_by_hand(spark, d):
    """Tempi set by hand, voted and of old, and timed lyrics of three services, reconciled together."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")

    def said(keep, field: str, value, source: str, n: int, confidence=None) -> DataFrame:
        return c.where(keep).select(k.alias("track_id"), (k * 10 + n).alias("obs_id"), F.lit(field).alias("field"), F.lit(value).cast("string").alias("value") if isinstance(value, (str, int)) else value.cast("string").alias("value"), F.lit(source).alias("source"), F.lit(confidence).cast("double").alias("confidence"))

    some = [
        said(k % 4 == 0, "bpm", 60 + k % 120, "manual", 5, 0.9), said(k % 3 == 0, "bpm", 100 + k % 50, "reccobeats", 1, 0.7), said(k % 5 == 0, "bpm", 90, "legacy", 2), said(k % 5 == 0, "bpm_alt", 45, "legacy", 3),
        said(k % 2 == 0, "lyrics_synced", "[00:10.00] a", "lrclib", 6), said(k % 3 == 0, "lyrics_synced", "[00:20.00] b", "ytmusic", 7), said(k % 7 != 0, "lyrics_synced", "[00:30.00] c", "musixmatch", 8),
        said(k % 6 == 0, "release_date", "2001-01-02", "manual", 4, 0.8), said(k % 6 == 0, "release_date", "1999-01-02", "deezer", 9, 0.8),
    ]
    durations = c.select(k.alias("track_id"), F.when(k % 10 < 5, 15.0).otherwise(19.0).alias("duration"))
    return resolve.reconcile(reduce(DataFrame.unionAll, some), durations).select("track_id", "field", "value", "source", "confidence", "alt")


@query(
    "WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS bpm FROM part) "
    "SELECT CASE WHEN a.k % 5 = 0 THEN b.k ELSE a.k END AS track_id, CASE WHEN a.k % 5 = 0 THEN coalesce(b.title, a.title) ELSE coalesce(a.title, b.title) END AS title, CASE WHEN a.k % 5 = 0 THEN coalesce(b.bpm, a.bpm) ELSE coalesce(a.bpm, b.bpm) END AS bpm FROM p a JOIN p b ON b.k = a.k + 1 WHERE a.k % 2 = 0"
)
def merged_gaps(spark, d):
    """Neighbouring parts as duplicate pairs: the kept one's gaps are filled from the other."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("track_id"), F.when(k % 3 != 0, F.col("p_name")).alias("title"), F.when(k % 4 != 0, F.col("p_size")).alias("bpm"))
    pairs = p.where("track_id % 2 = 0").alias("a").join(p.alias("b"), F.col("b.track_id") == F.col("a.track_id") + 1)
    pairs = pairs.withColumn("keep_id", F.when(F.col("a.track_id") % 5 == 0, F.col("b.track_id")).otherwise(F.col("a.track_id")))
    return rollup.filled_from(pairs, ["title", "bpm"])


@query(
    "WITH n AS (SELECT lower(trim(s_name)) AS member, count(DISTINCT l_orderkey) AS tracks FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) SELECT member, round(1.0::DOUBLE + 3.0::DOUBLE * sqrt(tracks / (SELECT max(tracks) FROM n)), 6) AS size FROM n"
)
def node_sizes(spark, d):
    credits = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = credits.select(F.col("l_orderkey").alias("track_id"), F.col("s_name").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    nodes = rollup.collaboration_nodes(rollup.members(named, F.lower(F.trim("name"))))
    return nodes.select("member", F.round(rollup.node_scale(F.col("tracks"), nodes.agg(F.max("tracks")).scalar()), 6).alias("size"))


@query("SELECT p_brand AS artist, p_name AS title, '' AS publisher, '' AS category, p_type AS level, '' AS release_date, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_partkey::VARCHAR END AS certification_date FROM part")
def renamed_headers(spark, d):
    """Columns under other spellings of the French list's headers, and some that are missing."""
    k = F.col("p_partkey")
    odd = table(spark, d, "part").select(F.col("p_brand").alias("INTERPRETE "), F.col("p_name").alias("titre"), F.col("p_type").alias("certification"), F.when(k % 3 != 0, k).alias("date-de constat"), F.lit(1).alias("other"))
    return csv.with_headers(odd, csv.FRENCH_HEADERS)


@query("SELECT count(*) AS rows, max(o_orderdate)::DATE AS last, date_diff('day', max(o_orderdate)::DATE, DATE '2003-04-05') AS days FROM orders")
def list_freshness(spark, d):
    fresh = quality.freshness(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day", F.lit("2003-04-05").cast("date"))
    return fresh.select("rows", "last", F.col("days").cast("bigint").alias("days"))
