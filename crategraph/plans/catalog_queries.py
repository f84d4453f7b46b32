"""The catalog's operators on the star-schema tables.

Stand-ins: customer for artist, orders for track, lineitem for credit (supplier for the credited person), part for title and
album, events for observations (user for track, type for source, value for tempo). Nulls are injected by stated rules where
the tables have none. Each query has its SQL beside it, but those that need a similarity ratio, a fold or a page parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crategraph.functions import catalog, parse, text
from crategraph.operators import accumulate, match, quality, resolve, rollup, similar
from crategraph.shared import table, whole_text_batches
from crategraph.sources import json as json_source
from crategraph.sources import pages as page_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- co-credit graph


def _members(spark: SparkSession, d: str) -> DataFrame:
    credits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_suppkey").alias("s_suppkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    named = credits.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey")
    return rollup.members(named, F.lower(F.trim("name")))


_MEMBERS = "WITH m AS (SELECT DISTINCT l_orderkey AS t, lower(trim(s_name)) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) "


@query(_MEMBERS + "SELECT x.k AS a, y.k AS b, count(*) AS weight FROM m x JOIN m y ON x.t = y.t AND x.k < y.k GROUP BY 1, 2")
def collab_edges(spark, d):
    return rollup.collaboration_edges(_members(spark, d))


@query("WITH m AS (SELECT lower(trim(s_name)) AS k, s_name, l_orderkey AS t, l_orderkey * 10 + l_linenumber AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT k AS member, arg_min(s_name, p) AS name, count(DISTINCT t) AS tracks FROM m GROUP BY k")
def collab_nodes(spark, d):
    return rollup.collaboration_nodes(_members(spark, d))


@query(_MEMBERS + ", g AS (SELECT t, string_agg(k, '|' ORDER BY k) AS members FROM m GROUP BY t) SELECT members, count(*) AS tracks, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS titles FROM g JOIN orders ON t = o_orderkey GROUP BY members")
def collab_groups(spark, d):
    tracks = table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), F.col("o_orderpriority").alias("title"))
    return rollup.collaboration_groups(_members(spark, d), tracks)


# ---------------------------------------------------------------- reconciliation

_SOURCES = {"view": "reccobeats", "click": "getsongbpm", "purchase": "songbpm", "error": "deezer", "signup": "legacy"}


def _observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    field = F.when(F.col("event_id") % 5 == 0, "key").when(F.col("event_id") % 5 == 1, "mode").when(F.col("event_id") % 5 == 2, "duration").otherwise("bpm")
    confidence = F.when(F.col("event_id") % 7 != 0, F.round("value", 2))
    return e.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("obs_id"), field.alias("field"), F.round("value", 2).cast("string").alias("value"), catalog.lookup(_SOURCES, F.col("event_type")).alias("source"), confidence.alias("confidence"))


_OBS = (
    "WITH o AS (SELECT user_id AS track_id, event_id AS obs_id, CASE event_id % 5 WHEN 0 THEN 'key' WHEN 1 THEN 'mode' WHEN 2 THEN 'duration' ELSE 'bpm' END AS field, round(value, 2)::VARCHAR AS value, "
    "CASE event_type WHEN 'view' THEN 'reccobeats' WHEN 'click' THEN 'getsongbpm' WHEN 'purchase' THEN 'songbpm' WHEN 'error' THEN 'deezer' ELSE 'legacy' END AS source, "
    "CASE WHEN event_id % 7 <> 0 THEN round(value, 2) END AS confidence FROM events), "
    "r AS (SELECT *, CASE source WHEN 'reccobeats' THEN 3 WHEN 'getsongbpm' THEN 2 WHEN 'songbpm' THEN 1 ELSE 0 END AS rank FROM o) "
)


@query(_OBS + "SELECT track_id, field, obs_id, source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY track_id, field ORDER BY confidence DESC NULLS LAST, rank DESC, obs_id) AS n FROM r) WHERE n = 1")
def default_resolution(spark, d):
    return resolve.most_confident(_observations(spark, d)).select("track_id", "field", "obs_id", "source", "confidence")


@query(_OBS + "SELECT track_id, field, source, count(*) AS n FROM (SELECT *, max((source <> 'legacy')::INT) OVER (PARTITION BY track_id, field) AS real FROM r) WHERE source <> 'legacy' OR real = 0 GROUP BY ALL")
def legacy_fallback(spark, d):
    return resolve.without_legacy(_observations(spark, d)).groupBy("track_id", "field", "source").agg(F.count("*").alias("n"))


@query(
    _OBS
    + ", k AS (SELECT track_id, source, arg_max(value, obs_id) FILTER (field = 'key') AS kv, arg_max(coalesce(confidence, -1e300), obs_id) FILTER (field = 'key') AS kc, arg_max(value, obs_id) FILTER (field = 'mode') AS mv, max(rank) AS rank FROM (SELECT *, max((source <> 'legacy')::INT) OVER (PARTITION BY track_id, field) AS real FROM r WHERE field IN ('key', 'mode')) WHERE source <> 'legacy' OR real = 0 GROUP BY 1, 2), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY kc DESC, rank DESC, source) AS n FROM k WHERE kv IS NOT NULL AND mv IS NOT NULL) "
    "SELECT track_id, 'key' AS field, kv AS value, source FROM b WHERE n = 1 UNION ALL SELECT track_id, 'mode', mv, source FROM b WHERE n = 1"
)
def key_mode_pairing(spark, d):
    return resolve.key_and_mode(_observations(spark, d)).select("track_id", "field", "value", "source")


@query()
def tempo_vote(spark, d):
    obs = _observations(spark, d).where("field = 'bpm' AND source <> 'legacy'").withColumn("track_id", F.col("track_id") * 1000 + F.floor(F.col("obs_id") / 4) % 1000)
    return resolve.tempo_vote(obs)


@query()
def whole_track_reconcile(spark, d):
    return resolve.reconcile(_observations(spark, d))


@query("SELECT user_id AS track_id, CASE WHEN n >= 2 AND n > coalesce(nxt, 0) THEN event_type END AS winner, n AS votes FROM (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS nxt FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type)) WHERE r = 1")
def vote_plurality(spark, d):
    return resolve.plurality(table(spark, d, "events").withColumnRenamed("user_id", "track_id"), "track_id", "event_type")


@query(
    "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 5), c AS (SELECT user_id, event_type, count(*) AS n FROM f GROUP BY 1, 2), "
    "r AS (SELECT *, sum(n) OVER (PARTITION BY user_id)::BIGINT AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) "
    "SELECT user_id AS track_id, CASE WHEN (n >= 2 AND n * 2 > total) OR total = 1 THEN event_type END AS winner, n AS votes, total AS voters FROM r WHERE k = 1"
)
def vote_majority(spark, d):
    return resolve.majority(table(spark, d, "events").withColumnRenamed("user_id", "track_id"), "track_id", "event_type", "event_id")


@query(
    "WITH r AS (SELECT DISTINCT l_suppkey AS s, p_name AS t FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3), o AS (SELECT DISTINCT l_suppkey AS s, p_name AS t FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber > 3), "
    "j AS (SELECT r.s, count(*) AS n, count(o.t) AS m FROM r LEFT JOIN o ON r.s = o.s AND r.t = o.t GROUP BY r.s) SELECT s AS artist_id, n AS remote_titles, m AS matched, 0::BIGINT AS album_overlap, m / n AS ratio, m < 2 OR m / n < 0.3 AS suspect FROM j"
)
def identity_gate(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("artist_id"), F.col("p_name").alias("title"), "l_linenumber")
    return resolve.identity_gate(rows.where("l_linenumber <= 3"), rows.where("l_linenumber > 3"), "artist_id", "title")


@query("SELECT o_custkey AS track_id, min(o_orderdate) AS release_date FROM orders GROUP BY 1")
def earliest_release(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("obs_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), F.lit(False).alias("forced"))
    return resolve.earliest_release(o).withColumn("release_date", F.col("release_date").cast("timestamp_ntz"))


@query("SELECT event_type AS source, CASE WHEN bool_or(value > 300) THEN '✓' WHEN bool_or(value > 200) THEN '?' WHEN bool_and(value < 0) THEN '-' ELSE '✗' END AS mark, count(*) FILTER (value > 300) AS ok, count(*) FILTER (value >= 0 AND value <= 200) AS failed FROM events GROUP BY 1")
def run_summary(spark, d):
    outcome = F.when(F.col("value") > 300, "ok").when(F.col("value") > 200, "doubt").when(F.col("value") < 0, "skipped").otherwise("failed")
    return resolve.run_summary(table(spark, d, "events").select(F.col("event_type").alias("source"), outcome.alias("outcome")))


# ---------------------------------------------------------------- accumulation

_CERTS = (
    "WITH c AS (SELECT o_orderkey AS pos, CASE o_custkey % 3 WHEN 0 THEN 'Artist ' ELSE 'ARTIST ' END || (o_custkey % 40) AS artist, ' Title ' || (o_custkey % 7) AS title, o_orderpriority AS category, "
    "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS certification_level, strftime(o_orderdate, '%Y-%m') AS certification_date FROM orders) "
)


def _certs(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("pos"),
        F.concat(F.when(F.col("o_custkey") % 3 == 0, "Artist ").otherwise("ARTIST "), F.col("o_custkey") % 40).alias("artist"),
        F.concat(F.lit(" Title "), F.col("o_custkey") % 7).alias("title"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("certification_level"),
        F.date_format("o_orderdate", "yyyy-MM").alias("certification_date"),
    )


@query(
    _CERTS
    + ", k AS (SELECT * FROM (SELECT pos, artist, trim(title) AS title, category, certification_level, certification_date, row_number() OVER (PARTITION BY upper(artist), upper(trim(title)), category, certification_level, certification_date ORDER BY pos) AS n FROM c) WHERE n = 1), "
    "f AS (SELECT *, max((certification_level <> '')::INT) OVER (PARTITION BY upper(artist), upper(title), category, certification_date) AS filled FROM k) "
    "SELECT pos, artist, title, category, certification_level, certification_date FROM f WHERE certification_level <> '' OR filled = 0"
)
def clean_belgian(spark, d):
    return accumulate.clean_belgian(_certs(spark, d))


@query(_CERTS + ", b AS (SELECT *, CASE WHEN pos % 10 < 7 THEN 0 ELSE 1 END AS feed FROM c) SELECT artist, title, arg_min(pos, feed * 1000000000000 + pos) AS pos, arg_min(category, feed * 1000000000000 + pos) AS category, certification_level, max(certification_date) AS certification_date FROM b GROUP BY artist, title, certification_level")
def accumulate_latest(spark, d):
    c = _certs(spark, d)
    return accumulate.accumulate(c.where("pos % 10 < 7"), c.where("pos % 10 >= 7"), ["artist", "title", "certification_level"])


@query("SELECT * FROM orders WHERE o_orderkey % 3 <> 0 UNION SELECT * FROM orders WHERE o_orderkey % 3 <> 1")
def exact_union_distinct(spark, d):
    o = table(spark, d, "orders")
    return accumulate.union_distinct(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 <> 1"))


@query("SELECT l_shipmode AS line, bool_and(added) AS added FROM (SELECT 'L' || l_partkey AS l_shipmode, false AS added FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'L' || l_partkey, true FROM lineitem WHERE l_linenumber > 1) GROUP BY 1")
def history_lines(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit(" L"), "l_partkey").alias("line"), "l_linenumber")
    return accumulate.history_lines(rows.where("l_linenumber = 1"), rows.where("l_linenumber > 1"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0 AND (o_custkey, o_orderstatus) NOT IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0)")
def incremental_new_rows(spark, d):
    o = table(spark, d, "orders")
    return accumulate.new_rows(o.where("o_orderkey % 4 = 0"), o.where("o_orderkey % 4 <> 0"), ["o_custkey", "o_orderstatus"]).select("o_orderkey", "o_custkey")


@query(
    "WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_mktsegment AS album, true AS feat, c_custkey % 5 = 0 AS lyr, c_name AS page FROM customer WHERE c_custkey % 3 <> 0), "
    "n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN 'new ' || c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN '[]' ELSE 'x' END AS album, CASE WHEN c_custkey % 11 <> 0 THEN false END AS feat, c_custkey % 3 = 1 AS lyr, 'new' AS page FROM customer WHERE c_custkey % 5 <> 0) "
    "SELECT coalesce(b.k, n.k) AS track_id, coalesce(n.name, b.name) AS title, coalesce(nullif(n.album, '[]'), b.album) AS certifications, CASE WHEN n.k IS NOT NULL THEN n.feat ELSE b.feat END AS is_featuring, coalesce(b.lyr, false) OR coalesce(n.lyr, false) AS has_lyrics, CASE WHEN b.k IS NOT NULL THEN b.page ELSE n.page END AS page_title FROM b FULL JOIN n ON b.k = n.k"
)
def upsert_coalesce(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    base = c.where(k % 3 != 0).select(k.alias("track_id"), F.when(k % 2 == 0, F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("certifications"), F.lit(True).alias("is_featuring"), (k % 5 == 0).alias("has_lyrics"), F.col("c_name").alias("page_title"))
    new = c.where(k % 5 != 0).select(k.alias("track_id"), F.when(k % 4 != 0, F.concat(F.lit("new "), "c_name")).alias("title"), F.when(k % 7 == 0, "[]").otherwise("x").alias("certifications"), F.when(k % 11 != 0, False).alias("is_featuring"), (k % 3 == 1).alias("has_lyrics"), F.lit("new").alias("page_title"))
    return accumulate.upsert(base, new, ["track_id"], overwrite=("is_featuring",), sticky=("has_lyrics",), insert_only=("page_title",), empty={"certifications": "[]"})


@query(_OBS + "SELECT track_id, field, source, arg_max(value, (obs_id % 3 = 0)::INT * 1000000000000 + obs_id) AS value, arg_min(obs_id, (obs_id % 3 = 0)::INT * 1000000000000 + obs_id) AS obs_id FROM r GROUP BY 1, 2, 3")
def observation_upsert(spark, d):
    o = _observations(spark, d)
    return accumulate.upsert_observations(o.where("obs_id % 3 <> 0"), o.where("obs_id % 3 = 0")).select("track_id", "field", "source", "value", "obs_id")


@query(
    "WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS credit_id, l_orderkey AS t, l_suppkey AS name, l_returnflag AS role, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS det FROM lineitem), "
    "m AS (SELECT *, CASE WHEN t % 4 = 0 THEN t - t % 100 + 1 ELSE t END AS keep, (t % 4 = 0)::INT AS moved FROM c), "
    "r AS (SELECT *, min(moved) OVER w AS own, row_number() OVER (PARTITION BY keep, name, role, coalesce(det, '') ORDER BY moved, credit_id) AS n FROM m WINDOW w AS (PARTITION BY keep, name, role, coalesce(det, ''))) "
    "SELECT credit_id, keep AS track_id FROM r WHERE moved = 0 OR (own = 1 AND n = 1)"
)
def merge_keep_priority(spark, d):
    li = table(spark, d, "lineitem")
    credits = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("credit_id"), F.col("l_orderkey").alias("track_id"), F.col("l_suppkey").alias("name"), F.col("l_returnflag").alias("role"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("role_detail"))
    k = F.col("o_orderkey")
    merges = table(spark, d, "orders").where(k % 4 == 0).select(k.alias("drop_id"), (k - k % 100 + 1).alias("keep_id"))
    return accumulate.merge_entities(credits, _observations(spark, d), merges)[0].select("credit_id", "track_id")


@query("SELECT c_custkey AS track_id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END ELSE CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END END AS youtube_url FROM customer")
def guarded_url(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    base = c.select(k.alias("track_id"), F.col("c_name").alias("youtube_url"), F.when(k % 3 == 0, "search_auto").when(k % 5 == 0, "manual").alias("youtube_url_source"))
    new = c.where(k % 2 == 0).select(k.alias("track_id"), F.lit("new").alias("youtube_url"), F.lit("search_auto").alias("youtube_url_source"))
    return accumulate.guarded_url(base, new, "track_id").select("track_id", "youtube_url")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return accumulate.cascade_delete({"orders": table(spark, d, "orders")}, gone, {"orders": "o_custkey"})["orders"].select("o_orderkey")


@query(
    "WITH t AS (SELECT c_custkey AS track_id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS title, c_mktsegment AS album FROM customer), u AS (SELECT track_id, 'title' AS field, title AS value FROM t UNION ALL SELECT track_id, 'album', album FROM t) "
    "SELECT track_id, field, value, 'legacy' AS source FROM u WHERE value IS NOT NULL AND (track_id, field) NOT IN (SELECT user_id, 'album' FROM events)"
)
def legacy_backfill(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("album"))
    seen = table(spark, d, "events").select(F.col("user_id").alias("track_id"), F.lit("album").alias("field"), F.lit("x").alias("value"), F.lit("real").alias("source"))
    return accumulate.backfill(t, seen, ("title", "album")).where("source = 'legacy'").select("track_id", "field", "value", "source")


@query("SELECT n_name AS source, CASE WHEN n_nationkey % 3 = 0 THEN 'ok' WHEN n_nationkey % 3 = 1 THEN 'broken' ELSE 'ok' END AS status, CASE WHEN n_nationkey % 3 = 2 THEN 1 ELSE 2 END AS checked_at, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS last_ok FROM nation")
def health_status(spark, d):
    n = table(spark, d, "nation")
    old = n.select(F.col("n_name").alias("source"), F.lit("ok").alias("status"), F.lit(1).alias("checked_at"), F.lit(1).alias("last_ok"))
    new = n.where("n_nationkey % 3 < 2").select(F.col("n_name").alias("source"), F.when(F.col("n_nationkey") % 3 == 0, "ok").otherwise("broken").alias("status"), F.lit(2).alias("checked_at"))
    return accumulate.health_status(old, new)


# ---------------------------------------------------------------- roll-ups


@query(
    "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT c_custkey AS artist_id, count(o_orderkey) AS tracks, coalesce(sum(c.n), 0)::BIGINT AS credits, max(o_orderdate) AS last_update FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY 1"
)
def artist_overview(spark, d):
    artists = table(spark, d, "customer").select(F.col("c_custkey").alias("artist_id"))
    tracks = table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), F.col("o_custkey").alias("artist_id"), F.col("o_orderdate").alias("updated_at"))
    return rollup.artist_overview(artists, tracks, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id")))


@query("SELECT o_orderkey AS track_id, o_orderdate AS updated_at, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS credits FROM (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20)")
def recent_tracks(spark, d):
    tracks = table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), F.col("o_orderdate").alias("updated_at"))
    return rollup.recent_tracks(tracks, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id")))


@query("SELECT l_returnflag AS role, count(*) AS n FROM lineitem GROUP BY 1")
def credits_by_role(spark, d):
    return rollup.credits_by_role(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("role")))


@query("SELECT l_orderkey AS track_id FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def complete_tracks(spark, d):
    return rollup.complete_by_roles(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_returnflag").alias("role")), ("A", "R"))


@query("SELECT lower(p_name) AS title_key, count(*) AS n, min(p_partkey) AS first_id, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part WHERE p_name <> '' GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark, d):
    return rollup.duplicate_titles(table(spark, d, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title")), F.lower("title"))


@query("SELECT p_brand AS artist_id, p_name AS title_key, count(*) AS n, min(p_partkey) AS first_id, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part WHERE p_name <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def normalized_duplicates(spark, d):
    # the names are plain lower-case words already, so the normal form is the name
    tracks = table(spark, d, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist_id"))
    return rollup.duplicate_titles(tracks, text.normalize_title(F.col("title")), ("artist_id",))


@query("SELECT lang AS field, count(*) AS n, sum(length(text))::BIGINT AS total, round(avg(length(text)), 2) AS mean, max(length(text)) AS longest FROM documents GROUP BY 1")
def field_volume(spark, d):
    return rollup.field_volume(table(spark, d, "documents").select(F.col("lang").alias("field"), F.col("text").alias("value")))


@query("SELECT l_orderkey AS track_id, sum(q)::BIGINT AS views, count(*) AS videos FROM (SELECT l_orderkey, l_partkey, arg_max(l_quantity::BIGINT, l_linenumber * 1000 + l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def views_dedup_sum(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_partkey").alias("video_id"), F.col("l_quantity").cast("bigint").alias("views"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("pos"))
    return rollup.views_by_track(v)


@query("SELECT l_partkey AS track_id, sum(l_quantity::BIGINT)::BIGINT AS streams, sum(l_linenumber)::BIGINT AS daily FROM lineitem GROUP BY 1")
def streams_by_track(spark, d):
    return rollup.streams_by_track(table(spark, d, "lineitem").select(F.col("l_partkey").alias("track_id"), F.col("l_quantity").cast("bigint").alias("streams"), F.col("l_linenumber").alias("daily")))


@query(
    "WITH a AS (SELECT p_partkey AS pos, p_brand AS album, lower(p_brand) AS k, p_size AS s, 'id' || (p_partkey % 30) AS i FROM part), f AS (SELECT k, i, min(pos) AS p FROM a GROUP BY 1, 2), g AS (SELECT k, string_agg(i, ',' ORDER BY p) AS ids FROM f GROUP BY 1) "
    "SELECT k AS album_key, arg_min(album, pos) AS album, sum(s)::BIGINT AS streams, sum(s)::BIGINT AS daily, any_value(ids) AS ids FROM a JOIN g USING (k) GROUP BY 1"
)
def streams_by_album(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("album"), F.col("p_size").cast("bigint").alias("streams"), F.col("p_size").cast("bigint").alias("daily"), F.concat(F.lit("id"), F.col("p_partkey") % 30).alias("external_id"))
    return rollup.streams_by_album(rows, F.lower("album"))


@query("SELECT lower(p_brand) AS album_key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 2")
def own_albums(spark, d):
    return rollup.own_albums(table(spark, d, "part").select(F.col("p_brand").alias("album")), F.lower("album"))


@query(
    "WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand || ' ' || (p_partkey % 97) END AS album, p_partkey % 4 = 0 AS feat, p_partkey % 10 = 0 AS dis, p_size AS cr, p_partkey % 3 = 0 AS lyr, p_size * 7 AS dur, p_size::BIGINT AS st FROM part), "
    "k AS (SELECT *, CASE WHEN album IS NULL THEN CASE WHEN feat THEN 'featurings' ELSE 'singles' END ELSE lower(album) END AS key, album IS NULL AS none FROM t), "
    "s AS (SELECT *, count(*) FILTER (NOT none) OVER (PARTITION BY key) AS size FROM k), "
    "g AS (SELECT *, CASE WHEN NOT none AND size = 1 AND feat THEN 'featurings' ELSE key END AS grp FROM s) "
    "SELECT grp AS \"group\", CASE WHEN grp IN ('featurings', 'singles') THEN grp ELSE min(album) END AS title, count(*) AS n, count(*) FILTER (dis) AS disabled, sum(cr)::BIGINT AS credits, count(*) FILTER (lyr) AS with_lyrics, sum(dur)::BIGINT AS seconds, nullif(sum(st), 0)::BIGINT AS streams, CASE grp WHEN 'singles' THEN 2 WHEN 'featurings' THEN 1 ELSE 0 END AS rank FROM g GROUP BY grp"
)
def album_rollup(spark, d):
    k = F.col("p_partkey")
    tracks = table(spark, d, "part").select(k.alias("track_id"), F.when(k % 6 != 0, F.concat_ws(" ", "p_brand", k % 97)).alias("album"), (k % 4 == 0).alias("is_featuring"), (k % 10 == 0).alias("disabled"), F.col("p_size").alias("credits"), (k % 3 == 0).alias("has_lyrics"), (F.col("p_size") * 7).alias("duration"), F.col("p_size").cast("bigint").alias("streams"), F.lit(None).cast("date").alias("release_date"))
    return rollup.album_rollup(tracks).drop("first_release")


@query("SELECT lower(p_brand) AS album_key, min(p_brand) AS album FROM part GROUP BY 1")
def album_list(spark, d):
    return rollup.album_list(table(spark, d, "part").select(F.col("p_brand").alias("album")), F.lower("album"))


@query("SELECT CASE WHEN l_quantity % 3 = 0 THEN NULL ELSE l_returnflag END AS f, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, f LIMIT 3")
def top_counts(spark, d):
    return rollup.top_counts(table(spark, d, "lineitem").select(F.when(F.col("l_quantity") % 3 != 0, F.col("l_returnflag")).alias("f")), "f", 3)


@query("SELECT o_orderkey AS track_id, o_orderpriority AS title, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders ORDER BY coalesce(price, -1) DESC, title, track_id LIMIT 50")
def sort_limit(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"))
    return rollup.sort_tracks(o, F.col("price"), descending=True, missing=-1.0).limit(50)


@query(
    "WITH t AS (SELECT p_partkey AS track_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size > 25 THEN 2 ELSE 0 END AS score FROM part) "
    "SELECT title, track_id, score FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, track_id) AS n FROM t) WHERE n = 1"
)
def duplicate_survivors(spark, d):
    k = F.col("p_partkey")
    some = lambda n: F.when(k % n == 0, "x")
    t = table(spark, d, "part").select(k.alias("track_id"), F.col("p_name").alias("title"), some(2).alias("album"), some(3).alias("genius_id"), some(5).alias("duration"), some(7).alias("external_id"), (k % 11 == 0).alias("has_lyrics"), F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0).alias("credits"))
    return rollup.most_complete(t, ["title"]).select("title", "track_id", "score")


@query("SELECT o_orderkey AS track_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0)")
def deleted_exclusion(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), F.col("o_custkey").alias("genius_id"))
    return rollup.excluded(o, table(spark, d, "customer").where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("genius_id")), "genius_id").select("track_id")


# ---------------------------------------------------------------- audits


@query(
    "WITH s AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT k, min(m) AS a, max(m) AS z FROM s GROUP BY 1), "
    "e AS (SELECT k, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM b) SELECT e.k AS o_custkey, count(*) AS months, count(*) FILTER (s.n IS NULL) AS empty, count(*) FILTER (s.n BETWEEN 1 AND 4) AS low, round(avg(coalesce(s.n, 0)), 4) AS mean FROM e LEFT JOIN s ON s.k = e.k AND s.m = e.m GROUP BY 1"
)
def month_coverage(spark, d):
    return quality.monthly_summary(table(spark, d, "orders"), "o_orderdate", ["o_custkey"])


@query(
    "WITH s AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT k, min(m) AS a, max(m) AS z FROM s GROUP BY 1), "
    "e AS (SELECT k, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM b) SELECT e.k AS o_custkey, count(*) AS n, count(*) FILTER (s.n IS NULL) AS gaps FROM e LEFT JOIN s ON s.k = e.k AND s.m = e.m WHERE coalesce(s.n, 0) < 3 GROUP BY 1"
)
def month_gaps(spark, d):
    return quality.month_gaps(table(spark, d, "orders"), "o_orderdate", ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "gap").alias("gaps"))


@query(
    "WITH s AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) <> 1997 GROUP BY 1), e AS (SELECT unnest(range((SELECT min(y) FROM s), (SELECT max(y) FROM s) + 1)) AS y), j AS (SELECT e.y, coalesce(n, 0) AS n FROM e LEFT JOIN s USING (y)) "
    "SELECT y::INT AS year, n, n = 0 AND greatest(coalesce(lag(n) OVER (ORDER BY y), 0), coalesce(lead(n) OVER (ORDER BY y), 0)) > 0 AS missing, n < avg(n) OVER () * 0.5 AS thin FROM j"
)
def year_coverage(spark, d):
    return quality.year_coverage(table(spark, d, "orders").where(F.year("o_orderdate") != 1997), "o_orderdate")


@query(
    "SELECT count(*) AS rows, count(*) FILTER (trim(c_name) = '') AS empty_name, 0::BIGINT AS bad_day, count(*) FILTER (lower(trim(c_mktsegment)) NOT IN ('building', 'machinery')) AS unknown_segment, "
    "count(*) FILTER (lower(trim(c_mktsegment)) IN ('building', 'machinery') AND c_mktsegment NOT IN ('building', 'MACHINERY')) AS case_segment, 0::BIGINT AS marks, 0::BIGINT AS tabs, (count(*) - count(DISTINCT c_nationkey))::BIGINT AS repeats, false AS valid FROM customer"
)
def quality_report(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("2020-01-01").alias("day"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    return quality.validation_report(c, ["name"], [F.col("c_nationkey")], ["day"], {"segment": ["building", "MACHINERY"]}, ["name"])


@query("SELECT 'document' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_audit(spark, d):
    one = quality.orphans(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "doc_id").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    two = quality.orphans(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return one.unionAll(two)


@query(
    "WITH h AS (SELECT user_id AS t, list_distinct(list(event_type)) AS e FROM events GROUP BY 1) SELECT c_custkey AS track_id, array_to_string([x FOR x IN ['view', 'click', 'signup'] IF NOT list_contains(coalesce(e, []), x)], ',') AS missing FROM customer LEFT JOIN h ON t = c_custkey WHERE len([x FOR x IN ['view', 'click', 'signup'] IF NOT list_contains(coalesce(e, []), x)]) > 0"
)
def missing_worklist(spark, d):
    seen = table(spark, d, "events").select(F.col("user_id").alias("track_id"), F.col("event_type").alias("field"))
    return quality.missing_worklist(table(spark, d, "customer").select(F.col("c_custkey").alias("track_id")), seen, ["view", "click", "signup"])


@query("SELECT 'orphans' AS \"check\", count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'unknown fields', count(*) FROM events WHERE event_type NOT IN ('view', 'click') UNION ALL SELECT 'empty view', count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey IN (SELECT user_id FROM events WHERE event_type = 'view') UNION ALL SELECT 'empty click', 0")
def integrity(spark, d):
    tracks = table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.when(F.col("c_custkey") % 2 == 1, 1).alias("a"), F.lit(1).alias("b"))
    return quality.integrity(tracks, table(spark, d, "events").select(F.col("user_id").alias("track_id"), F.col("event_type").alias("field")), {"view": "a", "click": "b"})


@query("WITH l AS (SELECT max(o_orderdate)::DATE AS a FROM orders) SELECT unnest(generate_series(a::TIMESTAMP, DATE '2002-01-15'::TIMESTAMP, INTERVAL 30 DAY))::DATE AS start, least((unnest(generate_series(a::TIMESTAMP, DATE '2002-01-15'::TIMESTAMP, INTERVAL 30 DAY)) + INTERVAL 30 DAY)::DATE, DATE '2002-01-15') AS \"end\" FROM l")
def refresh_windows(spark, d):
    return quality.refresh_windows(table(spark, d, "orders"), "o_orderdate", F.lit("2002-01-15").cast("date"))


# ---------------------------------------------------------------- matching


@query(
    "WITH t AS (SELECT p_partkey AS track_id, upper(p_brand) AS a, upper(p_name) AS t FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_partkey AS cert_id, upper(p_brand) || CASE WHEN p_partkey % 3 = 0 THEN ' X' ELSE '' END AS ca, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) || ' DELUXE' WHEN p_partkey % 7 = 0 THEN left(upper(p_name), 9) ELSE upper(p_name) END AS ct FROM part WHERE p_partkey % 2 = 1), "
    "h AS (SELECT track_id, cert_id, 'contains' AS strategy FROM t JOIN c ON contains(ca, a) AND contains(ct, t)) "
    "SELECT * FROM h UNION ALL SELECT track_id, cert_id, 'prefix' FROM t JOIN c ON ca = a AND length(ct) >= 8 AND length(ct) < length(t) AND starts_with(t, ct) WHERE length(t) >= 8 AND track_id NOT IN (SELECT track_id FROM h)"
)
def certification_match(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    tracks = p.where(k % 2 == 0).select(k.alias("track_id"), F.upper("p_brand").alias("artist"), F.upper("p_name").alias("title"))
    name = F.upper("p_name")
    certs = p.where(k % 2 == 1).select(k.alias("cert_id"), F.concat(F.upper("p_brand"), F.when(k % 3 == 0, " X").otherwise("")).alias("artist_clean"), F.when(k % 5 == 0, F.concat(name, F.lit(" DELUXE"))).when(k % 7 == 0, F.left(name, F.lit(9))).otherwise(name).alias("title_clean"))
    return match.certification_match(tracks, certs)


@query(
    "WITH a AS (SELECT p_partkey AS album_id, upper(p_brand) AS a, upper(p_name) AS t FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_partkey AS cert_id, upper(p_brand) AS ca, upper(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' II' ELSE '' END AS ct FROM part WHERE p_partkey % 2 = 1), "
    "e AS (SELECT album_id, cert_id FROM a JOIN c ON a = ca AND t = ct) SELECT * FROM e UNION ALL SELECT album_id, cert_id FROM a JOIN c ON contains(ca, a) AND contains(ct, t) WHERE album_id NOT IN (SELECT album_id FROM e)"
)
def album_certification_match(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    albums = p.where(k % 2 == 0).select(k.alias("album_id"), F.upper("p_brand").alias("artist"), F.upper("p_name").alias("title"))
    certs = p.where(k % 2 == 1).select(k.alias("cert_id"), F.upper("p_brand").alias("artist_clean"), F.concat(F.upper("p_name"), F.when(k % 3 == 0, " II").otherwise("")).alias("title_clean"), F.lit("album").alias("cat"))
    return match.album_certification_match(albums, certs)


@query("WITH t AS (SELECT p_brand AS b, lower(p_name) AS n, min(p_partkey) AS track_id FROM part GROUP BY 1, 2 HAVING count(*) = 1) SELECT p_partkey AS entry_id, track_id FROM part JOIN t ON p_brand = b AND lower(p_name) = n")
def unique_title_match(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_brand").alias("artist_id"), F.lower("p_name").alias("title_key"))
    return match.unique_title_match(rows.withColumnRenamed("track_id", "entry_id"), rows)


_CODED = "p_name || ' ' || translate((p_partkey * 7919 % 9973)::VARCHAR, '0123456789', 'bcdfghjklm')"


def _coded() -> Column:
    """A part's name with five letters that differ by its key."""
    code = F.translate((F.col("p_partkey") * 7919 % 9973).cast("string"), "0123456789", "bcdfghjklm")
    return F.concat("p_name", F.lit(" "), code)


@query(
    "WITH RECURSIVE p AS (SELECT p_partkey AS k, p_brand AS a, " + _CODED + " AS t, p_type FROM part), "
    "tr AS (SELECT k, a, CASE WHEN k % 10 = 0 THEN k END AS x, CASE WHEN k % 12 = 4 THEN split_part(t, ' ', 1) ELSE t END AS t, lower(p_type) AS n FROM p WHERE k % 2 = 0), "
    "en AS (SELECT k, a, CASE WHEN k % 10 = 1 THEN k - 1 END AS x, CASE k % 8 WHEN 0 THEN t WHEN 2 THEN left(t, k % 5 + 3) || substr(t, k % 5 + 5) WHEN 4 THEN 'the ' || t WHEN 6 THEN left(t, 9) WHEN 1 THEN split_part(t, ' ', 1) ELSE t END AS t, lower(p_type) AS n FROM p), "
    "mem AS (SELECT en.a, en.t, en.k // 2 * 2 AS k, en.k % 16 <> 3 AS ok FROM en WHERE en.k % 4 = 3), "
    "i AS (SELECT en.k AS e, min(tr.k) AS t FROM en JOIN tr USING (a, x) GROUP BY 1), "
    "s AS (SELECT en.k AS e, tr.k AS t, count(*) OVER (PARTITION BY en.k) AS n, contains(en.n, tr.n) OR contains(tr.n, en.n) AS c FROM en JOIN tr USING (a, t) WHERE en.k NOT IN (SELECT e FROM i)), "
    "c AS (SELECT e, t FROM (SELECT *, count(*) OVER (PARTITION BY e) AS m FROM s WHERE n > 1 AND c) WHERE m = 1), "
    "l AS (SELECT * FROM en WHERE k NOT IN (SELECT e FROM i) AND k NOT IN (SELECT e FROM s)), "
    "pairs AS (SELECT DISTINCT l.t AS a, tr.t AS b FROM l JOIN tr USING (a)), " + similar.ratio_sql("pairs") + ", "
    "r AS (SELECT l.k AS e, l.a, l.t AS lt, tr.k AS t, ratio, row_number() OVER w AS place, lead(ratio) OVER w AS nxt, count(*) FILTER (ratio >= 0.87) OVER (PARTITION BY l.k) AS sure FROM l JOIN tr ON l.a = tr.a JOIN alike ON alike.a = l.t AND alike.b = tr.t WINDOW w AS (PARTITION BY l.k ORDER BY ratio DESC, tr.k)), "
    "f AS (SELECT e, t, ratio FROM r WHERE place = 1 AND sure = 1), "
    "m AS (SELECT en.k AS e, mem.k AS t FROM en JOIN mem USING (a, t) WHERE ok AND EXISTS (SELECT 1 FROM tr WHERE tr.k = mem.k AND tr.a = en.a) AND en.k NOT IN (SELECT e FROM i) AND en.k NOT IN (SELECT e FROM s WHERE n = 1) AND en.k NOT IN (SELECT e FROM c) AND en.k NOT IN (SELECT e FROM f)) "
    "SELECT e AS entry_id, t AS track_id, 'id' AS stage, 1.0::DOUBLE AS score FROM i UNION ALL SELECT e, t, 'title', 1.0::DOUBLE FROM s WHERE n = 1 UNION ALL SELECT e, t, 'credited', 1.0::DOUBLE FROM c UNION ALL SELECT e, t, 'fuzzy', ratio FROM f "
    "UNION ALL SELECT e, t, 'remembered', 1.0::DOUBLE FROM m UNION ALL SELECT e, t, 'suggested', ratio FROM r WHERE place = 1 AND ratio >= 0.55 AND ratio < 0.87 AND (nxt IS NULL OR ratio - nxt >= 0.08::DOUBLE) AND NOT EXISTS (SELECT 1 FROM mem WHERE mem.a = r.a AND mem.t = r.lt)"
)
def staged_match(spark, d):
    """All stages: entries are the tracks' titles whole, with a letter lost, with a word more, cut, or of no track."""
    p, k, title = table(spark, d, "part"), F.col("p_partkey"), _coded()
    first, kind = F.substring_index(title, " ", 1), F.lower("p_type")
    tracks = p.where(k % 2 == 0).select(k.alias("track_id"), F.col("p_brand").alias("artist_id"), F.when(k % 10 == 0, k).cast("string").alias("external_id"), F.when(k % 12 == 4, first).otherwise(title).alias("title_key"), kind.alias("primary_key"))
    lost = F.concat(F.left(title, k % 5 + 3), F.substring(title, k % 5 + 5, F.lit(99)))
    heard = F.when(k % 8 == 2, lost).when(k % 8 == 4, F.concat(F.lit("the "), title)).when(k % 8 == 6, F.left(title, F.lit(9))).when(k % 8 == 1, first).otherwise(title)
    entries = p.select(k.alias("entry_id"), F.col("p_brand").alias("artist_id"), F.when(k % 10 == 1, k - 1).cast("string").alias("external_id"), heard.alias("title_key"), F.array(kind).alias("credited"))
    e = F.col("entry_id")
    memory = entries.where(e % 4 == 3).select("artist_id", F.col("title_key").alias("entry_title_key"), (e - e % 2).alias("track_id"), (e % 16 != 3).alias("accepted"))
    return match.staged_match(entries, tracks, memory)


@query(
    "WITH i AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN p_partkey - 1 END AS g, lower(p_name) AS t, lower(p_brand) AS a FROM part WHERE p_partkey % 2 = 1), k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 8 = 0 THEN p_partkey END AS g, lower(p_name) AS t, lower(p_brand) AS a, p_size AS c FROM part WHERE p_partkey % 2 = 0), "
    "o AS (SELECT i.id, min(k.id) AS m FROM i JOIN k ON i.g = k.g GROUP BY 1), w AS (SELECT i.id, arg_max(k.id, k.c * 10000000 - k.id) AS m FROM i JOIN k ON i.t = k.t AND i.a = k.a WHERE i.id NOT IN (SELECT id FROM o) GROUP BY 1), "
    "h AS (SELECT i.id, arg_max(k.id, k.c * 10000000 - k.id) AS m FROM i JOIN k ON i.t = k.t WHERE i.id NOT IN (SELECT id FROM o) AND i.id NOT IN (SELECT id FROM w) GROUP BY 1) "
    "SELECT id AS incoming_id, m AS track_id, 'id' AS level FROM o UNION ALL SELECT id, m, 'title and album' FROM w UNION ALL SELECT id, m, 'title' FROM h"
)
def import_match(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    incoming = p.where(k % 2 == 1).select(k.alias("incoming_id"), F.when(k % 4 == 1, k - 1).alias("genius_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("album"))
    known = p.where(k % 2 == 0).select(k.alias("track_id"), F.when(k % 8 == 0, k).alias("genius_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("album"), F.lit(1).alias("bpm"), F.lit(True).alias("has_lyrics"), F.col("p_size").alias("credits"))
    return match.import_match(incoming, known)


@query(
    "WITH RECURSIVE p AS (SELECT DISTINCT p_brand AS brand, " + _CODED + " AS t FROM part), x AS (SELECT m.brand, m.t AS a, o.t AS b FROM p m JOIN p o ON m.brand = o.brand AND m.t < o.t), "
    + similar.ratio_sql("x")
    + "SELECT brand, one, other, round(ratio, 4) AS ratio, n FROM (SELECT brand, x.a AS one, x.b AS other, ratio, (row_number() OVER (PARTITION BY brand ORDER BY ratio DESC, x.a, x.b))::INT AS n FROM x JOIN alike ON x.a = alike.a AND x.b = alike.b) WHERE n <= 3"
)
def fuzzy_ratio_topk(spark, d):
    """The three most similar pairs of titles of each brand."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), _coded().alias("text"))
    return similar.closest(p, ["brand"], keep=3).select("brand", F.col("text").alias("one"), F.col("right_id").alias("other"), F.round("score", 4).alias("ratio"), "n")


@query("SELECT p_brand AS isrc, arg_max(p_partkey, p_size * 10000000 - p_partkey) AS recording_id FROM part GROUP BY 1")
def most_popular(spark, d):
    r = table(spark, d, "part").select(F.col("p_brand").alias("isrc"), F.col("p_partkey").alias("recording_id"), F.col("p_size").alias("popularity"), F.col("p_partkey").alias("position"))
    return match.most_popular(r)


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN lower(p_name) = 'large' THEN 0 WHEN starts_with(lower(p_name), 'large') THEN 1 WHEN contains(lower(p_name), 'large') THEN 2 ELSE 3 END AS rank FROM part")
def candidate_order(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), match.candidate_order(F.col("p_name"), F.lit("Large")).alias("rank"))


# ---------------------------------------------------------------- scalars


@query(
    "WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 3 <> 0 AND l_suppkey > 0 THEN l_suppkey END AS sp, CASE WHEN l_linenumber % 3 <> 1 AND l_partkey > 0 THEN l_partkey END AS yt FROM lineitem) "
    "SELECT id, trunc(CASE WHEN sp IS NOT NULL AND yt IS NOT NULL THEN (sp + yt) / (0.4::DOUBLE + 0.25::DOUBLE) WHEN sp IS NOT NULL THEN sp / 0.4::DOUBLE ELSE yt / 0.25::DOUBLE END)::BIGINT AS estimate, CASE WHEN sp IS NOT NULL AND yt IS NULL THEN ' ~Sp' WHEN yt IS NOT NULL AND sp IS NULL THEN ' ~YT' ELSE '' END AS label FROM e"
)
def stream_estimate(spark, d):
    n = F.col("l_linenumber") % 3
    sp, yt = F.when(n != 0, F.col("l_suppkey")), F.when(n != 1, F.col("l_partkey"))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), catalog.total_estimate(sp, yt).alias("estimate"), catalog.estimate_label(sp, yt).alias("label"))


@query(
    "SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 10.0 WHEN 1 THEN 6.0 WHEN 2 THEN 7 - least(p_size - 1, 9) * 0.1 WHEN 3 THEN 4.0 WHEN 4 THEN 99.0 ELSE 10 - least(p_size - 1, 9) * 0.1 END::DOUBLE AS rank FROM part"
)
def level_ranks(spark, d):
    s = F.col("p_size")
    level = F.when(s % 6 == 0, "Or").when(s % 6 == 1, "Double Platine").when(s % 6 == 2, F.concat(s, F.lit("x Platinum"))).when(s % 6 == 3, "diamond").when(s % 6 == 4, "?").otherwise(F.concat(s, F.lit("x Gold")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), catalog.level_rank(level).alias("rank"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, nullif(regexp_extract('https://x.example/watch?v=' || lpad(page_id::VARCHAR, 11, 'a') || '&t=1', '(?:v=|youtu\\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})', 1), '') AS video FROM pages")
def url_extract(spark, d):
    made = F.concat(F.lit("https://x.example/watch?v="), F.lpad(F.col("page_id").cast("string"), 11, "a"), F.lit("&t=1"))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), parse.video_id(made).alias("video"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS n FROM events")
def json_arrays(spark, d):
    made = F.when(F.col("event_id") % 4 == 0, "{broken").otherwise(F.concat(F.lit('[{"certification": "Or", "certification_date": "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}]')))
    return table(spark, d, "events").select("event_id", F.size(json_source.array_of(made, json_source.CERTIFICATIONS)).alias("n"))


@query("SELECT p_partkey AS id, p_name AS title, upper(p_name) AS certified, p_name AS identity FROM part")
def ascii_keys(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.normalize_title(F.concat(n, F.lit(" (feat. Someone)"))).alias("title"), text.normalize_certified(F.concat(F.lit("  "), n, F.lit("!"))).alias("certified"), text.identity_key(F.concat(n, F.lit(" (Producer)"))).alias("identity"))


@query()
def document_keys(spark, d):
    whole_text_batches(spark)
    return table(spark, d, "documents").select("doc_id", text.normalize_title(F.col("text")).alias("title"), text.normalize_certified(F.col("text")).alias("certified"), text.identity_key(F.col("text")).alias("identity"))


@query(
    "WITH t AS (SELECT p_partkey AS id, lower(p_name || CASE p_partkey % 7 WHEN 0 THEN ' Remix' WHEN 1 THEN ' (Live)' WHEN 2 THEN ' Acoustic' WHEN 3 THEN ' Demo' WHEN 4 THEN ' freestyle' ELSE '' END) AS t, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS a, CASE WHEN p_partkey % 11 = 0 THEN 1980 ELSE 2000 END AS y FROM part) "
    "SELECT id, CASE WHEN contains(t, 'freestyle') THEN 'exotic' WHEN regexp_matches(t, 'remix|rmx|rework|edit|bootleg|vip|flip|refix|version|mix') THEN 'remix' WHEN regexp_matches(t, 'live|concert|tour|session|unplugged|acoustic|stripped|intimate') THEN CASE WHEN contains(t, 'acoustic') THEN 'acoustic' ELSE 'live' END "
    "WHEN regexp_matches(t, 'unreleased|leaked|demo|snippet|instrumental|acapella|radio rip|exclusive|rare|vault|outtake|alternate') OR y < 1990 THEN 'exotic' WHEN a IS NULL THEN 'single' ELSE 'album' END AS kind FROM t"
)
def track_kinds(spark, d):
    k = F.col("p_partkey")
    mark = F.when(k % 7 == 0, " Remix").when(k % 7 == 1, " (Live)").when(k % 7 == 2, " Acoustic").when(k % 7 == 3, " Demo").when(k % 7 == 4, " freestyle").otherwise("")
    return table(spark, d, "part").select(k.alias("id"), catalog.track_kind(F.concat("p_name", mark), F.when(k % 2 == 0, F.col("p_brand")), F.when(k % 11 == 0, 1980).otherwise(2000)).alias("kind"))


@query("SELECT p_partkey AS id, ['Do', 'Do#/Réb', 'Ré', 'Ré#/Mib', 'Mi', 'Fa', 'Fa#/Solb', 'Sol', 'Sol#/Lab', 'La', 'La#/Sib', 'Si'][p_size % 12 + 1] || CASE p_size % 2 WHEN 1 THEN ' majeur' ELSE ' mineur' END AS key FROM part")
def musical_keys(spark, d):
    names = F.array(*(F.lit(n) for n in ("C", "D♭", "Ré", "E♭", "Mi", "F", "G♭", "Sol", "Sol#", "A", "Bb", "Si")))
    made = F.concat(F.get(names, F.col("p_size") % 12), F.when(F.col("p_size") % 2 == 1, " major").otherwise(" mineur"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), catalog.normalize_key(made).alias("key"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS us, strftime(o_orderdate, '%Y-%m-%d') AS day_first, strftime(o_orderdate, '%Y-%m-%d') AS flexible FROM orders")
def dates(spark, d):
    o = F.col("o_orderdate")
    us = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(o, "MMMM d, yyyy")).otherwise(F.date_format(o, "M/d/yyyy"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parse.iso_date(us).alias("us"), parse.day_first_date(F.date_format(o, "dd/MM/yyyy")).alias("day_first"), F.date_format(parse.flexible_date(F.concat(F.date_format(o, "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 3 == 0, "T00:00:00Z").otherwise(""))), "yyyy-MM-dd").alias("flexible"))


@query("SELECT p_partkey AS id, p_partkey AS seconds, p_partkey * 1000 AS views FROM part")
def durations_and_counts(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), parse.duration_seconds(F.when(k % 2 == 0, k.cast("string")).otherwise(parse.format_seconds(k))).alias("seconds"), parse.counted(F.concat(k.cast("string"), F.lit(" k"))).alias("views"))


@query()
def timed_lyrics(spark, d):
    t = F.col("l_linenumber") * 4 + F.col("l_orderkey") % 3
    line = F.concat(F.format_string("[%02d:%02d.00] ", F.floor(t / 60), t % 60), F.lit("line "), F.col("l_linenumber"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("track_id")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lrclib"), F.array_join(F.sort_array(F.collect_list(F.regexp_replace(line, ":0", ":1"))), "\n").alias("ytmusic"))
    return resolve.cross_check(rows.withColumn("duration", F.lit(30.0))).select("track_id", "source", "confidence")


@query()
def page_outline(spark, d):
    return page_source.page_text(table(spark, d, "pages")).withColumnRenamed("id", "page_id")
