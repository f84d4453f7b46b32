"""Queries of the reconciliation core and of list, audit and listing operators, and SQL for folds over ordered candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crategraph.functions import parse
from crategraph.operators import accumulate, match, resolve, rollup, similar
from crategraph.plans.catalog_queries import _OBS, ORACLE_SQL, _observations, query
from crategraph.shared import table


def vote_sql(track: str) -> str:
    """CTE ``vote`` (track_id, bpm, bpm_alt, source, confidence): candidates in order of arrival join the first cluster in
    which one agrees with them; a cluster list grows by one candidate a step."""
    agree = "abs(m.v - c.v) <= 3 OR abs(m.v - 2 * c.v) <= 3 OR abs(2 * m.v - c.v) <= 3"
    return _OBS.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, cand AS (
  SELECT track_id, obs_id, source, rank, v, row_number() OVER (PARTITION BY track_id ORDER BY obs_id) AS k
  FROM (SELECT {track} AS track_id, obs_id, source, rank, round_even(value::DOUBLE, 0)::INT AS v FROM r WHERE field = 'bpm' AND source <> 'legacy')
  WHERE v BETWEEN 40 AND 220),
fold(track_id, k, held) AS (
  SELECT track_id, k, [{{c: 1::BIGINT, o: obs_id, s: source, v: v, r: rank}}] FROM cand WHERE k = 1
  UNION ALL
  SELECT c.track_id, c.k, list_append(held, {{c: coalesce(list_min([m.c FOR m IN held IF {agree}]), list_max([m.c FOR m IN held]) + 1), o: c.obs_id, s: c.source, v: c.v, r: c.rank}})
  FROM fold JOIN cand c ON c.track_id = fold.track_id AND c.k = fold.k + 1),
item AS (SELECT track_id, unnest(held) AS m FROM (SELECT track_id, arg_max(held, k) AS held FROM fold GROUP BY track_id)),
best AS (
  SELECT track_id, c, n FROM (
    SELECT track_id, m.c AS c, count(*) AS n, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, max(m.r) DESC, m.c) AS place FROM item GROUP BY 1, 2) WHERE place = 1),
won AS (SELECT i.track_id, n, m.v AS v, m.s AS s, m.r AS r, m.r::BIGINT * 1000000000000 - m.o AS merit, min(m.v) OVER (PARTITION BY i.track_id) AS lo, max(m.v) OVER (PARTITION BY i.track_id) AS hi FROM item i JOIN best b ON i.track_id = b.track_id AND m.c = b.c),
said AS (SELECT track_id, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, arg_max(v, merit) AS v, arg_max(v, merit) FILTER (v >= lo * 1.5) AS top FROM won GROUP BY 1),
named AS (SELECT track_id, string_agg(s, '+' ORDER BY r DESC, s) AS source FROM (SELECT DISTINCT track_id, s, r FROM won) GROUP BY 1),
vote AS (
  SELECT track_id, CASE WHEN hi >= lo * 1.5 THEN top WHEN n < 2 AND v < 90 THEN v * 2 ELSE v END AS bpm,
         CASE WHEN hi >= lo * 1.5 THEN lo WHEN n < 2 AND v < 90 THEN v WHEN v < 90 THEN v * 2 WHEN v // 2 >= 55 THEN v // 2 END AS bpm_alt,
         source, n::INT AS confidence
  FROM said JOIN named USING (track_id))
"""


_SPREAD = "track_id * 1000 + (obs_id // 4) % 1000"

#: SQL of queries that are registered elsewhere.
ORACLE_SQL["tempo_vote"] = vote_sql(_SPREAD) + "SELECT * FROM vote"

ORACLE_SQL["whole_track_reconcile"] = vote_sql("track_id") + """
, old AS (SELECT track_id, arg_min({v: CASE WHEN round_even(value::DOUBLE, 0) BETWEEN 40 AND 220 THEN round_even(value::DOUBLE, 0)::INT END, c: confidence}, obs_id) AS x FROM r WHERE field = 'bpm' AND source = 'legacy' AND track_id NOT IN (SELECT track_id FROM r WHERE field = 'bpm' AND source <> 'legacy') GROUP BY 1),
kept AS (SELECT * FROM (SELECT *, max((source <> 'legacy')::INT) OVER (PARTITION BY track_id, field) AS real FROM r WHERE field <> 'bpm') WHERE source <> 'legacy' OR real = 0),
pair AS (SELECT track_id, source, arg_max({v: value, c: confidence}, obs_id) FILTER (field = 'key') AS k, arg_max({v: value, c: confidence}, obs_id) FILTER (field = 'mode') AS m, max(rank) AS rank FROM kept WHERE field IN ('key', 'mode') GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY k.c DESC NULLS LAST, rank DESC, source) AS place FROM pair WHERE k IS NOT NULL AND m IS NOT NULL),
rest AS (SELECT *, row_number() OVER (PARTITION BY track_id, field ORDER BY confidence DESC NULLS LAST, rank DESC, obs_id) AS place FROM kept WHERE field NOT IN ('key', 'mode'))
SELECT track_id, 'bpm' AS field, bpm::VARCHAR AS value, source, confidence::DOUBLE AS confidence, bpm_alt::VARCHAR AS alt FROM vote
UNION ALL SELECT track_id, 'bpm', x.v::VARCHAR, 'legacy', x.c, NULL FROM old WHERE x.v IS NOT NULL
UNION ALL SELECT track_id, 'key', k.v, source, k.c, NULL FROM p WHERE place = 1
UNION ALL SELECT track_id, 'mode', m.v, source, m.c, NULL FROM p WHERE place = 1
UNION ALL SELECT track_id, field, value, source, confidence, NULL FROM rest WHERE place = 1
"""

ORACLE_SQL["timed_lyrics"] = """
WITH l AS (SELECT l_orderkey AS track_id, l_linenumber * 4 + l_orderkey % 3 AS a FROM lineitem),
x AS (SELECT track_id, a, CASE WHEN a < 10 THEN a + 10 ELSE a END AS b FROM l),
g AS (SELECT track_id, count(*) AS n, list(a - b ORDER BY a - b) AS offs, max(a) - 30 AS one, max(b) - 30 AS two FROM x GROUP BY 1),
m AS (SELECT *, CASE WHEN n >= 3 THEN offs[(n // 2 + 1)::INT] END AS mid FROM g),
s AS (SELECT m.track_id, any_value(mid) AS mid, sum(abs(a - b - mid)) / any_value(n) AS spread, any_value(CASE WHEN one > 0 THEN 2 * one ELSE -one END) AS one, any_value(CASE WHEN two > 0 THEN 2 * two ELSE -two END) AS two FROM m JOIN x USING (track_id) GROUP BY 1),
v AS (SELECT *, coalesce(abs(mid) <= 2 AND spread <= 1.5, false) AS agree FROM s)
SELECT track_id, CASE WHEN NOT agree AND two < one THEN 'YouTube Music' ELSE 'LRCLIB' END AS source, CASE WHEN agree THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM v
"""


@query(vote_sql(_SPREAD) + "SELECT track_id, confidence >= 2 AS reached FROM vote")
def tempo_consensus(spark, d):
    obs = _observations(spark, d).where("field = 'bpm' AND source <> 'legacy'")
    return resolve.consensus(obs.withColumn("track_id", F.col("track_id") * 1000 + F.floor(F.col("obs_id") / 4) % 1000))


@query(
    "WITH p AS (SELECT p_partkey AS k, p_brand AS a, p_type || ' ' || p_size AS t, lower(p_name) AS n FROM part), "
    "i AS (SELECT e.k AS entry_id, min(s.k) AS track_id FROM p e JOIN p s ON e.k // 10 = s.k // 10 AND e.a = s.a WHERE e.k % 20 < 4 AND s.k % 10 < 3 GROUP BY 1), "
    "s AS (SELECT e.k AS entry_id, x.k AS track_id, e.n AS en, x.n AS xn, count(*) OVER (PARTITION BY e.k) AS n FROM p e JOIN p x ON e.a = x.a AND e.t = x.t WHERE e.k NOT IN (SELECT entry_id FROM i)), "
    "c AS (SELECT *, count(*) OVER (PARTITION BY entry_id) AS m FROM s WHERE n > 1 AND (contains(en, xn) OR contains(xn, en))) "
    "SELECT entry_id, track_id, 'id' AS stage, 1.0::DOUBLE AS score FROM i UNION ALL SELECT entry_id, track_id, 'title', 1.0::DOUBLE FROM s WHERE n = 1 UNION ALL SELECT entry_id, track_id, 'credited', 1.0::DOUBLE FROM c WHERE m = 1"
)
def staged_match_exact(spark, d):
    """Every entry's title is one of its artist's tracks, so the fuzzy stages have nothing left."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    title, name, tens = F.concat("p_type", F.lit(" "), "p_size"), F.lower("p_name"), F.floor(k / 10).cast("string")
    tracks = p.select(k.alias("track_id"), F.col("p_brand").alias("artist_id"), F.when(k % 10 < 3, tens).alias("external_id"), title.alias("title_key"), name.alias("primary_key"))
    entries = p.select(k.alias("entry_id"), F.col("p_brand").alias("artist_id"), F.when(k % 20 < 4, tens).alias("external_id"), title.alias("title_key"), F.array(name).alias("credited"))
    return match.staged_match(entries, tracks)


_RESOLVED = (
    "WITH v AS (SELECT o_custkey AS t, CASE o_orderkey % 4 WHEN 0 THEN 'bpm' WHEN 1 THEN 'key' WHEN 2 THEN 'mode' ELSE 'duration' END AS field, (o_orderkey % 12)::VARCHAR AS value, (o_orderkey % 7)::VARCHAR AS alt FROM orders), "
    "w AS (SELECT t, max(value) FILTER (field = 'bpm')::INT AS b, max(value) FILTER (field = 'key')::INT AS k, max(value) FILTER (field = 'mode')::INT AS m, max(alt) FILTER (field = 'bpm')::INT AS a FROM v GROUP BY t) "
)


@query(_RESOLVED + "SELECT c_custkey AS track_id, coalesce(b, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END) AS bpm, a AS bpm_alt, coalesce(k, c_nationkey % 12) AS key, m AS mode FROM customer LEFT JOIN w ON t = c_custkey")
def applied_resolutions(spark, d):
    k = F.col("o_orderkey")
    field = F.when(k % 4 == 0, "bpm").when(k % 4 == 1, "key").when(k % 4 == 2, "mode").otherwise("duration")
    resolved = table(spark, d, "orders").select(F.col("o_custkey").alias("track_id"), field.alias("field"), (k % 12).cast("string").alias("value"), (k % 7).cast("string").alias("alt"))
    c = F.col("c_custkey")
    tracks = table(spark, d, "customer").select(c.alias("track_id"), F.when(c % 3 == 0, F.col("c_nationkey")).alias("bpm"), (F.col("c_nationkey") % 12).alias("key"))
    return resolve.apply_to_tracks(tracks, resolved).select("track_id", "bpm", "bpm_alt", "key", "mode")


@query(
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN contains(lower(p_name), 'ring') ELSE false END AS same FROM part"
)
def same_names(spark, d):
    k, name = F.col("p_partkey"), F.lower("p_name")
    # names of parts share too few letters with brands to be alike
    other = F.when(k % 3 == 0, F.substring_index(name, " ", 1)).when(k % 3 == 1, "ring").otherwise(F.lower("p_brand"))
    return table(spark, d, "part").select("p_partkey", match.names_match(name, other).alias("same"))


_AMERICAN = (
    "WITH c AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_custkey % 3 = 0 THEN 'Artist ' || (o_custkey % 40) ELSE 'ARTIST ' || (o_custkey % 40) END AS artist, 'Title ' || (o_custkey % 7) AS title, "
    "CASE o_orderkey % 3 WHEN 0 THEN 'Gold' WHEN 1 THEN 'Platinum' ELSE 'Diamond' END AS level, strftime(o_orderdate, '%Y-%m-01') AS day, CASE o_orderkey % 5 WHEN 0 THEN 'SINGLES' WHEN 1 THEN 'single' WHEN 2 THEN 'Album' WHEN 3 THEN 'Video' END AS form FROM orders), "
    "f AS (SELECT *, CASE upper(form) WHEN 'SINGLES' THEN 'Single' WHEN 'SINGLE' THEN 'Single' WHEN 'ALBUM' THEN 'Album' ELSE coalesce(form, '') END AS named FROM c WHERE trim(artist) <> '') "
)


@query(_AMERICAN + "SELECT pos, artist AS \"Artist\", title AS \"Title\", level AS \"Certification_Type\", day AS \"Certification_Date\", named AS \"Format_Type\" FROM (SELECT *, row_number() OVER (PARTITION BY upper(artist), title, upper(named), level, day ORDER BY pos) AS n FROM f) WHERE n = 1")
def clean_american(spark, d):
    k, a = F.col("o_orderkey"), F.col("o_custkey") % 40
    artist = F.when(k % 11 == 0, " ").when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Artist "), a)).otherwise(F.concat(F.lit("ARTIST "), a))
    level = F.when(k % 3 == 0, "Gold").when(k % 3 == 1, "Platinum").otherwise("Diamond")
    form = F.when(k % 5 == 0, "SINGLES").when(k % 5 == 1, "single").when(k % 5 == 2, "Album").when(k % 5 == 3, "Video")
    rows = table(spark, d, "orders").select(k.alias("pos"), artist.alias("Artist"), F.concat(F.lit("Title "), F.col("o_custkey") % 7).alias("Title"), level.alias("Certification_Type"), F.date_format("o_orderdate", "yyyy-MM-01").alias("Certification_Date"), form.alias("Format_Type"))
    return accumulate.clean_american(rows)


@query(
    "WITH RECURSIVE p AS (SELECT p_partkey AS k, replace(upper(p_brand), '#', '') AS a, upper(p_name) AS t, p_size FROM part), "
    "c AS (SELECT k, a || CASE WHEN k % 2 = 0 THEN ' AND BRAND1' ELSE '' END AS artist_clean, CASE k % 4 WHEN 0 THEN t || ' REMIX' WHEN 1 THEN 'NEW ' || split_part(t, ' ', 1) ELSE t END AS t, CASE WHEN k % 5 = 0 THEN 'album' ELSE 'track' END AS kind FROM p WHERE k % 3 = 0), "
    "s AS (SELECT DISTINCT a AS artist FROM p), l AS (SELECT DISTINCT a, CASE WHEN p_size < 25 THEN 'album' ELSE 'track' END AS kind, t FROM p WHERE k % 3 <> 0), "
    "j AS (SELECT artist, c.k, c.t, CASE WHEN kind = 'album' AND artist IN (SELECT a FROM l WHERE kind = 'album') THEN 'album' ELSE 'track' END AS place, kind FROM s JOIN c ON contains(' ' || artist_clean || ' ', ' ' || artist || ' ')), "
    "o AS (SELECT artist AS artist_id, k AS cert_id, j.t AS title_clean, any_value(j.kind) AS kind, any_value(place) AS place, coalesce(bool_or(j.t = l.t OR (length(j.t) >= 8 AND starts_with(l.t, j.t)) OR contains(l.t, j.t) OR contains(j.t, l.t)), false) AS matched "
    "FROM j LEFT JOIN l ON l.a = artist AND l.kind = place GROUP BY 1, 2, 3), "
    "pairs AS (SELECT DISTINCT title_clean AS a, l.t AS b FROM o JOIN l ON l.a = artist_id AND l.kind = place WHERE NOT matched), "
    + similar.ratio_sql("pairs")
    + ", best AS (SELECT artist_id, cert_id, arg_min(b, {r: -ratio, b: b}) AS b, max(ratio) AS r FROM o JOIN l ON l.a = artist_id AND l.kind = place JOIN alike ON alike.a = title_clean AND alike.b = l.t WHERE NOT matched AND ratio > 0 GROUP BY 1, 2) "
    "SELECT artist_id, cert_id, title_clean, kind, matched, best.b AS closest, CASE WHEN NOT matched THEN round(coalesce(best.r, 0), 2) END AS ratio FROM o LEFT JOIN best USING (artist_id, cert_id)"
)
def certification_audit(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    artist, title = F.replace(F.upper("p_brand"), F.lit("#"), F.lit("")), F.upper("p_name")
    name = F.concat(artist, F.when(k % 2 == 0, " AND BRAND1").otherwise(""))
    certified = F.when(k % 4 == 0, F.concat(title, F.lit(" REMIX"))).when(k % 4 == 1, F.concat(F.lit("NEW "), F.substring_index(title, " ", 1))).otherwise(title)
    certs = p.where(k % 3 == 0).select(k.alias("cert_id"), F.lit("SNEP").alias("body"), name.alias("artist_clean"), certified.alias("title_clean"), F.when(k % 5 == 0, "album").otherwise("single").alias("cat"))
    titles = p.where(k % 3 != 0).select(artist.alias("artist_id"), F.when(F.col("p_size") < 25, "album").otherwise("track").alias("kind"), title.alias("title")).distinct()
    artists = p.select(artist.alias("artist_id"), artist.alias("artist")).distinct()
    return match.certification_audit(artists, certs, titles)


@query("SELECT DISTINCT o_orderdate::DATE AS day FROM orders ORDER BY 1 DESC LIMIT 30")
def newest_days(spark, d):
    days = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    return rollup.newest_first(days, "day").limit(30).select(F.to_date("day").alias("day"))


_SUNG = (
    "WITH RECURSIVE l AS (SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n, p_name AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), "
    "w AS (SELECT k, n, lower(t) AS w FROM l), "
    # sung lines: as written, with a letter lost, or others; in order, or backwards for odd tracks
    "u AS (SELECT k, (CASE WHEN k % 4 = 3 THEN 9 - n ELSE n END)::INT AS p, lower(CASE n % 4 WHEN 1 THEN left(t, 4) || substr(t, 6) WHEN 3 THEN 'na na na' ELSE t END) AS u FROM l WHERE k % 5 <> 0), "
    "pairs AS (SELECT DISTINCT w AS a, u AS b FROM w JOIN u USING (k)), "
)


@query(
    _SUNG
    + similar.ratio_sql("pairs")
    + ", m AS (SELECT w.k, w.n, list(p) FILTER (u = w) AS ex, list(p) FILTER (ratio >= 0.82) AS al FROM w JOIN u ON w.k = u.k JOIN alike ON alike.a = w AND alike.b = u GROUP BY 1, 2), "
    "f(k, n, cur, start) AS (SELECT k, 0::BIGINT, 0, NULL::INT FROM orders JOIN (SELECT DISTINCT k FROM w) ON k = o_orderkey UNION ALL "
    "SELECT k, n, coalesce(here + 1, cur), here FROM (SELECT f.k, f.n + 1 AS n, f.cur, coalesce(list_min([p FOR p IN ex IF p >= cur]), list_min([p FOR p IN al IF p >= cur])) AS here FROM f JOIN w ON w.k = f.k AND w.n = f.n + 1 LEFT JOIN m ON m.k = f.k AND m.n = f.n + 1)), "
    "g AS (SELECT *, (SELECT max(p) FROM u WHERE u.k = f.k) AS last FROM f WHERE n > 0), "
    "h AS (SELECT *, coalesce(min(start) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), last) AS until FROM g) "
    "SELECT k AS track_id, string_agg('[Part ' || n || CASE WHEN start IS NULL THEN '' ELSE '  ⏱ ' || (start * 10 // 60) || ':' || lpad((start * 10 % 60)::VARCHAR, 2, '0') || ' → ' || (until * 10 // 60) || ':' || lpad((until * 10 % 60)::VARCHAR, 2, '0') END || ']' || chr(10) || 'oh' || chr(10) || t, chr(10) ORDER BY n) AS annotated "
    "FROM h JOIN l USING (k, n) GROUP BY k"
)
def annotated_sections(spark, d):
    """Lyrics of a section for each line of an order, and timed lines that repeat, blur, drop or reverse them."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("track_id").orderBy("l_linenumber", "l_partkey", "l_quantity")
    lines = lines.select(F.col("l_orderkey").alias("track_id"), F.col("p_name").alias("t"), "l_linenumber", "l_partkey", "l_quantity").withColumn("n", F.row_number().over(order))
    n, k, t = F.col("n"), F.col("track_id"), F.col("t")
    sung = F.when(n % 4 == 1, F.concat(F.left(t, F.lit(4)), F.substring(t, 6, 99))).when(n % 4 == 3, F.lit("na na na")).otherwise(t)
    place = F.when(k % 4 == 3, 9 - n).otherwise(n)
    line = F.when(k % 5 != 0, F.struct(place.alias("p"), F.concat(parse.lrc_line(place * 10_000, F.lit("")), sung).alias("x")))
    made = lines.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat(F.lit("[Part "), n, F.lit("]\noh\n"), t).alias("x")))).alias("a"), F.sort_array(F.collect_list(line)).alias("b"))
    join = lambda c: F.array_join(F.transform(c, lambda e: e["x"]), "\n")
    return resolve.annotate_sections(made.select("track_id", join("a").alias("lyrics"), join("b").alias("lrc")))
