"""Queries that write a list, a page or a version of a table to the shared folder and read it back through the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from crategraph.operators import resolve, rollup
from crategraph.plans.catalog_queries import query
from crategraph.shared import scratch, settle, table
from crategraph.sources import csv, markup, pages, sinks


def _lines(spark, d, header: str, line):
    """A list file: the header and a line for each nation, in order. Lists are files of some MB, one task each."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), line.alias("line"))
    path = scratch(spark, "list")
    rows.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(header))).orderBy("k").select("line").coalesce(1).write.text(path)
    return f"{path}/*.txt"


@query(
    "SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, n_name AS artist, 'Titre ' || n_nationkey AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'House; Sons' ELSE 'House' END AS publisher, 'Singles' AS category, CASE n_nationkey % 2 WHEN 0 THEN 'Or' ELSE 'Platine' END AS level, "
    "CASE WHEN n_nationkey % 4 = 0 THEN 'unknown' ELSE strftime(DATE '2001-02-03' + n_nationkey::INT, '%Y-%m-%d') END AS release_date, '2010-12-31' AS certification_date FROM nation"
)
def french_list_read(spark, d):
    k = F.col("n_nationkey")
    released = F.when(k % 4 == 0, "unknown").otherwise(F.date_format(F.date_add(F.lit("2001-02-03").cast("date"), k.cast("int")), "dd/MM/yyyy"))
    house = F.when(k % 3 == 0, "House; Sons").otherwise("House")
    line = F.concat_ws(";", F.concat(F.lit(" "), "n_name"), F.concat(F.lit("Titre  "), k), house, F.lit("Singles"), F.when(k % 2 == 0, "Or").otherwise("Platine"), released, F.lit("31/12/2010"))
    header = "Interprete;Titre;Éditeur / Distributeur;Catégorie;Certification;Date de sortie;Date de constat"
    return csv.french_list(spark, _lines(spark, d, header, line))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, 'a;b,c' AS note, NULL::DATE AS day FROM nation")
def probed_list(spark, d):
    return csv.probed(spark, _lines(spark, d, "id|name|note", F.concat_ws("|", "n_nationkey", "n_name", F.lit("a;b,c"))))


@query(
    "SELECT o_orderkey::VARCHAR AS \"Id\", 'Étoile ' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN ' ñ' WHEN 1 THEN ' 日本' ELSE ' -' END AS \"Nom\", CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS \"Date de constat\", CASE WHEN o_orderkey % 3 = 2 THEN 'soon' END AS \"Release date\", CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS day FROM orders"
)
def dialect_lists(spark, d):
    """Files of three kinds: Latin-1 with tabs, UTF-8 with mark, semicolons and NUL bytes, and plain with commas and quotes."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    kind = k % 3
    name = F.concat(F.lit("Étoile "), "o_custkey", F.when(kind == 0, " ñ").when(kind == 1, " 日本").otherwise(" -"))
    line = F.when(kind == 0, F.concat_ws("\t", k, name, F.date_format(day, "dd/MM/yyyy"))).when(kind == 1, F.concat_ws(";", k, F.concat(name, F.lit("\x00")), F.date_format(day, "yyyy-MM-dd"))).otherwise(F.concat(k, F.lit(',"'), name, F.lit('",soon')))
    rows = table(spark, d, "orders").select((kind + 3 * (k % 5)).cast("int").alias("f"), k.alias("no"), line.alias("line"))
    head = F.when(F.col("id") % 3 == 0, "Id\tNom\tDate de constat").when(F.col("id") % 3 == 1, "\ufeffId;Nom;Date de constat").otherwise("Id,Nom,Release date")
    rows = rows.union(spark.range(15).select(F.col("id").cast("int"), F.lit(-1), head))
    latin = F.when(F.col("f") % 3 == 0, F.encode("line", "ISO-8859-1").cast("string")).otherwise(F.col("line"))
    path = scratch(spark, "lists")
    rows.repartition("f").sortWithinPartitions("f", "no").select("f", latin.alias("line")).write.partitionBy("f").text(path)
    return csv.probed(spark, f"{path}/f=*/*.txt", "date de CONSTAT")


@query("SELECT c_custkey::VARCHAR AS id, c_mktsegment || '; x, ' || (c_nationkey % 3) AS tags, c_name AS name FROM customer")
def csv_export(spark, d):
    path = scratch(spark, "export")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.concat("c_mktsegment", F.lit("; x")), (F.col("c_nationkey") % 3).cast("string")).alias("tags"), F.col("c_name").alias("name"))
    sinks.write_csv(rows, path)
    return spark.read.csv(path, header=True)


@query(
    "SELECT step, o_orderkey, o_totalprice + CASE WHEN v = 3 THEN 1 ELSE 0 END AS o_totalprice FROM (VALUES ('newest', 4), ('after damage', 3), ('restored', 2), ('asked for', 3)) s(step, v) JOIN orders ON o_orderkey % 5 = v"
)
def table_versions(spark, d):
    """Four versions are saved and the oldest is pruned. The newest is read; once rows were smuggled into it, the one before; after
    going back, that one; and one by its number."""
    root = scratch(spark, "versions")
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    of = lambda version: orders.where(F.col("o_orderkey") % 5 == version).withColumn("o_totalprice", F.col("o_totalprice") + F.lit(float(version == 3)))
    for version in (1, 2, 3, 4):
        sinks.save_version(of(version), root, version)
    sinks.prune_versions(spark, root, keep=3)
    out = settle(sinks.load_version(spark, root)).withColumn("step", F.lit("newest"))
    of(4).limit(1).write.mode("append").parquet(f"{root}/version=000004")
    out = out.unionByName(sinks.load_version(spark, root).withColumn("step", F.lit("after damage")))
    sinks.restore_version(spark, root, 2)
    return out.unionByName(sinks.load_version(spark, root).withColumn("step", F.lit("restored"))).unionByName(sinks.load_version(spark, root, 3).withColumn("step", F.lit("asked for")))


@query("SELECT p_partkey AS id, 0::BIGINT AS pos, p_name AS title, floor(p_retailprice)::BIGINT * 1000 AS streams, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size * 1000 END::BIGINT AS daily, 'id' || p_partkey AS external_id, p_partkey % 4 = 0 AS is_feature FROM part WHERE p_partkey % 5 <> 0")
def stream_tables(spark, d):
    k = F.col("p_partkey")
    title = F.concat(F.when(k % 4 == 0, "* ").otherwise(""), F.col("p_name"))
    cell = F.when(k % 5 == 0, title).otherwise(F.concat(F.lit('<a href="https://x/track/id'), k, F.lit('.html">'), title, F.lit("</a>")))
    daily = F.when(k % 3 == 0, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",000")))
    html = F.concat(F.lit('<p>x</p><table><tr><td>other</td></tr></table><table class="sortable addpos"><tr><th>Title</th></tr><tr><td>'), cell, F.lit("</td><td>"), F.floor("p_retailprice").cast("string"), F.lit(",000</td><td>"), daily, F.lit("</td></tr></table>"))
    return pages.stream_rows(table(spark, d, "part").select(k.alias("page_id"), html.alias("html")))


@query("SELECT p_partkey AS id, 0::BIGINT AS pos, p_brand AS artist, p_name AS title, 'House' AS publisher, p_type AS category, 'Or' AS level, NULL AS release_date, '01/02/2003' AS date FROM part WHERE p_partkey % 3 <> 0")
def certification_pages(spark, d):
    k = F.col("p_partkey")
    field = lambda css, value: F.concat(F.lit(f'<div class="{css}"> '), value, F.lit("</div>"))
    block = F.concat(F.lit('<div class="box certification">'), field("artist", F.col("p_brand")), field("title", F.concat(F.lit("<b>"), "p_name", F.lit("</b>"))), field("publisher", F.lit("House")), field("category", F.col("p_type")), field("level", F.when(k % 3 == 0, "").otherwise("Or")), field("date", F.lit("01/02/2003")), F.lit("</div>"))
    return pages.certification_blocks(table(spark, d, "part").select(k.alias("page_id"), block.alias("html")))


@query("SELECT o_orderkey AS track_id, o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR coalesce(n, 0) = 0 AS refresh FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def tracks_to_refresh(spark, d):
    k = F.col("o_orderkey")
    credits = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_quantity") > 25).alias("credits"))
    tracks = table(spark, d, "orders").select(k, F.when(k % 7 != 0, k).alias("genius_id"), F.when(k % 5 != 0, F.col("o_orderdate")).alias("release_date"), F.when(k % 3 == 0, "").otherwise("album").alias("album")).join(credits, "o_orderkey", "left")
    return tracks.select(k.alias("track_id"), rollup.needs_refresh(tracks).alias("refresh"))


@query(
    "WITH t AS (SELECT o_orderkey AS k, o_orderkey % 4 <> 0 AS sync, o_orderkey % 2 = 0 AS want FROM orders), "
    "v AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'a' END AS one, CASE WHEN k % 5 = 0 THEN 'b' END AS two, CASE WHEN k % 7 <> 0 THEN 'c' END AS three, sync AND k % 3 = 0 AND k % 5 = 0 AS dual FROM t) "
    "SELECT k AS track_id, CASE WHEN NOT sync THEN NULL WHEN dual THEN CASE WHEN k % 2 = 0 THEN 'LRCLIB' ELSE 'YouTube Music' END WHEN one IS NOT NULL THEN 'LRCLIB' WHEN two IS NOT NULL THEN 'YouTube Music' WHEN three IS NOT NULL THEN 'Musixmatch' END AS source, "
    "CASE WHEN sync AND (one IS NOT NULL OR two IS NOT NULL OR three IS NOT NULL) THEN 1.0::DOUBLE END AS confidence, CASE WHEN want AND k % 6 <> 0 AND two IS NOT NULL THEN 'words ' || k END AS text, CASE WHEN want AND k % 6 <> 0 AND two IS NOT NULL THEN CASE WHEN k % 20 = 0 THEN 'Other' ELSE 'YouTube Music' END END AS text_source FROM v"
)
def lyrics_by_source(spark, d):
    """The first two services' lyrics have one line each, at 0:50 and 1:10: the nearer one to the duration is taken, which is
    0:55 (even tracks) or, from the second service, 1:05."""
    o, k = table(spark, d, "orders"), F.col("track_id")
    o = o.select(F.col("o_orderkey").alias("track_id"))
    tracks = o.select(k, F.when(k % 2 == 0, 55.0).alias("duration"), F.when(k % 6 == 0, "has text").otherwise("").alias("lyrics"), (k % 4 != 0).alias("need_sync"), (k % 2 == 0).alias("need_text"))
    none = F.lit(None).cast("string")
    reply = lambda s, at, keep, *more: o.where(keep).select(k, F.lit(s).alias("source"), F.lit(f"[{at}.00] line").alias("lrc"), *more)
    empty = [none.alias("text"), F.lit(None).cast("double").alias("duration"), none.alias("text_source")]
    second = [F.concat(F.lit("words "), k).alias("text"), F.lit(65.0).alias("duration"), F.when(k % 20 == 0, "Other").otherwise("").alias("text_source")]
    replies = reply("lrclib", "00:50", k % 3 == 0, *empty).union(reply("ytmusic", "01:10", k % 5 == 0, *second)).union(reply("musixmatch", "00:10", k % 7 != 0, *empty))
    return resolve.resolved_lyrics(tracks, replies).select("track_id", "source", "confidence", "text", "text_source")


_SONG_PAGES = (
    "WITH p AS (SELECT page_id AS k, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages WHERE html IS NOT NULL), "
    "c AS (SELECT k, 'Producer' AS role, NULL AS detail, host AS value, 0 AS pos FROM p UNION ALL SELECT k, 'Producer', NULL, 'Ann ' || k, 1 FROM p UNION ALL SELECT k, 'Producer', NULL, 'Bo & Co', 2 FROM p WHERE k % 2 = 0 "
    "UNION ALL SELECT k, 'Producer', NULL, 'Bo', 2 FROM p WHERE k % 2 = 1 UNION ALL SELECT k, 'Producer', NULL, 'Co', 3 FROM p WHERE k % 2 = 1 "
    "UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN 'Other' ELSE 'Writer' END, CASE WHEN k % 3 = 0 THEN 'Choir of ' || host END, 'Di', CASE WHEN k % 2 = 1 THEN 4 ELSE 3 END FROM p) "
)


@query(
    _SONG_PAGES
    + "SELECT k AS page_id, 'credit' AS kind, role, detail, value, pos FROM c UNION ALL SELECT k, 'lyrics', NULL, NULL, '[Verse]' || chr(10) || host || chr(10) || chr(10) || 'second ' || k, 0 FROM p "
    "UNION ALL SELECT k, 'album', NULL, NULL, CASE WHEN k % 4 = 0 THEN 'Elsewhere' ELSE 'Album ' || k END, 0 FROM p UNION ALL SELECT k, 'about', NULL, NULL, 'A song of ' || host || ' with ' || repeat('words ', 8) || 'about ' || k, 0 FROM p WHERE k % 5 <> 0"
)
def song_pages(spark, d):
    """Each page of the table with credits, lyrics, album and prose of its own url ahead of all that it holds itself."""
    k, host = F.col("page_id"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    own = F.when(k % 2 == 0, "<a>Bo &amp; Co</a>").otherwise("Bo &amp; Co")  # a linked name is one name
    first = say('<div class="Credit__Container-x"><div class="Credit__Label-y">Producers</div><div class="Credit__Contributor-z"><a href="/a">', host, "</a><a>Ann ", k.cast("string"), "</a> ", own, " <a>", host, "</a></div></div>")
    other = say('<div class="Credit__Container-x"><div class="Credit__Label-y">', F.when(k % 3 == 0, say("Choir of ", host)).otherwise("Writer"), '</div><div class="Credit__Contributor-z">Di</div></div><div class="Credit__Container-x"><div class="Credit__Label-y">Genre</div><div class="Credit__Contributor-z">No one</div></div>')
    lyrics = say('<div data-lyrics-container="true"><div data-exclude-from-selection="true">Contributors</div>[Verse]<br><a><i>', host, '</i></a><div class="SidebarAd">buy</div></div><div data-lyrics-container="true">second ', k.cast("string"), "<br>12Embed</div>")
    album = F.when(k % 4 == 0, '<a href="/albums/z">Elsewhere</a>').otherwise(say('<a href="/albums/z">Elsewhere</a><div class="HeaderArtistAndTracklist-q"><a href="/albums/x"> Album ', k.cast("string"), " (2020)</a></div>"))
    about = say('<div class="RichText__Container-r">', F.when(k % 5 == 0, "short").otherwise(say("A song of <b>", host, "</b> with ", F.lit("words " * 8), 'about <div class="embedly">video</div>', k.cast("string"))), "</div>")
    html = say("<html><body>", first, other, lyrics, album, about, F.col("html"))
    return markup.song_page_parts(table(spark, d, "pages").select("page_id", html.alias("html")))


@query(
    "WITH l AS (SELECT l_orderkey AS p, l_linenumber AS n, l_suppkey AS s, l_partkey AS t, l_quantity::INT AS q, l_shipdate::DATE AS day FROM lineitem), "
    "r AS (SELECT *, (row_number() OVER (PARTITION BY p ORDER BY n, t, s, q))::INT - 1 AS pos FROM l WHERE t % 11 <> 0), "
    "e AS (SELECT *, 0 AS step, q % 12 || 'x Platinum' AS sl, day - 30 AS sd, (q % 12) * 1000000 AS su FROM r WHERE q % 4 >= 2 UNION ALL SELECT *, CASE WHEN q % 4 = 3 THEN 1 ELSE 0 END, 'Gold', day, 500000 FROM r WHERE q % 2 = 1) "
    "SELECT r.p AS page_id, r.pos, 'Artist ' || r.s AS artist, 'Title ' || r.t AS title, CASE r.q % 12 WHEN 0 THEN 'Gold' WHEN 1 THEN 'Platinum' WHEN 10 THEN 'Diamond' ELSE r.q % 12 || 'x Platinum' END AS level, CASE r.q % 12 WHEN 0 THEN 500000 WHEN 10 THEN 10000000 ELSE 1000000 * (r.q % 12) END AS units, strftime(r.day, '%Y-%m-%d') AS day, "
    "e.step::INT AS step, e.sl AS step_level, strftime(e.sd, '%Y-%m-%d') AS step_day, CASE WHEN e.sl IS NOT NULL THEN strftime(r.day - 365, '%Y-%m-%d') END AS released, e.su AS step_units FROM r LEFT JOIN e ON e.p = r.p AND e.pos = r.pos"
)
def award_histories(spark, d):
    """An award page for each order: a row for each of its lines, with a detail table of up to two entries; rows without a title
    and entries without a level count for nothing."""
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    us = lambda c: F.date_format(c, "MMMM d, yyyy")
    td = lambda css, x: say(f'<td class="{css}">', x, "</td>")

    def row(x):
        q, key = x["q"], F.concat_ws("-", x["l_linenumber"], x["l_partkey"], x["l_suppkey"], x["q"])
        title = F.when(x["l_partkey"] % 11 == 0, "").otherwise(say("Title ", x["l_partkey"].cast("string")))
        main = say('<tr class="table_award_row" id="default_', key, '"><td><img class="award" src="/a/', (q % 12).cast("string"), '_big.png"></td>', td("artists_cell", say("Artist ", x["l_suppkey"].cast("string"))), td("others_cell", title), td("others_cell", x["shipped"]), td("others_cell", F.lit("House")), td("format_cell", F.lit("SINGLE <a>MORE DETAILS</a>")), "</tr>")
        entry = say('<tr class="content_recent_table">', td("x", F.date_format(F.date_sub(x["day"], 365), "M/d/yyyy")))
        one = F.when(q % 4 >= 2, say(entry, td("x", say((q % 12).cast("string"), "x Platinum | <b>", us(F.date_sub(x["day"], 30)), "</b>")), "</tr>")).otherwise("")
        two = say(entry, td("x", F.when(q % 2 == 1, "Gold").otherwise(" ")), "</tr>")
        return say(main, '<tr><td><table id="recent_', key, '_detail">', one, two, "</table></td></tr>")

    # lines are gathered before they become markup, which is far longer
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), us(F.col("l_shipdate")).alias("shipped"), F.col("l_shipdate").cast("date").alias("day"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return markup.award_history(lines.select("page_id", say("<table>", F.array_join(F.transform("lines", row), ""), "</table>").alias("html")))
