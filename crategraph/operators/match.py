"""Entity resolution in stages. Each stage joins only what earlier stages have left; uniqueness is a window count; fuzzy and
containment tests run on blocked candidates, never on all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crategraph.functions.catalog import country_rank, level_rank
from crategraph.functions.text import contains_word, loose_key, loose_title_key, plain_key, ratio, tempo_key, title_core
from crategraph.operators.similar import containing, joined_scores, nearest, unblocked
from crategraph.shared import join_measured, settle

SURE, MAYBE, LEAD = 0.87, 0.55, 0.08


def lone(df: DataFrame, by: str | list[str]) -> DataFrame:
    """Rows whose key has no other row."""
    by = [by] if isinstance(by, str) else by
    return df.withColumn("__of", F.count("*").over(Window.partitionBy(*by))).where("__of = 1").drop("__of")


def staged_match(entries: DataFrame, tracks: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """(entry_id, track_id, stage, score) of stream entries.

    ``entries``: entry_id, artist_id, external_id, title_key, credited (array of artist keys, may be null).
    ``tracks``: track_id, artist_id, external_id, title_key, primary_key (artist key of the track).
    ``memory``: artist_id, entry_title_key, track_id, accepted (a refusal needs no track). Stages: 'id' equal external ids;
    'title' a title of one track; 'credited' several tracks of that title, of which one's artist is credited; 'fuzzy' exactly
    one track at 0.87 or more; 'remembered' what was confirmed for the title, if that track is there still; 'suggested' the best
    in [0.55, 0.87) by a lead of 0.08, unless the title was decided on before, either way. Fuzzy stages compare within the
    artist, and only what no stage ahead has met by title."""
    e, t = entries, tracks
    row = lambda df, stage, score=F.lit(1.0): df.select("entry_id", "track_id", F.lit(stage).alias("stage"), score.alias("score"))
    held = t.where("external_id IS NOT NULL").groupBy("artist_id", "external_id").agg(F.min("track_id").alias("track_id"))
    ids = e.where("external_id IS NOT NULL").join(held, ["artist_id", "external_id"])
    by_id = ids.groupBy("entry_id").agg(F.min("track_id").alias("track_id"))
    rest = e.join(by_id.select("entry_id"), "entry_id", "left_anti").where("title_key <> ''")
    # tracks are counted by title and artist key first, so that no entry meets each of a title's tracks
    title, whole = ["artist_id", "title_key"], Window.partitionBy("entry_id")
    places = settle(t.groupBy(*title, "primary_key").agg(F.count("*").alias("of"), F.min("track_id").alias("track_id")))
    titles = places.groupBy(*title).agg(F.sum("of").alias("of"), F.min("track_id").alias("track_id"))
    same = settle(rest.join(titles, title).withColumn("n", F.sum("of").over(whole)))
    names = lambda c: (F.col("primary_key") == c) | F.contains(c, F.col("primary_key")) | F.contains(F.col("primary_key"), c)
    several = same.where("n > 1 AND credited IS NOT NULL").select("entry_id", *title, "credited")
    claims = several.select(*title, "credited").distinct().join(places, title).where(F.exists("credited", names))
    claims = claims.groupBy(*title, "credited").agg(F.sum("of").alias("of"), F.min("track_id").alias("track_id"))
    credited = several.join(claims, [*title, "credited"]).withColumn("n", F.sum("of").over(whole)).where("n = 1")
    by_title = row(same.where("n = 1"), "title").unionAll(row(credited, "credited"))
    left = rest.join(same.select("entry_id").distinct(), "entry_id", "left_anti").select("entry_id", "artist_id", "title_key")
    partners = t.select("artist_id", F.col("title_key").alias("text"), F.col("track_id").alias("right_id"))
    scores = nearest(left.select("artist_id", F.col("title_key").alias("text")), partners, ["artist_id"], floor=MAYBE - LEAD, keep=2)
    scored = joined_scores(left, scores, ["artist_id"], "title_key").withColumnRenamed("right_id", "track_id")
    w = Window.partitionBy("entry_id").orderBy(F.desc("score"), "track_id")
    sure = F.count_if(F.col("score") >= SURE).over(Window.partitionBy("entry_id"))  # of the best two
    best = scored.withColumns({"r": F.row_number().over(w), "next": F.lead("score").over(w), "sure": sure}).where("r = 1")
    best = settle(best.select("entry_id", "artist_id", "title_key", "track_id", "score", "next", "sure"))  # read three times below
    fuzzy = best.where("sure = 1")
    lead = F.col("next").isNull() | (F.col("score") - F.col("next") >= LEAD)
    maybe = best.where((F.col("score") >= MAYBE) & (F.col("score") < SURE) & lead)
    done = row(by_id, "id").unionAll(by_title).unionAll(row(fuzzy, "fuzzy", F.col("score")))
    if memory is not None:
        m = memory.select("artist_id", F.col("entry_title_key").alias("title_key"), "track_id", "accepted")
        open_ = rest.join(by_title.select("entry_id"), "entry_id", "left_anti").join(fuzzy.select("entry_id"), "entry_id", "left_anti").select("entry_id", "artist_id", "title_key")
        known = open_.join(m.where("accepted"), ["artist_id", "title_key"]).join(t.select("artist_id", "track_id"), ["artist_id", "track_id"], "left_semi")
        done = done.unionAll(row(known, "remembered"))
        maybe = maybe.join(m.select("artist_id", "title_key"), ["artist_id", "title_key"], "left_anti")
    return done.unionAll(row(maybe, "suggested", F.col("score")))


def unique_title_match(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """(entry_id, track_id) by equal titles of an artist, where only one track has the title."""
    return entries.where("title_key <> ''").join(lone(tracks.select("artist_id", "title_key", "track_id"), ["artist_id", "title_key"]), ["artist_id", "title_key"]).select("entry_id", "track_id")


#: Fixed value: a title ahead of its featuring part.
FEATURING = r"(?i)^(.+?)\s*[\(\[]?\s*\b(?:FEAT|FT|FEATURING)\b\.?"


def certification_match(tracks: DataFrame, certs: DataFrame) -> DataFrame:
    """(track_id, cert_id, strategy) between tracks (track_id, artist, title) and certifications (cert_id, artist_clean,
    title_clean), all keys normalised.

    A certification fits if artist and title contain the track's ('contains'; equality where the title is empty), or those of
    the title without its featuring part ('featuring': equal ones, else containing ones); only where nothing fits and the
    title has 8 characters or more, an equal artist's title of 8 characters or more that the track's begins with
    ('prefix'). Texts are matched once each, and tracks and certifications meet by the texts that fit: what fits may be many
    pairs, but they are neither shuffled nor kept."""
    t, c = tracks.select("track_id", "artist", "title").distinct(), certs.select("cert_id", "artist_clean", "title_clean").distinct()
    return _met(t, c, _fitting(t, c)).select("track_id", "cert_id", "strategy")


def _fitting(tracks: DataFrame, certs: DataFrame) -> DataFrame:
    """Distinct (artist, title, artist_clean, title_clean, strategy) that fit. Artists meet by their rarest pieces, then the titles
    of artists that met by theirs; prefixes by their first eight characters."""
    own, other = ["artist", "title"], ["artist_clean", "title_clean"]
    t = settle(tracks.where("artist <> '' AND title IS NOT NULL").select(*own).distinct()).withColumn("main", F.trim(F.regexp_extract("title", FEATURING, 1)))
    certs = settle(certs.select(*other).distinct())
    # artists first: they repeat far more than pairs of them do
    wide = t.join(unblocked(t, certs, "artist", "artist_clean"), "artist")  # settled: narrow pairs of artists
    equal = F.col("artist") == F.col("artist_clean")
    empty = wide.where((F.col("title") == "") & equal).join(certs.where("title_clean = ''"), "artist_clean")
    full = containing(wide, certs, ["artist_clean"], "title", "title_clean")
    part = containing(wide, certs, ["artist_clean"], "main", "title_clean")
    exact = F.max((equal & (F.col("title_clean") == F.col("main"))).cast("int")).over(Window.partitionBy(*own))
    part = part.withColumn("__exact", exact).where((F.col("__exact") == 0) | (equal & (F.col("title_clean") == F.col("main"))))
    kind = lambda df, s: df.select(*own, *other, F.lit(s).alias("strategy"))
    hits = kind(empty, "exact").unionAll(kind(full, "contains")).unionAll(kind(part, "featuring"))
    hits = settle(hits.groupBy(*own, *other).agg(F.min("strategy").alias("strategy")))
    left = t.where(F.length("title") >= 8).join(hits.select(*own).distinct(), own, "left_anti").withColumn("__head", F.left("title", F.lit(8)))
    size = F.length("title_clean")
    heads = certs.where(size >= 8).select(F.col("artist_clean").alias("artist"), F.left("title_clean", F.lit(8)).alias("__head"), *other)
    prefix = left.join(heads, ["artist", "__head"]).where((size < F.length("title")) & F.startswith("title", "title_clean"))
    return settle(hits.unionAll(kind(prefix, "prefix")))


def _met(left: DataFrame, certs: DataFrame, fits: DataFrame, by: tuple[str, ...] = ("artist", "title")) -> DataFrame:
    """Rows of ``left`` with the certifications whose texts fit theirs; ``fits`` is settled. Both sides are dealt out by text: their
    rows are few, but what they make is not, so it must not be left to the few tasks that read them."""
    return join_measured(left, fits, list(by), "inner").join(certs.hint("merge"), ["artist_clean", "title_clean"])


def certification_match_any(tracks: DataFrame, certs: DataFrame, candidates: str = "artists") -> DataFrame:
    """``certification_match`` over every artist of an array column; a certification counts once, which is seen to among texts."""
    t = tracks.select("track_id", "title", F.array_sort(F.array_distinct(candidates)).alias("artists")).distinct()
    c = certs.select("cert_id", "artist_clean", "title_clean").distinct()
    texts = settle(t.select("artists", "title").distinct())
    each = texts.select("artists", "title", F.explode("artists").alias("artist"))
    fits = each.join(_fitting(each, c), ["artist", "title"]).select("artists", "title", "artist_clean", "title_clean").distinct()
    return _met(t, c, settle(fits), ("artists", "title")).select("track_id", "cert_id")


def album_certification_match(albums: DataFrame, certs: DataFrame) -> DataFrame:
    """(album_id, cert_id): album certifications equal in artist and title, only where there are none those containing both.
    Texts are matched once each, as in ``certification_match``."""
    own, other = ["artist", "title"], ["artist_clean", "title_clean"]
    c = certs.where("cat = 'album'").select("cert_id", *other)
    a = albums.where("artist <> '' AND title <> ''").select("album_id", *own)
    texts, known = settle(a.select(*own).distinct()), settle(c.select(*other).distinct())
    exact = texts.join(known, (texts["artist"] == known["artist_clean"]) & (texts["title"] == known["title_clean"])).select(*own, *other)
    rest = texts.join(exact.select(*own), own, "left_anti")
    wide = rest.join(unblocked(rest, known, "artist", "artist_clean"), "artist")
    fits = exact.unionAll(containing(wide, known, ["artist_clean"], "title", "title_clean").select(*own, *other))
    return _met(a, c, settle(fits)).select("album_id", "cert_id")


def attach_certifications(tracks: DataFrame, matches: DataFrame, certs: DataFrame) -> DataFrame:
    """``tracks`` with their certifications (by country, level rank, date) as an array, the highest level and its date."""
    entry = F.struct(country_rank(F.col("country")).alias("c"), level_rank(F.col("level")).alias("r"), F.coalesce("date", F.lit("")).alias("date"), "level", "country", "cert_id")
    listed = matches.join(certs, "cert_id").groupBy("track_id").agg(F.array_sort(F.collect_list(entry)).alias("__e"))
    df = tracks.join(listed, "track_id", "left")
    e = F.coalesce("__e", F.array().cast(listed.schema["__e"].dataType))
    top = F.array_min(F.transform(e, lambda x: F.struct(x["r"].alias("r"), x["date"].alias("date"), x["level"].alias("level"))))
    return df.withColumns({"certifications": F.transform(e, lambda x: F.struct(x["level"], x["date"], x["country"], x["cert_id"])), "highest": top["level"], "highest_date": top["date"]}).drop("__e")


def certification_audit(artists: DataFrame, certs: DataFrame, titles: DataFrame) -> DataFrame:
    """French certifications of each artist (whole word of the certified artist) against known titles.

    ``artists``: artist_id, artist; ``titles``: artist_id, kind ('track' or 'album'), title. A certification is matched if its
    title is known, or at 8 characters or more begins a known one, or contains or is contained in one; else it is an orphan
    with its closest title (the first in order of those equally close; null if none shares a letter) and their ratio. Album certifications are held against albums if there are any, else tracks."""
    c = certs.where("body = 'SNEP' AND title_clean <> ''")
    pairs = unblocked(artists.where("artist <> ''"), c, "artist", "artist_clean")
    mine = artists.join(pairs, "artist").where(contains_word(F.col("artist_clean"), F.col("artist"))).join(c, "artist_clean")
    known = settle(titles.where("title <> ''").select("artist_id", "kind", "title").distinct())
    albums = known.where("kind = 'album'").select("artist_id").distinct().withColumn("has_albums", F.lit(True))
    mine = mine.join(albums, "artist_id", "left").withColumn("kind", F.when((F.col("cat") == "album") & F.coalesce("has_albums", F.lit(False)), "album").otherwise("track"))
    mine = settle(mine.select("artist_id", "cert_id", "title_clean", "cat", "kind"))
    by = ["artist_id", "kind"]
    # equal titles and those that a certified one begins contain one another, too
    hit = containing(mine, known, by, "title_clean", "title").unionByName(containing(known, mine, by, "title", "title_clean"))
    hit = hit.select("artist_id", "cert_id").distinct().withColumn("matched", F.lit(True))
    mine = mine.join(hit, ["artist_id", "cert_id"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    orphans = mine.where(~F.col("matched"))
    close = nearest(orphans.select(*by, F.col("title_clean").alias("text")), known.select(*by, F.col("title").alias("text"), F.col("title").alias("right_id")), by, floor=1e-9, keep=1)
    close = close.select(*by, F.col("text").alias("title_clean"), F.col("right_id").alias("closest"), "score")
    out = mine.join(close, [*by, "title_clean"], "left")
    score = F.when(~F.col("matched"), F.round(F.coalesce("score", F.lit(0.0)), 2))
    return out.select("artist_id", "cert_id", "title_clean", F.when(F.col("cat") == "album", "album").otherwise("track").alias("kind"), "matched", F.when(~F.col("matched"), F.col("closest")).alias("closest"), score.alias("ratio"))


def import_match(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(incoming_id, track_id, level) of imported tracks: by genius_id, else by title and album in lower case, else by title
    in lower case, there the most complete track (album, tempo, lyrics, number of credits; then least id)."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    i = incoming.select("incoming_id", "genius_id", low("title").alias("lt"), low("album").alias("la"))
    score = F.struct(F.col("album").isNotNull(), F.col("bpm").isNotNull(), F.coalesce("has_lyrics", F.lit(False)), F.coalesce("credits", F.lit(0)), -F.col("track_id"))
    k = known.select("track_id", "genius_id", low("title").alias("lt"), low("album").alias("la"), score.alias("score"))

    def stage(rest: DataFrame, keys: list[str], level: str) -> DataFrame:
        # the best of a key first: keys may have many tracks
        best = k.groupBy(*keys).agg(F.max_by("track_id", "score").alias("track_id"), F.max("score").alias("score"))
        found = rest.join(best, keys)
        return found.groupBy("incoming_id").agg(F.max_by("track_id", "score").alias("track_id")).withColumn("level", F.lit(level))

    one = stage(i.where("genius_id IS NOT NULL"), ["genius_id"], "id")
    rest = i.join(one.select("incoming_id"), "incoming_id", "left_anti")
    two = stage(rest.where("la <> ''"), ["lt", "la"], "title and album")
    rest = rest.join(two.select("incoming_id"), "incoming_id", "left_anti")
    return one.unionAll(two).unionAll(stage(rest, ["lt"], "title"))


def tempo_hit(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """Of search hits (by, position, hit_artist, hit_title, artist, title): same artist, equal title first, else the first
    hit where one title contains the other."""
    a, t, n = tempo_key(F.col("hit_artist")), tempo_key(F.col("hit_title")), tempo_key(F.col("title"))
    ok = hits.withColumns({"__a": a, "__t": t, "__n": n, "__w": tempo_key(F.col("artist"))}).where("__a = __w AND (contains(__t, __n) OR contains(__n, __t))")
    rank = F.struct((F.col("__t") != F.col("__n")).alias("other"), F.col("position"))
    return ok.groupBy(by).agg(F.min_by("position", rank).alias("position"), F.min_by("hit_title", rank).alias("hit_title"))


def song_accepted(df: DataFrame) -> DataFrame:
    """``df`` with ``accepted``: equal ids decide where both are known; else equal artists and titles that are equal, contain
    one another from 4 characters on, or are alike to 0.85."""
    r, s = loose_title_key(F.col("result_title")), loose_title_key(F.col("title"))
    df = df.withColumns({"__r": r, "__s": s}).withColumn("__q", ratio("__r", "__s"))
    inside = (F.contains("__r", "__s") | F.contains("__s", "__r")) & (F.least(F.length("__r"), F.length("__s")) >= 4)
    by_name = (loose_key(F.col("result_artist")) == loose_key(F.col("artist"))) & (F.col("__r") != "") & (F.col("__s") != "") & ((F.col("__r") == F.col("__s")) | inside | (F.col("__q") >= 0.85))
    ids = F.nullif("result_id", F.lit("")).isNotNull() & F.nullif("id", F.lit("")).isNotNull()
    return df.withColumn("accepted", F.when(ids, F.col("result_id") == F.col("id")).otherwise(F.coalesce(by_name, F.lit(False)))).drop("__r", "__s", "__q")


def lyrics_hit(candidates: DataFrame, by: str = "track_id") -> DataFrame:
    """The best of lyrics candidates (by, position, title, artist, duration, hit_title, hit_artist, hit_duration): titles alike
    to 0.72; title plus half the artist's likeness, plus 1 within 2 s, 0.3 within 5 s, minus the gap in minutes (1 at most)
    beyond; first at a tie."""
    df = candidates.withColumns({"a": title_core(F.col("title")), "b": title_core(F.col("hit_title")), "c": plain_key(F.col("artist")), "d": plain_key(F.col("hit_artist"))})
    df = df.withColumns({"rt": ratio("a", "b"), "ra": ratio("c", "d")})
    both = lambda x, y: (F.col(x) != "") & (F.col(y) != "")
    within = lambda x, y: F.contains(x, y) | F.contains(y, x)
    title = F.when(~both("a", "b"), 0.0).when(F.col("a") == F.col("b"), 1.0).when(within("a", "b"), F.greatest("rt", F.lit(0.9))).otherwise(F.col("rt"))
    artist = F.when(F.coalesce("artist", F.lit("")) == "", 0.5).when(~both("c", "d"), 0.0).when(within("c", "d"), 1.0).otherwise(F.col("ra"))
    gap = F.abs(F.col("hit_duration").cast("int") - F.col("duration").cast("int"))
    bonus = F.when(~((F.col("duration") > 0) & (F.col("hit_duration") > 0)) | gap.isNull(), 0.0).when(gap <= 2, 1.0).when(gap <= 5, 0.3).otherwise(-F.least(gap / 60.0, F.lit(1.0)))
    df = df.withColumn("title_score", title).where("title_score >= 0.72").withColumn("score", F.col("title_score") + 0.5 * artist + bonus)
    best = F.struct("score", -F.col("position"))
    return df.groupBy(by).agg(F.max_by("position", best).alias("position"), F.max("score").alias("score"))


def most_popular(recordings: DataFrame, by: str = "isrc") -> DataFrame:
    """The most popular recording of each code, the first at a tie."""
    return recordings.groupBy(by).agg(F.max_by("recording_id", F.struct(F.coalesce("popularity", F.lit(-1)), -F.col("position"))).alias("recording_id"))


def names_match(a: Column, b: Column) -> Column:
    """Equal, one within the other, or alike to 0.8; keys are expected."""
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a) | (ratio(a, b) >= 0.8))


def id_is_free(tracks: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals (track_id, external_id, title_key) with ``free``: the id's first carrier (by track_id) among other tracks has
    the same title, or there is none."""
    carriers = tracks.where("external_id IS NOT NULL AND track_id IS NOT NULL").select("external_id", F.struct(F.col("track_id").alias("id"), F.col("title_key").alias("key")).alias("__c"))
    # an id's two least carriers decide for all its proposals
    least = settle(carriers.groupBy("external_id").agg(F.min("__c").alias("__one")))
    others = join_measured(carriers, least, "external_id", "inner").where(F.col("__c.id") != F.col("__one.id"))
    least = settle(least.join(others.groupBy("external_id").agg(F.min("__c").alias("__two")), "external_id", "left"))
    wide = join_measured(proposals.select("track_id", "external_id", "title_key").distinct(), least, "external_id")
    key = F.when(F.col("track_id") != F.col("__one.id"), F.col("__one.key")).when(F.col("track_id") == F.col("__one.id"), F.col("__two.key"))
    return wide.select("track_id", "external_id", (key.isNull() | (key == F.col("title_key"))).alias("free"))


#: Fixed value: what parts the names of a collaboration.
COLLABORATION = r"\s*(?:&|,|\+|\bet\b|\bx\b|\bfeat\.?\b|\bft\.?\b)\s*"


def credited(df: DataFrame, artist_id: str = "artist_id", artist: str = "artist") -> DataFrame:
    """``df`` with ``credited``: the artist is among the featured or primary ids, or is exactly one of the names that a
    collaboration's name is made of."""
    ids = F.array_contains(F.concat(F.coalesce("featured_ids", F.array().cast("array<bigint>")), F.coalesce("primary_ids", F.array().cast("array<bigint>"))), F.col(artist_id))
    parts = F.transform(F.split(F.lower("primary_name"), COLLABORATION), lambda x: F.trim(x))
    return df.withColumn("credited", F.coalesce(ids, F.lit(False)) | F.coalesce(F.array_contains(parts, F.lower(artist)), F.lit(False)))


def role_on_song(primary: Column, featured: Column, custom: Column, producers: Column, writers: Column, artist_id: Column) -> Column:
    """primary, featured, custom, producer or writer, in this order; null if none."""
    has = lambda c: F.coalesce(F.array_contains(c, artist_id), F.lit(False))
    return F.when(has(primary), "primary").when(has(featured), "featured").when(has(custom), "custom").when(has(producers), "producer").when(has(writers), "writer")


def candidate_order(name: Column, wanted: Column) -> Column:
    """Rank of a search candidate: equal, beginning with, containing, other."""
    n, w = F.lower(F.trim(name)), F.lower(F.trim(wanted))
    return F.when(n == w, 0).when(F.startswith(n, w), 1).when(F.contains(n, w), 2).otherwise(3)


def classify_import(tracklist: DataFrame, known: DataFrame, deleted: DataFrame, artist_key: str) -> DataFrame:
    """``tracklist`` with ``state`` (known, deleted, new) by genius_id, and ``featuring`` where the primary artist is another."""
    k = known.select("genius_id").distinct().withColumn("__k", F.lit(True))
    d = deleted.select("genius_id").distinct().withColumn("__d", F.lit(True))
    df = tracklist.join(k, "genius_id", "left").join(d, "genius_id", "left")
    return df.withColumns({"state": F.when(F.col("__k"), "known").when(F.col("__d"), "deleted").otherwise("new"), "featuring": F.col("primary_key") != F.col(artist_key)}).drop("__k", "__d")
