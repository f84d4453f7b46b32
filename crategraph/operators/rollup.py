"""Roll-ups, listings, co-credit graphs and sort orders over artists, tracks and credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crategraph.functions.catalog import LEVEL_RANKS, is_video_credit, total_estimate
from crategraph.functions.parse import duration_seconds, flexible_date
from crategraph.shared import dealt

FEATURINGS, SINGLES = "featurings", "singles"
PRODUCERS = ("Producer", "Co-Producer", "Executive Producer", "Vocal Producer", "Additional Production")
WRITERS = ("Writer", "Composer", "Lyricist")


def artist_overview(artists: DataFrame, tracks: DataFrame, credits: DataFrame) -> DataFrame:
    """artist_id, tracks, credits and last update of every artist. Each side is summed before it is joined, so nothing fans out."""
    c = credits.groupBy("track_id").agg(F.count("*").alias("credits"))
    t = tracks.join(c, "track_id", "left").groupBy("artist_id").agg(F.count("*").alias("tracks"), F.coalesce(F.sum("credits"), F.lit(0)).alias("credits"), F.max("updated_at").alias("last_update"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return artists.select("artist_id").join(t, "artist_id", "left").select("artist_id", zero("tracks"), zero("credits"), "last_update")


def recent_tracks(tracks: DataFrame, credits: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` tracks updated last with their number of credits; the top is taken before the join."""
    top = tracks.orderBy(F.desc_nulls_last("updated_at"), "track_id").limit(n)
    c = credits.join(top.select("track_id"), "track_id", "left_semi").groupBy("track_id").agg(F.count("*").alias("credits"))
    return top.join(c, "track_id", "left").withColumn("credits", F.coalesce("credits", F.lit(0)))


def credits_by_role(credits: DataFrame) -> DataFrame:
    return credits.groupBy("role").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role")


def complete_by_roles(credits: DataFrame, roles: tuple[str, str]) -> DataFrame:
    """Tracks with credits in both roles."""
    return credits.where(F.col("role").isin(*roles)).groupBy("track_id").agg(F.count_distinct("role").alias("n")).where("n = 2").select("track_id")


def duplicate_titles(tracks: DataFrame, key: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Groups of two tracks or more of one title key: n, least and all ids in order."""
    return tracks.withColumn("title_key", key).where("title_key <> ''").groupBy(*by, "title_key").agg(F.count("*").alias("n"), F.min("track_id").alias("first_id"), F.array_join(F.sort_array(F.collect_list("track_id")), ",").alias("ids")).where("n > 1")


def most_complete(tracks: DataFrame, by: list[str]) -> DataFrame:
    """Of duplicates the one to keep: album 1, genius id 2, duration 1, external id 1, lyrics 1, credits 2 points; least id."""
    has = lambda c, p: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), p).otherwise(0)
    score = has("album", 1) + has("genius_id", 2) + has("duration", 1) + has("external_id", 1) + F.when(F.col("has_lyrics"), 1).otherwise(0) + F.when(F.col("credits") > 0, 2).otherwise(0)
    df = tracks.withColumn("score", score)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "track_id"))).where("__n = 1").drop("__n")


def merge_conflicts(pairs: DataFrame, fields: list[str], normal=lambda c: F.lower(F.trim(c.cast("string")))) -> DataFrame:
    """Pairs (a and b: structs of track fields) with the fields in conflict (both filled and different), each side's filled
    fields and the default one to keep (more filled fields, then least id)."""
    filled = lambda s, f: F.col(f"{s}.{f}").isNotNull() & (F.col(f"{s}.{f}").cast("string") != "")
    clash = lambda f: F.when(filled("a", f) & filled("b", f) & (normal(F.col(f"a.{f}")) != normal(F.col(f"b.{f}"))), F.lit(f))
    count = lambda s: sum((filled(s, f).cast("int") for f in fields), F.lit(0))
    df = pairs.withColumns({"conflicts": F.concat_ws(",", *(clash(f) for f in fields)), "score_a": count("a"), "score_b": count("b")})
    return df.withColumn("keep_id", F.when(F.col("score_a") > F.col("score_b"), F.col("a.track_id")).when(F.col("score_b") > F.col("score_a"), F.col("b.track_id")).otherwise(F.least("a.track_id", "b.track_id")))


def filled_from(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """The kept track of each pair with its gaps filled from the other."""
    a_kept = F.col("keep_id") == F.col("a.track_id")
    pick = lambda f: F.when(a_kept, F.coalesce(f"a.{f}", f"b.{f}")).otherwise(F.coalesce(f"b.{f}", f"a.{f}")).alias(f)
    return pairs.select(F.col("keep_id").alias("track_id"), *(pick(f) for f in fields))


def field_volume(observations: DataFrame) -> DataFrame:
    """Rows and lengths of the values by field, the largest first."""
    size = F.length("value")
    return observations.groupBy("field").agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.round(F.avg(size), 2).alias("mean"), F.max(size).alias("longest")).orderBy(F.desc("total"), "field")


def streams_by_track(matched: DataFrame) -> DataFrame:
    """Streams of all editions of a track."""
    return matched.groupBy("track_id").agg(F.sum("streams").alias("streams"), F.sum("daily").alias("daily"))


def streams_by_album(rows: DataFrame, key: Column) -> DataFrame:
    """Streams by normalised album: first-seen title, catalog ids in order of appearance."""
    item = F.struct("pos", "external_id")
    return rows.withColumn("album_key", key).where("album_key <> ''").groupBy("album_key").agg(F.min_by("album", "pos").alias("album"), F.sum("streams").alias("streams"), F.sum("daily").alias("daily"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["external_id"])), ",").alias("ids"))


def own_albums(tracks: DataFrame, key: Column, least: int = 2) -> DataFrame:
    """Albums of two tracks or more: others are guest appearances."""
    return tracks.withColumn("album_key", key).where("album_key <> ''").groupBy("album_key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def views_by_track(views: DataFrame) -> DataFrame:
    """Views of a track's distinct videos, the last value of each."""
    last = views.groupBy("track_id", "video_id").agg(F.max_by("views", "pos").alias("views"))
    return last.groupBy("track_id").agg(F.sum("views").alias("views"), F.count("*").alias("videos"))


def album_rollup(tracks: DataFrame, albums: DataFrame | None = None, overrides: DataFrame | None = None, key=F.lower) -> DataFrame:
    """One row a group: normalised album; tracks without album are featurings or singles; ``overrides`` (album_key, target)
    move whole albums there; an album whose only track is a featuring goes to featurings.

    Gives group, title (first of its spellings), n, disabled, credits, with_lyrics, seconds, first_release and streams (the
    album table's, else the tracks' sum; 0 is null). The rank is 0 for albums, 1 featurings, 2 singles. The two catch-all
    groups are aggregated with partial sums, so their size does no harm."""
    album = F.trim(F.coalesce("album", F.lit("")))
    df = tracks.withColumns({"__album": album, "__key": F.when(album == "", F.when(F.coalesce("is_featuring", F.lit(False)), FEATURINGS).otherwise(SINGLES)).otherwise(key(album)), "__none": album == ""})
    if overrides is not None:
        o = overrides.select(F.col("album_key").alias("__key"), F.col("target").alias("__target")).distinct()
        df = df.join(o, "__key", "left")
    else:
        df = df.withColumn("__target", F.lit(None).cast("string"))
    size = df.where("NOT __none").groupBy("__key").agg(F.count("*").alias("__size"))
    df = df.join(size, "__key", "left")
    lonely = ~F.col("__none") & F.col("__target").isNull() & (F.col("__size") == 1) & F.coalesce("is_featuring", F.lit(False))
    group = F.when(F.col("__target") == "feat", FEATURINGS).when(F.col("__target") == "single", SINGLES).when(lonely, FEATURINGS).otherwise(F.col("__key"))
    df = df.withColumn("group", group)
    catch = F.col("group").isin(FEATURINGS, SINGLES)
    out = df.groupBy("group").agg(
        F.when(F.first(catch), F.first("group")).otherwise(F.min("__album")).alias("title"),
        F.count("*").alias("n"),
        F.count_if(F.coalesce("disabled", F.lit(False))).alias("disabled"),
        F.sum(F.coalesce("credits", F.lit(0))).alias("credits"),
        F.count_if(F.coalesce("has_lyrics", F.lit(False))).alias("with_lyrics"),
        F.sum(F.coalesce("duration", F.lit(0))).alias("seconds"),
        F.min("release_date").alias("first_release"),
        F.sum(F.coalesce("streams", F.lit(0))).alias("__streams"),
    )
    if albums is not None:
        out = out.join(albums.select(F.col("album_key").alias("group"), F.col("streams").alias("__album_streams")), "group", "left")
    else:
        out = out.withColumn("__album_streams", F.lit(None).cast("bigint"))
    return out.withColumns({"streams": F.nullif(F.coalesce(F.nullif("__album_streams", F.lit(0)), "__streams"), F.lit(0)), "rank": F.when(F.col("group") == SINGLES, 2).when(F.col("group") == FEATURINGS, 1).otherwise(0)}).drop("__streams", "__album_streams")


def album_list(tracks: DataFrame, key: Column) -> DataFrame:
    """Distinct albums by normalised title under the least of their spellings."""
    return tracks.withColumn("album_key", key).where("album_key <> ''").groupBy("album_key").agg(F.min("album").alias("album")).orderBy("album")


#: Credits whose members one task keeps apart, about; tracks are dealt out so that this doesn't grow with the input.
CREDITS = 1_000_000


def members(credits: DataFrame, key: Column, roles: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct (track_id, member) with the member's first-seen name; restricted to some roles if given."""
    df = credits if roles is None else credits.where(F.col("role").isin(*roles))
    df = dealt(df.withColumn("member", key).where("member <> ''"), CREDITS, "track_id")
    return df.groupBy("track_id", "member").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))


def collaboration_nodes(m: DataFrame) -> DataFrame:
    """Members with their first-seen name and number of tracks; those without partners too."""
    return m.groupBy("member").agg(F.min_by("name", "pos").alias("name"), F.count("*").alias("tracks"))


def collaboration_edges(m: DataFrame) -> DataFrame:
    """Pairs of members (a < b) with their number of common tracks.

    The pairs of a track are made within its own row of sorted members, so the join's sort and second shuffle are saved."""
    sets = m.groupBy("track_id").agg(F.sort_array(F.collect_set("member")).alias("s")).where(F.size("s") > 1)
    firsts = sets.select("s", F.posexplode("s").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))


def collaboration_groups(m: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks of exactly the same members: the member set, the number of tracks, their titles in order."""
    sets = m.groupBy("track_id").agg(F.array_join(F.sort_array(F.collect_set("member")), "|").alias("members"))
    return sets.join(tracks.select("track_id", "title"), "track_id").groupBy("members").agg(F.count("*").alias("tracks"), F.array_join(F.sort_array(F.collect_list("title")), "|").alias("titles"))


def node_scale(tracks: Column, most: Column, smallest: float = 1.0, largest: float = 4.0) -> Column:
    """Node size growing with the root of the number of tracks."""
    return smallest + (largest - smallest) * F.sqrt(tracks / most)


def credit_counts(credits: DataFrame) -> DataFrame:
    """music, video, producers and writers of each track."""
    video = is_video_credit(F.col("role"), F.col("role_detail"))
    return credits.groupBy("track_id").agg(F.count_if(~video).alias("music"), F.count_if(video).alias("video"), F.count_if(F.col("role").isin(*PRODUCERS)).alias("producers"), F.count_if(F.col("role").isin(*WRITERS)).alias("writers"))


def has_complete_credits(music: Column, producers: Column, writers: Column) -> Column:
    return (music >= 2) & ((producers > 0) | (writers > 0))


def track_status(df: DataFrame, strict: bool = False) -> Column:
    """disabled, complete or partial. Key 0 and mode 0 count as missing unless ``strict`` or the key's name is there."""
    def there(c: str) -> Column:
        return F.col(c).isNotNull() if strict else F.coalesce(F.col(c) != 0, F.lit(False))

    key = F.coalesce(F.col("musical_key") != "", F.lit(False)) | (there("key") & there("mode"))
    full = F.col("release_date").isNotNull() & (F.coalesce("music_credits", F.lit(0)) > 0) & F.coalesce("has_lyrics", F.lit(False)) & F.coalesce(F.col("bpm") > 0, F.lit(False)) & key & F.coalesce(F.col("duration") > 0, F.lit(False))
    return F.when(F.coalesce("disabled", F.lit(False)), "disabled").when(full, "complete").otherwise("partial")


def display_artist(primary: Column, is_featuring: Column, artist: Column) -> Column:
    return F.when(F.coalesce(is_featuring, F.lit(False)) & F.coalesce(primary != "", F.lit(False)), primary).otherwise(artist)


def featured_list(text: Column, from_credits: Column) -> Column:
    """Names of a comma-separated field, else those of featuring credits."""
    names = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(F.size(names) > 0, F.lit(False)), names).otherwise(F.coalesce(from_credits, F.array().cast("array<string>")))


def needs_refresh(df: DataFrame) -> Column:
    """Whether a known track must be asked for again: id, release date, album or credits are missing."""
    return F.col("genius_id").isNull() | F.col("release_date").isNull() | F.coalesce(F.col("album") == "", F.lit(True)) | (F.coalesce("credits", F.lit(0)) == 0)


def excluded(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """``df`` without the rows of a set of ids (deleted or disabled ones)."""
    return df.join(ids.select(on).distinct(), on, "left_anti")


def video_kind_report(tracks: DataFrame, views: DataFrame) -> DataFrame:
    """Tracks and refreshed view counts by kind of video."""
    return tracks.join(views.select("video_id", "views"), "video_id", "left").groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("tracks"), F.count("views").alias("updated"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"))


def table_statistics(rows: DataFrame) -> DataFrame:
    """total, artists and last date of a certification table in one row."""
    return rows.agg(F.count("*").alias("total"), F.count_distinct("artist").alias("artists"), F.max("date").alias("last_date"))


def top_counts(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def sort_tracks(df: DataFrame, column: Column, descending: bool = False, missing=None) -> DataFrame:
    """Order of a listing: a missing value is ``missing`` (least if none is given), then title and id."""
    value = column if missing is None else F.coalesce(column, F.lit(missing))
    return df.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_first(), "title", "track_id")


#: Ranks of the French levels by their exact names, and the order of statuses, in listings.
FRENCH_RANKS = {name.title(): rank for name, rank in LEVEL_RANKS.items() if name not in ("diamond", "platinum", "gold")}
STATUS_ORDER = ("complete", "partial", "disabled")


def listing_key(column: str) -> Column:
    """What a listing is sorted by, for each of its eleven columns; ascending, without nulls.

    Texts are compared by Spark's collation that knows neither case nor accents, missing ones as ''. Missing dates come ahead
    of all, missing tempi, durations and credits are 0, missing streams -1. Certifications go by their first one's rank, unknown
    ones behind the known, tracks without any last; lyrics by whether there are any and then whether they are timed."""
    text = lambda c: F.collate(F.coalesce(c, F.lit("")), "UNICODE_CI_AI")
    level = F.col("certification")
    keys = {
        "title": lambda: text(F.col("title")),
        "album": lambda: text(F.col("album")),
        "artist": lambda: text(F.coalesce(F.nullif(F.col("primary_artist"), F.lit("")), F.col("artist"))),
        "release_date": lambda: F.coalesce(F.to_date(flexible_date(F.col("release_date"))), F.to_date(F.lit("0001-01-01"))),
        "credits": lambda: F.coalesce("credits", F.lit(0)),
        "lyrics": lambda: F.struct(F.coalesce("has_lyrics", F.lit(False)).alias("a"), F.coalesce("synced", F.lit(False)).alias("b")),
        "bpm": lambda: F.coalesce("bpm", F.lit(0)),
        "duration": lambda: F.coalesce(duration_seconds(F.col("duration")), F.lit(0)),
        "certification": lambda: F.when(level.isNull(), 12).otherwise(F.coalesce(*(F.when(level == name, rank) for name, rank in FRENCH_RANKS.items()), F.lit(11))),
        "streams": lambda: F.coalesce(total_estimate(F.col("spotify_streams"), F.col("ytm_streams")), F.lit(-1)),
        "status": lambda: F.coalesce(*(F.when(F.col("status") == s, k + 1) for k, s in enumerate(STATUS_ORDER)), F.lit(4)),
    }
    return keys[column]()


LISTING = ("title", "album", "artist", "release_date", "credits", "lyrics", "bpm", "duration", "certification", "streams", "status")


def listing(tracks: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """``tracks`` sorted by one of ``LISTING``'s columns; equals keep their order (``pos``) either way."""
    key = listing_key(column)
    return tracks.orderBy(key.desc() if descending else key.asc(), "pos")


def newest_first(df: DataFrame, date: str) -> DataFrame:
    return df.orderBy(flexible_date(F.col(date)).desc_nulls_last())
