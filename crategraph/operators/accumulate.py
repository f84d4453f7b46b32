"""Raw feeds to clean tables, upserts and merges. Parquet has no MERGE: every operator gives the new version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crategraph.functions import catalog, parse
from crategraph.functions.text import restore_marks, squeeze
from crategraph.shared import settle


def keep_first(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row by ``order`` of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def union_distinct(base: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, exact repeats once."""
    return base.unionByName(new, allowMissingColumns=True).distinct()


def history_lines(history: DataFrame, new: DataFrame, line: str = "line") -> DataFrame:
    """Stripped lines of both with ``added`` for those that the history doesn't have; empty ones dropped."""
    rows = lambda df, added: df.select(F.trim(line).alias(line), F.lit(added).alias("added")).where(F.col(line) != "")
    return rows(history, False).unionAll(rows(new, True)).groupBy(line).agg(F.bool_and("added").alias("added"))


def new_rows(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known yet; nulls are values of the key."""
    k = known.select(*(F.col(c).alias(f"__{c}") for c in keys)).distinct()
    on = None
    for c in keys:
        eq = incoming[c].eqNullSafe(k[f"__{c}"])
        on = eq if on is None else on & eq
    return incoming.join(k, on, "left_anti")


def clean_belgian(df: DataFrame, position: str = "pos") -> DataFrame:
    """artist, title, category, certification_level, certification_date: blanks trimmed, first row of each key (artist and
    title in capitals), empty levels dropped where the same certification has a level."""
    keys = ["artist", "title", "category", "certification_level", "certification_date"]
    df = df.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in keys})
    upper = [F.upper("artist"), F.upper("title")]
    df = keep_first(df, [*upper, *(F.col(c) for c in keys[2:])], position)
    filled = F.max((F.col("certification_level") != "").cast("int")).over(Window.partitionBy(*upper, "category", "certification_date"))
    return df.withColumn("__filled", filled).where("certification_level <> '' OR __filled = 0").drop("__filled")


def clean_american(df: DataFrame, position: str = "pos") -> DataFrame:
    """Artist, Title, Certification_Type, Certification_Date, Format_Type: rows without artist or title dropped, formats by
    their usual name, first row of each normalised key."""
    formats = {"SINGLE": "Single", "SINGLES": "Single", "ALBUM": "Album", "ALBUMS": "Album"}
    df = df.where((F.trim("Artist") != "") & (F.trim("Title") != ""))
    named = F.coalesce(catalog.lookup(formats, F.upper(F.trim("Format_Type"))), F.coalesce("Format_Type", F.lit("")))
    df = df.withColumn("Format_Type", named)
    upper = lambda c: F.upper(squeeze(F.coalesce(c, F.lit(""))))
    keys = [upper(F.col("Artist")), upper(F.col("Title")), upper(F.col("Format_Type")), upper(catalog.plain_us_level(F.col("Certification_Type"))), parse.iso_date(F.col("Certification_Date"))]
    return keep_first(df, keys, position)


def flatten_history(df: DataFrame) -> DataFrame:
    """One row for each entry of ``history`` (array<struct<level, date>>) that has a level, its date or else the record's; a
    record without such entries is its own row."""
    entries = F.filter(F.coalesce("history", F.array().cast("array<struct<level:string,date:string>>")), lambda e: F.trim(F.coalesce(e["level"], F.lit(""))) != "")
    df = df.withColumn("__entry", F.explode_outer(F.when(F.size(entries) > 0, entries)))
    level = F.when(F.col("__entry").isNotNull(), F.col("__entry.level")).otherwise(F.col("level"))
    date = F.when(F.col("__entry").isNotNull(), F.coalesce(F.nullif("__entry.date", F.lit("")), "date")).otherwise(F.col("date"))
    return df.withColumns({"level": level, "date": date}).drop("__entry", "history")


def canonical_french(df: DataFrame) -> DataFrame:
    """Blanks squeezed, unknown levels dropped, categories by name with Singles as default."""
    df = df.withColumns({c: squeeze(F.coalesce(c, F.lit(""))) for c, t in df.dtypes if t == "string"})
    return df.withColumns({"level": catalog.level_name(F.col("level")), "category": catalog.category_name(F.col("category"))}).where("level IS NOT NULL")


def accumulate(base: DataFrame, new: DataFrame, keys: list[str], position: str = "pos", latest: str = "certification_date") -> DataFrame:
    """Both feeds by key: the first row's fields (base before new, each by position) but the latest date."""
    both = base.withColumn("__feed", F.lit(0)).unionByName(new.withColumn("__feed", F.lit(1)))
    rest = [c for c in base.columns if c not in (*keys, latest)]
    out = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("__feed", position)).alias("__row"), F.max(latest).alias(latest))
    return out.select(*(F.col(f"__row.{c}").alias(c) if c in rest else F.col(c) for c in base.columns))


def clean_with_report(df: DataFrame, critical: tuple[str, ...] = ("artist", "title", "level", "date")) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows and a one-row report: blanks squeezed, lost marks restored, rows with an empty critical field dropped,
    categories and levels recased, repeats on (artist, title, category, level, date) dropped. Rows flagged ``odd`` (of a
    wrong number of fields) pass untouched."""
    text = [c for c, t in df.dtypes if t == "string"]
    squeezed = df.withColumns({f"__s_{c}": squeeze(F.coalesce(c, F.lit(""))) for c in text})
    restored = squeezed.withColumns({f"__r_{c}": restore_marks(F.col(f"__s_{c}")) for c in text})
    recase = {"category": F.coalesce(catalog.lookup(catalog.CATEGORIES, F.upper("__r_category")), F.col("__r_category")), "level": F.coalesce(catalog.level_name(F.col("__r_level")), F.col("__r_level"))}
    value = {c: F.when(F.col("odd"), F.col(c)).otherwise(recase.get(c, F.col(f"__r_{c}"))) for c in text}
    marks = sum((F.length(f"__s_{c}") - F.length(F.translate(f"__s_{c}", "?", "")) - F.length(f"__r_{c}") + F.length(F.translate(f"__r_{c}", "?", "")) for c in text), F.lit(0))
    flags = {
        "__blanks": ~F.col("odd") & sum((F.when(F.coalesce(c, F.lit("")) != F.col(f"__s_{c}"), 1).otherwise(0) for c in text), F.lit(0)).cast("boolean"),
        "__marks": F.when(F.col("odd"), 0).otherwise(marks),
        "__empty": ~F.col("odd") & F.exists(F.array(*(F.col(f"__s_{c}") for c in critical)), lambda x: x == ""),
    }
    df = restored.withColumns(flags).withColumns(value).drop(*(f"__{k}_{c}" for c in text for k in "sr"))
    order = Window.partitionBy(F.lower("artist"), F.lower("title"), "category", "level", "date", "odd", "__empty").orderBy("pos")
    df = df.withColumn("__n", F.when(F.col("odd") | F.col("__empty"), 1).otherwise(F.row_number().over(order)))
    report = df.agg(F.count("*").alias("rows"), F.count_if("__blanks").alias("blanks"), F.sum("__marks").alias("marks"), F.count_if("__empty").alias("empty"), F.count_if(F.col("__n") > 1).alias("repeats"))
    return df.where("__n = 1 AND NOT __empty").drop("__blanks", "__marks", "__empty", "__n"), report


def _order(new: DataFrame, order: str | None) -> Column:
    """Order in which rows of a feed are applied; without an order column that of all their values."""
    return F.struct(*([order] if order else []), *(c for c in sorted(new.columns) if c != order))


def reduced(new: DataFrame, keys: list[str], *, order: str | None = None, overwrite: tuple[str, ...] = (), sticky: tuple[str, ...] = (), insert_only: tuple[str, ...] = (), empty: dict[str, str] | None = None) -> DataFrame:
    """One row for each key of a feed, as if its rows were upserted one after another into nothing."""
    at = _order(new, order)

    def last(c: str) -> Column:
        value = F.nullif(F.col(c), F.lit(empty[c])) if empty and c in empty else F.col(c)
        if c in overwrite:
            return F.max_by(c, at)
        if c in sticky:
            return F.bool_or(c)
        return F.min_by(c, at) if c in insert_only else F.max_by(value, F.when(value.isNotNull(), at))

    values = [last(c).alias(c) for c in new.columns if c not in keys]
    return new.groupBy(*keys).agg(*values) if values else new.select(*keys).distinct()


def upsert(base: DataFrame, new: DataFrame, keys: list[str], *, order: str | None = None, overwrite: tuple[str, ...] = (), sticky: tuple[str, ...] = (), insert_only: tuple[str, ...] = (), empty: dict[str, str] | None = None) -> DataFrame:
    """New values where there are some, else the old: never destroys. ``overwrite`` columns take the new row's value even if
    null, ``sticky`` booleans stay true, ``insert_only`` columns keep the old row's value, a new value equal to ``empty``'s
    counts as none. Rows of one key in ``new`` are applied one after another, by ``order``; null keys are keys like others."""
    rules = {"overwrite": overwrite, "sticky": sticky, "insert_only": insert_only, "empty": empty}
    b = base.withColumn("__old", F.lit(True)).alias("b")
    n = reduced(new, keys, order=order, **rules).withColumn("__new", F.lit(True)).alias("n")
    on = None
    for k in keys:
        eq = F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = eq if on is None else on & eq
    fresh, old = F.col("n.__new").isNotNull(), F.col("b.__old").isNotNull()
    out = []
    for c in base.columns:
        was, now = F.col(f"b.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in keys:
            value = F.coalesce(was, now)
        elif c in overwrite:
            value = F.when(fresh, now).otherwise(was)
        elif c in sticky:
            value = F.coalesce(was, F.lit(False)) | F.coalesce(now, F.lit(False))
        elif c in insert_only:
            value = F.when(old, was).otherwise(now)
        else:
            value = F.coalesce(now, was)
        out.append(value.alias(c))
    return b.join(n, on, "full_outer").select(*out)


BUCKET = "bucket__"


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """``df`` with its bucket, dealt out so that a bucket is one task's and one file."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).repartition(BUCKET)


def create_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write a table in directories by a hash of its keys; ``buckets`` should leave each some hundred MB."""
    _bucketed(df, keys, buckets).write.partitionBy(BUCKET).parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert_bucketed(spark: SparkSession, path: str, new: DataFrame, keys: list[str], buckets: int, **rules) -> list[int]:
    """``upsert`` into a table of ``create_bucketed``; the buckets that the feed has keys of, which alone are read and written.

    The merged buckets are settled first, then they replace the old ones directory by directory: a task that fails in
    between is run again on settled rows, and running the feed once more changes nothing."""
    feed = settle(_bucketed(new, keys, buckets))
    touched = sorted(r[0] for r in feed.select(BUCKET).distinct().collect())  # ``buckets`` numbers at most
    if touched:
        base = spark.read.parquet(path)
        columns = [c for c in base.columns if c != BUCKET]
        merged = upsert(base.where(F.col(BUCKET).isin(touched)).select(*columns), feed.drop(BUCKET), keys, **rules)
        settle(_bucketed(merged, keys, buckets)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, settled, with ``__n`` from 1 in the given order: sorted by ranges and numbered within each, on top of what the
    ranges before hold, however they were partitioned."""
    ranged = settle(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = ranged.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "__range").withColumn("__n", F.col("__before") + within).drop("__range", "__before")


def replace_children(base: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Rows of parents that ``new`` speaks of are replaced by its rows."""
    return base.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def upsert_observations(base: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("track_id", "field", "source")) -> DataFrame:
    """Last value, confidence and time of each (track, field, source); the order of first arrival stays."""
    both = base.withColumn("__b", F.lit(0)).unionByName(new.withColumn("__b", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__b", "obs_id")).alias("__row"), F.min_by("obs_id", F.struct("__b", "obs_id")).alias("__first"))
    return last.select(*(F.col("__first").alias(c) if c == "obs_id" else F.col(f"__row.{c}").alias(c) if c in rest else F.col(c) for c in base.columns))


def insert_or_ignore(base: DataFrame, new: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows of a new key are added with the next ids, in the order of the key; of rows of one key the least stays.

    New rows are numbered by ranges of the key."""
    top = base.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    first = Window.partitionBy(key).orderBy(*(c for c in new.columns if c != key), key)
    fresh = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").join(base.select(key), key, "left_anti")
    return base.unionByName(numbered(fresh, key).withColumn(id_col, F.col("__n") + top.scalar()).drop("__n"), allowMissingColumns=True)


def guarded_fill(base: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Fill ``column`` where it is empty; what is there stays."""
    n = new.select(key, F.col(column).alias("__new"))
    return base.join(n, key, "left").withColumn(column, F.coalesce(F.nullif(column, F.lit("")), "__new")).select(*base.columns)


def guarded_url(base: DataFrame, new: DataFrame, key: str, url: str = "youtube_url", source: str = "youtube_url_source") -> DataFrame:
    """A url found by search never replaces one set by hand or given by the lyrics site; those always replace."""
    n = new.select(key, F.col(url).alias("__url"), F.col(source).alias("__source"))
    df = base.join(n, key, "left")
    strong = lambda c: F.coalesce(F.col(c).isin("manual", "genius_media"), F.lit(False))
    take = F.col("__url").isNotNull() & (strong("__source") | ~strong(source))
    df = df.withColumn("__take", take)
    return df.withColumns({url: F.when(F.col("__take"), F.col("__url")).otherwise(F.col(url)), source: F.when(F.col("__take"), F.col("__source")).otherwise(F.col(source))}).select(*base.columns)


def rename(base: DataFrame, changes: DataFrame, key: str, column: str, within: str) -> DataFrame:
    """``base`` with ``column`` renamed where the new name is free within its owner; ``renamed`` tells (null: not asked)."""
    wanted = changes.select(key, F.col(column).alias("__new"))
    asked = base.join(wanted, key, "left")
    taken = base.select(F.col(within).alias("__w"), F.col(column).alias("__c"), F.col(key).alias("__k"))
    on = (asked[within] == taken["__w"]) & (asked["__new"] == taken["__c"]) & (asked[key] != taken["__k"])
    clash = asked.join(taken, on, "left_semi").select(key, F.lit(True).alias("__clash"))
    df = asked.join(clash, key, "left")
    ok = F.when(F.col("__new").isNotNull(), F.col("__clash").isNull())
    return df.withColumn("renamed", ok).withColumn(column, F.when(F.col("renamed"), F.col("__new")).otherwise(F.col(column))).select(*base.columns, "renamed")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows that belong to the deleted ids."""
    return {name: df.join(ids.select(F.col(ids.columns[0]).alias(keys[name])).distinct(), keys[name], "left_anti") if name in keys else df for name, df in tables.items()}


def snapshot_listeners(artists: DataFrame, history: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artists with the newest listener counts (nulls keep the old ones), and the history with one more row each."""
    counts = new.select("artist_id", "spotify_listeners", "ytm_listeners")
    updated = upsert(artists, counts, ["artist_id"])
    total = catalog.total_estimate(F.col("spotify_listeners"), F.col("ytm_listeners"))
    return updated, history.unionByName(new.withColumn("total_estimated", total).select(*history.columns))


def write_through(tracks: DataFrame, observations: DataFrame, counters: DataFrame, column: str, source: str) -> tuple[DataFrame, DataFrame]:
    """A counter goes into its column and becomes an observation of its source. New observations are numbered behind the
    known ones, in the order of their tracks."""
    updated = upsert(tracks, counters.select("track_id", column), ["track_id"])
    top = observations.agg(F.coalesce(F.max("obs_id"), F.lit(0)).alias("__top"))
    rows = numbered(counters.select("track_id", F.col(column).cast("string").alias("value")), "track_id", "value")
    rows = rows.select("track_id", F.lit(column).alias("field"), "value", F.lit(source).alias("source"), F.lit(None).cast("double").alias("confidence"), (F.col("__n") + top.scalar()).cast("bigint").alias("obs_id"))
    return updated, upsert_observations(observations, rows.select(*observations.columns))


def pin_channel(artists: DataFrame, pins: DataFrame) -> DataFrame:
    """Channel and its source ('manual' or 'inferred'); a null channel clears both."""
    p = pins.select("artist_id", F.col("channel").alias("__c"), F.col("source").alias("__s"), F.lit(True).alias("__set"))
    df = artists.join(p, "artist_id", "left")
    return df.withColumns({"ytm_channel_id": F.when(F.col("__set"), F.col("__c")).otherwise(F.col("ytm_channel_id")), "ytm_channel_source": F.when(F.col("__set"), F.when(F.col("__c").isNotNull(), F.col("__s"))).otherwise(F.col("ytm_channel_source"))}).select(*artists.columns)


def forget_fields(observations: DataFrame, gone: DataFrame, by: str = "track_id") -> DataFrame:
    """Observations without those of the (track, field) pairs to be asked again."""
    return observations.join(gone.select(by, "field").distinct(), [by, "field"], "left_anti")


def reset_source(credits: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Credits of one source are replaced; those of others stay."""
    return credits.where(~F.col("source").eqNullSafe(F.lit(source))).unionByName(new.where(F.col("source") == source))


def merge_entities(credits: DataFrame, observations: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Credits and observations after tracks (``drop_id`` into ``keep_id``) were merged. A moved credit equal in name, role and
    detail (null equals null) to one that is there is dropped, so is a moved observation whose (field, source) is known."""
    m = merges.select(F.col("drop_id").alias("__drop"), F.col("keep_id").alias("__keep"))

    def moved(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
        r = df.join(m, df["track_id"] == m["__drop"], "left").withColumns({"__moved": F.col("__keep").isNotNull().cast("int")})
        r = r.withColumn("track_id", F.coalesce("__keep", "track_id"))
        first = Window.partitionBy("track_id", *keys)
        r = r.withColumn("__own", F.min("__moved").over(first)).withColumn("__n", F.row_number().over(first.orderBy("__moved", order)))
        return r.where("__moved = 0 OR (__own = 1 AND __n = 1)").select(*df.columns)

    c = moved(credits, [F.col("name"), F.col("role"), F.coalesce("role_detail", F.lit(""))], "credit_id")
    return c, moved(observations, [F.col("field"), F.col("source")], "obs_id")


def backfill(tracks: DataFrame, observations: DataFrame, fields: tuple[str, ...], source: str = "legacy") -> DataFrame:
    """Observations plus one of source 'legacy' for each filled column that no observation covers."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    rows = tracks.select("track_id", pairs.alias("p")).select("track_id", "p.field", "p.value").where("value IS NOT NULL AND value <> ''")
    rows = rows.join(observations.select("track_id", "field").distinct(), ["track_id", "field"], "left_anti")
    return observations.unionByName(rows.withColumn("source", F.lit(source)), allowMissingColumns=True)


def backfill_keys(tracks: DataFrame, observations: DataFrame, source: str = "legacy") -> DataFrame:
    """Observations plus pitch class and mode read back out of the French key of tracks that have neither; a key that can't be
    read gives none."""
    known = observations.where(F.col("field").isin("key", "mode")).select("track_id").distinct()
    orphans = tracks.where(F.coalesce("musical_key", F.lit("")) != "").join(known, "track_id", "left_anti")
    # generated, so that the key is read once a row however often its parts are used
    parts = orphans.select("track_id", F.explode(F.array_compact(F.array(catalog.split_key(F.col("musical_key"))))).alias("k"))
    rows = parts.selectExpr("track_id", "stack(2, 'key', cast(k.pitch AS string), 'mode', cast(k.mode AS string)) AS (field, value)")
    return observations.unionByName(rows.withColumn("source", F.lit(source)), allowMissingColumns=True)


def without_combined(observations: DataFrame) -> DataFrame:
    """Observations without tempi whose source is several joined by a plus sign."""
    return observations.where(~((F.col("field") == "bpm") & F.coalesce(F.contains("source", F.lit("+")), F.lit(False))))


def health_status(old: DataFrame, new: DataFrame, by: str = "source") -> DataFrame:
    """Newest status of each source; the time it last was ok survives failures."""
    n = new.select(by, F.col("status").alias("__status"), F.col("checked_at").alias("__at"))
    df = old.join(n, by, "full_outer")
    ok = F.when(F.col("__status") == "ok", F.col("__at"))
    return df.select(by, F.coalesce("__status", "status").alias("status"), F.coalesce("__at", "checked_at").alias("checked_at"), F.coalesce(ok, "last_ok").alias("last_ok"))
