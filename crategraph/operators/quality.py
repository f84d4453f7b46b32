"""Audits: coverage in time, validation reports, integrity, worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crategraph.shared import settle


def month_calendar(rows: DataFrame, date: str, by: list[str], until: Column | None = None) -> DataFrame:
    """(by, month, n) for every month from the first to the last of each key (or to ``until``), empty ones too."""
    month = F.date_trunc("month", date).cast("date")
    seen = rows.where(F.col(date).isNotNull()).groupBy(*by, month.alias("month")).agg(F.count("*").alias("n"))
    span = seen.groupBy(*by).agg(F.min("month").alias("first"), F.max("month").alias("last"))
    every = span.select(*by, F.explode(F.sequence("first", F.coalesce(until, F.col("last")) if until is not None else F.col("last"), F.expr("interval 1 month"))).alias("month"))
    return every.join(seen, [*by, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def month_gaps(rows: DataFrame, date: str, by: list[str], low: int = 3) -> DataFrame:
    """Months of ``month_calendar`` that are empty ('gap') or have fewer than ``low`` rows ('low')."""
    return month_calendar(rows, date, by).where(F.col("n") < low).withColumn("kind", F.when(F.col("n") == 0, "gap").otherwise("low"))


def year_coverage(rows: DataFrame, date: str, active: int = 1) -> DataFrame:
    """(year, n, missing, thin): a year without rows next to one with ``active`` or more is missing, one with under half of
    the mean count is thin. Years are few, so their window is small whatever the table's size."""
    seen = rows.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"))
    span = seen.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL")
    years = span.select(F.explode(F.sequence("a", "b")).alias("year")).join(seen, "year", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.orderBy("year")
    near = F.greatest(F.coalesce(F.lag("n").over(w), F.lit(0)), F.coalesce(F.lead("n").over(w), F.lit(0)))
    mean = F.avg("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return years.select("year", "n", ((F.col("n") == 0) & (near >= active)).alias("missing"), (F.col("n") < mean * 0.5).alias("thin"))


#: Rows from which a year's months are all expected, and under which a month of a recent year is low.
FULL_YEAR, LOW_MONTH = 12, 3


def coverage(rows: DataFrame, date: str, today: Column, recent: tuple[int, ...], only: tuple[int, ...] | None = None) -> DataFrame:
    """(kind, year, month, n) of a list's coverage in time, from one pass over its rows.

    'year': each year from the first to the last, month null; 'missing': a year without rows next to one with some; 'gap': a
    month without rows, of years with 12 rows or more (of the years ``only``, if given); 'low': a month of ``recent`` years with
    one or two. Months after ``today``'s don't count. 'fresh': days from the last date to ``today``, in n."""
    day = F.col(date)
    seen = rows.where(day.isNotNull()).groupBy(F.year(day).alias("year"), F.month(day).alias("month")).agg(F.count("*").alias("n"), F.max(day).alias("last"))
    seen = settle(seen)  # a row for each month
    span = seen.agg(F.min("year").alias("a"), F.max("year").alias("b"), F.max("last").alias("last")).where("a IS NOT NULL")
    per_year = seen.groupBy("year").agg(F.sum("n").alias("n"))
    years = span.select(F.explode(F.sequence("a", "b")).alias("year")).join(per_year, "year", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.orderBy("year")  # years are few
    near = F.coalesce(F.lag("n").over(w), F.lit(0)) + F.coalesce(F.lead("n").over(w), F.lit(0))
    none = F.lit(None).cast("int").alias("month")
    said = lambda kind, df, n=F.col("n"): df.select(F.lit(kind).alias("kind"), "year", "month" if "month" in df.columns else none, n.cast("bigint").alias("n"))
    missing = years.withColumn("near", near).where((F.col("n") == 0) & (F.col("near") > 0))
    wanted = [F.lit(y) for y in {*recent, *(only or ())}]
    extra = rows.sparkSession.range(1).select(F.explode(F.array(*wanted)).alias("year")) if wanted else years.select("year").limit(0)
    every = years.select("year").union(extra).distinct().join(per_year.select("year", F.col("n").alias("of_year")), "year", "left")
    months = every.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).where(F.make_date("year", "month", F.lit(1)) <= today)
    months = months.join(seen.select("year", "month", "n"), ["year", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.lit(True) & span.select(F.count("*") > 0).scalar())
    scanned = F.col("year").isin(*only) if only is not None else F.col("of_year") >= FULL_YEAR
    fresh = span.select(F.lit("fresh").alias("kind"), F.lit(None).cast("int").alias("year"), none, F.datediff(today, "last").cast("bigint").alias("n"))
    return said("year", years).unionAll(said("missing", missing)).unionAll(said("gap", months.where(scanned & (F.col("n") == 0)))).unionAll(said("low", months.where(F.col("year").isin(*recent) & F.col("n").between(1, LOW_MONTH - 1)))).unionAll(fresh)


def global_statistics(artists: DataFrame, tracks: DataFrame, credits: DataFrame, errors: DataFrame, now: Column, roles: tuple[str, str] = ("Producer", "Writer")) -> DataFrame:
    """(name, n): artists, tracks and credits, tracks credited with both ``roles``, errors of the last day before ``now``.

    The surveyed system reports 1 for any number of complete tracks; here they are counted."""
    tagged = [artists.select(F.lit("artists").alias("name")), tracks.select(F.lit("tracks").alias("name"))]
    whole = tagged[0].unionAll(tagged[1]).groupBy("name").agg(F.count("*").alias("n"))
    # one scan of the credits for both of their figures: roles of a track first, then both sums
    own = credits.groupBy("track_id").agg(F.count("*").alias("c"), F.size(F.collect_set(F.when(F.col("role").isin(*roles), F.col("role")))).alias("r"))
    known = own.join(tracks.select("track_id").distinct().withColumn("there", F.lit(True)), "track_id", "left")
    both = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("credits"), F.count_if((F.col("r") == 2) & F.col("there")).alias("complete")).selectExpr("stack(2, 'credits', credits, 'complete tracks', complete) AS (name, n)")
    recent = errors.agg(F.count_if(F.col("error_time") > now - F.expr("INTERVAL 1 DAY")).alias("n")).select(F.lit("recent errors").alias("name"), "n")
    known_names = artists.sparkSession.sql("SELECT * FROM VALUES ('artists'), ('tracks') AS t(name)")
    return known_names.join(whole, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n")).unionAll(both).unionAll(recent)


def monthly_summary(rows: DataFrame, date: str, by: list[str], low: int = 5) -> DataFrame:
    """Months, empty and low ones and the mean count of each key."""
    return month_calendar(rows, date, by).groupBy(*by).agg(F.count("*").alias("months"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if(F.col("n").between(1, low - 1)).alias("low"), F.round(F.avg("n"), 4).alias("mean"))


def validation_report(df: DataFrame, critical: list[str], key: list[Column], dates: list[str], known: dict[str, list[str]], text: list[str]) -> DataFrame:
    """One row of counts over a table: empty critical fields, repeats of the key, unreadable ISO dates, values outside the
    known ones and those that differ only in case, question marks within words, tabs; and ``valid`` if all but the last two
    kinds are 0. A pass over the rows and one over the keys."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count_if(blank(c)).alias(f"empty_{c}") for c in critical]
    aggs += [F.count_if(~blank(c) & F.try_to_timestamp(F.col(c).cast("string")).isNull()).alias(f"bad_{c}") for c in dates]
    for c, values in known.items():
        within = F.col(c).isin(*values)
        cased = F.lower(F.trim(c)).isin(*(v.lower() for v in values))
        aggs += [F.count_if(~blank(c) & ~cased).alias(f"unknown_{c}"), F.count_if(cased & ~within).alias(f"case_{c}")]
    any_text = F.concat_ws("\n", *text)
    aggs += [F.count_if(any_text.rlike(r"\w\?\w")).alias("marks"), F.count_if(any_text.contains("\t")).alias("tabs")]
    report = df.agg(*aggs)
    repeats = df.groupBy(*(k.alias(f"k{i}") for i, k in enumerate(key))).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))
    report = report.withColumn("repeats", repeats.scalar())
    bad = [c for c in report.columns if c.startswith(("empty_", "bad_", "unknown_")) or c == "repeats"]
    return report.withColumn("valid", sum((F.col(c) for c in bad), F.lit(0)) == 0)


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent."""
    p = parents.select(F.col(parent_key).alias("__p"))
    return children.join(p, children[child_key] == p["__p"], "left_anti")


def integrity(tracks: DataFrame, observations: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Counts of observations of no track, of unknown fields, and of tracks whose column is null though its field was observed."""
    lost = orphans(observations, tracks, "track_id", "track_id").agg(F.count("*").alias("n")).select(F.lit("orphans").alias("check"), "n")
    odd = observations.where(~F.col("field").isin(*fields)).agg(F.count("*").alias("n")).select(F.lit("unknown fields").alias("check"), "n")
    out = lost.unionAll(odd)
    seen = observations.where(F.col("field").isin(*fields)).groupBy("track_id").agg(F.collect_set("field").alias("fields"))
    both = tracks.join(seen, "track_id")
    holes = both.agg(*(F.count_if(F.array_contains("fields", f) & F.col(c).isNull()).alias(f) for f, c in fields.items()))
    return out.unionAll(holes.select(F.explode(F.array(*(F.struct(F.lit(f"empty {f}").alias("check"), F.col(f).alias("n")) for f in fields))).alias("r")).select("r.check", "r.n"))


def missing_worklist(tracks: DataFrame, observations: DataFrame, fields: list[str]) -> DataFrame:
    """Tracks with the fields that no source has given yet."""
    seen = observations.groupBy("track_id").agg(F.collect_set("field").alias("have"))
    df = tracks.join(seen, "track_id", "left")
    have = F.coalesce("have", F.array().cast("array<string>"))
    return df.withColumn("missing", F.array_join(F.filter(F.array(*(F.lit(f) for f in fields)), lambda f: ~F.array_contains(have, f)), ",")).where("missing <> ''").drop("have")


def freshness(rows: DataFrame, date: str, today: Column) -> DataFrame:
    """Rows, last date and days since."""
    return rows.agg(F.count("*").alias("rows"), F.max(date).alias("last"), F.datediff(today, F.max(date)).alias("days"))


def refresh_windows(rows: DataFrame, date: str, today: Column, days: int = 30) -> DataFrame:
    """Ranges of at most ``days`` days from the last date to today, for catching up."""
    last = rows.agg(F.max(date).cast("date").alias("last")).where("last IS NOT NULL")
    starts = last.select(F.explode(F.sequence(F.col("last"), today.cast("date"), F.expr(f"interval {days} days"))).alias("start"))
    return starts.select("start", F.least(F.date_add("start", days), today.cast("date")).alias("end")).where("start < end OR start = end")


def by_tempo(songs: DataFrame, bpm: int, limit: int = 50) -> DataFrame:
    """Songs of a tempo; arguments outside 40 to 220, or over 250 rows, are refused."""
    if not 40 <= bpm <= 220 or not 0 < limit <= 250:
        raise ValueError("tempo must be 40 to 220 and the limit 1 to 250")
    return songs.where(F.col("bpm") == bpm).orderBy("song_id").limit(limit)
