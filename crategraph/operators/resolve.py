"""Observations of many sources to one value for each track and field.

Observations are rows (track_id, obs_id, field, value, source, confidence); obs_id carries the order of arrival. Ties that
source ranks leave open go to the earlier arrival. Every operator is one shuffle by track (and field).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from crategraph.functions import parse
from crategraph.functions.catalog import french_key, source_rank
from crategraph.functions.text import line_key

TOLERANCE, HALF_TIME = 3, 90


def sane_tempo(value: Column) -> Column:
    """Rounded half to even, null outside 40 to 220 or if no number."""
    v = F.bround(value.try_cast("double"), 0)
    return F.when(v.between(40, 220), v.cast("int"))


def tempos_agree(a: Column, b: Column, tolerance: int = TOLERANCE) -> Column:
    """Equal within a tolerance, octaves up or down included."""
    return (F.abs(a - b) <= tolerance) | (F.abs(a - 2 * b) <= tolerance) | (F.abs(2 * a - b) <= tolerance)


def tempo_vote(observations: DataFrame, by: str = "track_id") -> DataFrame:
    """bpm, bpm_alt, source and confidence for each track.

    Candidates in order of arrival join the first cluster in which one agrees with them, or open one. The largest cluster
    wins, then the one with the most reliable source, then the first. With two octaves in it the high one is confirmed;
    a lone slow value is doubled; otherwise the most reliable value stands and the other octave is given as alternative.
    One fold over each track's few, ordered candidates; no Python."""
    item = F.struct(F.col("obs_id"), F.col("source"), sane_tempo(F.col("value")).alias("v"), source_rank(F.col("source")).alias("rank"))
    listed = observations.select(by, item.alias("x")).where("x.v IS NOT NULL").groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("items"))
    kind = "array<array<struct<obs_id:bigint,source:string,v:int,rank:int>>>"
    one = F.transform("items", lambda x: F.struct(x["obs_id"].cast("bigint").alias("obs_id"), x["source"].alias("source"), x["v"].alias("v"), x["rank"].alias("rank")))

    def place(clusters: Column, x: Column) -> Column:
        fits = F.transform(clusters, lambda c: F.exists(c, lambda m: tempos_agree(x["v"], m["v"])))
        at = F.array_position(fits, F.lit(True)) - 1
        joined = F.transform(clusters, lambda c, i: F.when(i == at, F.array_append(c, x)).otherwise(c))
        return F.when(at >= 0, joined).otherwise(F.array_append(clusters, F.array(x)))

    df = listed.withColumn("clusters", F.aggregate(one, F.array().cast(kind), place))
    ranked = F.transform("clusters", lambda c, i: F.struct(F.size(c).alias("n"), F.array_max(F.transform(c, lambda m: m["rank"])).alias("r"), (-i).alias("i"), c.alias("c")))
    df = df.withColumn("best", F.array_max(F.transform(ranked, lambda x: F.struct(x["n"], x["r"], x["i"]))))
    df = df.withColumn("c", F.get("clusters", (-F.col("best.i")).cast("int")))
    best_of = lambda c: F.array_max(F.transform(c, lambda m: F.struct(m["rank"].alias("r"), (-m["obs_id"]).alias("o"), m["v"].alias("v"))))["v"]
    low = F.array_min(F.transform("c", lambda m: m["v"]))
    high = F.array_max(F.transform("c", lambda m: m["v"]))
    df = df.withColumns({"lo": low, "hi": high, "n": F.size("c"), "v": best_of(F.col("c")), "top": best_of(F.filter("c", lambda m: m["v"] >= low * 1.5))})
    two = F.col("hi") >= F.col("lo") * 1.5
    slow = (F.col("v") < HALF_TIME) & (F.col("v") * 2 <= 220)
    half = F.floor(F.col("v") / 2).cast("int")
    bpm = F.when(two, F.col("top")).when((F.col("n") < 2) & slow, F.col("v") * 2).otherwise(F.col("v"))
    alt = F.when(two, F.col("lo")).when((F.col("n") < 2) & slow, F.col("v")).when(slow, F.col("v") * 2).otherwise(F.when(half >= 55, half))
    names = F.array_distinct(F.transform(F.array_sort(F.transform("c", lambda m: F.struct((-m["rank"]).alias("r"), m["source"].alias("s")))), lambda x: x["s"]))
    return df.select(by, bpm.alias("bpm"), alt.alias("bpm_alt"), F.array_join(names, "+").alias("source"), F.col("n").alias("confidence"))


def consensus(observations: DataFrame, by: str = "track_id") -> DataFrame:
    """Tracks whose tempo two sources or more agree on: expensive sources need not be asked."""
    return tempo_vote(observations, by).select(by, (F.col("confidence") >= 2).alias("reached"))


def without_legacy(observations: DataFrame, by: tuple[str, ...] = ("track_id", "field")) -> DataFrame:
    """Rows of source 'legacy' only where no other source speaks."""
    real = F.max((F.col("source") != "legacy").cast("int")).over(Window.partitionBy(*by))
    return observations.withColumn("__real", real).where((F.col("source") != "legacy") | (F.col("__real") == 0)).drop("__real")


def most_confident(observations: DataFrame, by: tuple[str, ...] = ("track_id", "field")) -> DataFrame:
    """The row of the highest confidence (null is lowest), then source rank, then earliest arrival."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("confidence"), source_rank(F.col("source")).desc(), "obs_id")
    return observations.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def manual_first(observations: DataFrame, resolved: DataFrame, by: tuple[str, ...] = ("track_id", "field")) -> DataFrame:
    """``resolved`` (by, value, source, confidence) with the first manual observation in its place, if there is one."""
    manual = observations.where("source = 'manual'").groupBy(*by).agg(F.min_by(F.struct("value", "source", "confidence"), "obs_id").alias("m"))
    df = resolved.join(manual, list(by), "full_outer")
    pick = lambda c: F.when(F.col("m").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(c)).alias(c)
    return df.select(*by, pick("value"), pick("source"), pick("confidence"))


def key_and_mode(observations: DataFrame, by: str = "track_id") -> DataFrame:
    """Rows (by, field, value, source, confidence) of 'key' and 'mode'. Only a source with both speaks; the higher confidence
    of the key wins, then source rank, then source name; manual values replace either field on its own."""
    rows = without_legacy(observations.where(F.col("field").isin("key", "mode")), (by, "field"))
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.struct("value", "confidence")), F.when(F.col("field") == f, F.col("obs_id")))
    pairs = rows.groupBy(by, "source").agg(last("key").alias("k"), last("mode").alias("m")).where("k IS NOT NULL AND m IS NOT NULL")
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last("k.confidence"), source_rank(F.col("source")).desc(), "source")
    best = pairs.withColumn("n", F.row_number().over(order)).where("n = 1")
    both = best.select(by, "source", F.explode(F.array(F.struct(F.lit("key").alias("field"), F.col("k.value").alias("value"), F.col("k.confidence").alias("confidence")), F.struct(F.lit("mode").alias("field"), F.col("m.value").alias("value"), F.col("m.confidence").alias("confidence")))).alias("r"))
    return manual_first(rows, both.select(by, "r.field", "r.value", "source", "r.confidence"), (by, "field"))


def tempo(observations: DataFrame, by: str = "track_id") -> DataFrame:
    """bpm, bpm_alt, source, confidence: a valid manual value as it is, else the vote of real sources, else the legacy value
    with its legacy alternative."""
    bpm, alt = observations.where("field = 'bpm'"), observations.where("field = 'bpm_alt'")
    voted = tempo_vote(bpm.where("source <> 'legacy'"), by)
    first = lambda df, s: df.where(F.col("source") == s).groupBy(by).agg(F.min_by(F.struct(sane_tempo(F.col("value")).alias("v"), F.col("confidence")), "obs_id").alias(s))
    real = bpm.where("source <> 'legacy'").groupBy(by).agg(F.count("*").alias("real"))
    other = alt.groupBy(by).agg(F.min_by(sane_tempo(F.col("value")), "obs_id").alias("legacy_alt"))
    df = bpm.select(by).distinct().join(voted, by, "left").join(first(bpm, "manual"), by, "left").join(first(bpm, "legacy"), by, "left").join(real, by, "left").join(other, by, "left")
    manual, legacy = F.col("manual.v").isNotNull(), F.col("real").isNull() & F.col("legacy.v").isNotNull()
    return df.select(
        by,
        F.when(manual, F.col("manual.v")).when(legacy, F.col("legacy.v")).otherwise(F.col("bpm")).alias("bpm"),
        F.when(manual, None).when(legacy, F.col("legacy_alt")).otherwise(F.col("bpm_alt")).alias("bpm_alt"),
        F.when(manual, "manual").when(legacy, "legacy").otherwise(F.col("source")).alias("source"),
        F.when(manual, F.col("manual.confidence")).when(legacy, F.col("legacy.confidence")).otherwise(F.col("confidence").cast("double")).alias("confidence"),
    ).where("bpm IS NOT NULL")


def reconcile(observations: DataFrame, durations: DataFrame | None = None, by: str = "track_id") -> DataFrame:
    """Rows (by, field, value, source, confidence, alt) for all fields: tempo by vote, key and mode as a pair, timed lyrics by
    cross-check, other fields by confidence. A field without evidence has no row."""
    beat = tempo(observations, by).select(by, F.lit("bpm").alias("field"), F.col("bpm").cast("string").alias("value"), "source", "confidence", F.col("bpm_alt").cast("string").alias("alt"))
    key = key_and_mode(observations, by)
    rest = observations.where(~F.col("field").isin("bpm", "bpm_alt", "key", "mode", "lyrics_synced"))
    rest = most_confident(without_legacy(rest, (by, "field")), (by, "field")).select(by, "field", "value", "source", "confidence")
    lyrics = timed_lyrics(observations.where("field = 'lyrics_synced'"), durations, by).select(by, F.lit("lyrics_synced").alias("field"), F.col("lrc").alias("value"), "source", "confidence")
    return beat.unionByName(key.unionByName(rest).unionByName(lyrics), allowMissingColumns=True)


def apply_to_tracks(tracks: DataFrame, resolved: DataFrame, by: str = "track_id") -> DataFrame:
    """``tracks`` with bpm, bpm_alt, key, mode and the French key of what was resolved; what wasn't stays as it is."""
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    wide = resolved.groupBy(by).agg(*(value(f).try_cast("int").alias(f"__{f}") for f in ("bpm", "key", "mode")), F.max(F.when(F.col("field") == "bpm", F.col("alt"))).try_cast("int").alias("__bpm_alt"))
    df = tracks.join(wide, by, "left")
    for f in ("bpm", "bpm_alt", "key", "mode"):
        df = df.withColumn(f, F.coalesce(f"__{f}", f) if f in tracks.columns else F.col(f"__{f}"))
    french = french_key(F.col("key"), F.col("mode"))
    df = df.withColumn("musical_key", F.coalesce(french, "musical_key") if "musical_key" in tracks.columns else french)
    return df.drop("__bpm", "__bpm_alt", "__key", "__mode")


def sync_error(lrc: Column, duration: Column) -> Column:
    """Twice what the last line overshoots the duration by, or what it falls short; null if either is unknown."""
    return _error_of(parse.timed_lines(lrc), duration)


def _error_of(lines: Column, duration: Column) -> Column:
    last = F.try_element_at(lines, F.lit(-1))["at"]
    gap = last - duration.cast("double")
    return F.when(duration > 0, F.when(gap > 0, gap * 2).otherwise(duration.cast("double") - last))


def _keyed(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: F.struct(line_key(x["text"]).alias("k"), x["at"].alias("at"))), lambda x: x["k"] != "")


def line_offsets(a: Column, b: Column) -> Column:
    """Seconds by which each line of ``a`` is later than the first equal line of ``b``, over the lines that both have."""
    right = _keyed(parse.timed_lines(b))
    return _offsets(_keyed(parse.timed_lines(a)), F.transform(right, lambda x: x["k"]), F.transform(right, lambda x: x["at"]))


def _offsets(left: Column, names: Column, times: Column) -> Column:
    at = lambda x: F.get(times, (F.array_position(names, x["k"]) - 1).cast("int"))
    return F.filter(F.transform(left, lambda x: x["at"] - at(x)), lambda x: x.isNotNull())


def cross_check(df: DataFrame, first: str = "lrclib", second: str = "ytmusic", duration: str = "duration") -> DataFrame:
    """``df`` with lrc, source and confidence out of two timed lyrics: 2 if the timelines agree (three common lines or more,
    upper median within 2 s, mean deviation from it within 1.5 s); else the one that fits the duration better, the first at
    a tie or without a duration.

    What is read out of a text is a column of its own ahead of its uses, so that it is read once a row and not once a use, or
    once a line within a lambda."""
    df = df.withColumns({"__a": parse.timed_lines(F.col(first)), "__b": parse.timed_lines(F.col(second))})
    df = df.withColumns({"__l": _keyed(F.col("__a")), "__r": _keyed(F.col("__b"))})
    df = df.withColumns({"__names": F.transform("__r", lambda x: x["k"]), "__times": F.transform("__r", lambda x: x["at"])})
    one, two = F.size("__a") > 0, F.size("__b") > 0
    df = df.withColumn("__offs", F.when(one & two, _offsets(F.col("__l"), F.col("__names"), F.col("__times"))))
    n = F.size("__offs")
    df = df.withColumn("__mid", F.when(n >= 3, F.get(F.array_sort("__offs"), F.floor(n / 2).cast("int"))))
    spread = F.aggregate(F.transform("__offs", lambda x: F.abs(x - F.col("__mid"))), F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    agree = F.coalesce((F.abs("__mid") <= 2.0) & (spread <= 1.5), F.lit(False))
    df = df.withColumns({"__agree": agree, "__one": _error_of(F.col("__a"), F.col(duration)), "__two": _error_of(F.col("__b"), F.col(duration))})
    pick = F.when(one & ~two, 1).when(two & ~one, 2).when(one & two, F.when(~F.col("__agree") & F.coalesce(F.col("__two") < F.col("__one"), F.lit(False)), 2).otherwise(1))
    out = {"lrc": F.when(pick == 1, F.col(first)).when(pick == 2, F.col(second)), "source": F.when(pick == 1, "LRCLIB").when(pick == 2, "YouTube Music"), "confidence": F.when(pick.isNotNull(), F.when(F.col("__agree"), 2.0).otherwise(1.0))}
    return df.withColumns(out).drop("__a", "__b", "__l", "__r", "__names", "__times", "__offs", "__mid", "__agree", "__one", "__two")


def timed_lyrics(observations: DataFrame, durations: DataFrame | None = None, by: str = "track_id") -> DataFrame:
    """(by, lrc, source, confidence): the first two sources cross-checked, the third only where neither has answered."""
    value = lambda s: F.max_by(F.when(F.col("source") == s, F.col("value")), F.when(F.col("source") == s, F.col("obs_id"))).alias(s)
    wide = observations.groupBy(by).agg(*(value(s) for s in ("lrclib", "ytmusic", "musixmatch")))
    wide = wide.join(durations.select(by, "duration"), by, "left") if durations is not None else wide.withColumn("duration", F.lit(None).cast("double"))
    df = cross_check(wide)
    third = F.col("lrclib").isNull() & F.col("ytmusic").isNull() & F.col("musixmatch").isNotNull()
    return df.select(by, F.when(third, F.col("musixmatch")).otherwise(F.col("lrc")).alias("lrc"), F.when(third, "Musixmatch").otherwise(F.col("source")).alias("source"), F.when(third, 1.0).otherwise(F.col("confidence")).alias("confidence")).where("lrc IS NOT NULL")


def earliest_release(rows: DataFrame, by: str = "track_id", date: str = "release_date") -> DataFrame:
    """The earliest readable date of each track; a forced one (column ``forced``) has precedence, the last of them."""
    d = parse.flexible_date(F.col(date))
    return rows.groupBy(by).agg(F.coalesce(F.max_by(F.when(F.col("forced"), d), F.when(F.col("forced"), F.col("obs_id"))), F.min(d)).alias(date))


#: Forms in which a release date may be given, in the order they are tried.
DATE_FORMS = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy")


def dates_agree(reference: Column, other: Column) -> Column:
    """struct<valid, match>: whether ``other``, in any of four forms, is the day of ``reference`` (ISO). With nothing to compare
    valid and null, with an unreadable date neither."""
    shapes = {f: rf"^\d{{4}}{f[4]}\d{{1,2}}{f[4]}\d{{1,2}}$" if f[0] == "y" else rf"^\d{{1,2}}{f[1]}\d{{1,2}}{f[1]}\d{{4}}$" for f in DATE_FORMS}
    read = lambda c, form: F.to_date(F.try_to_timestamp(F.when(c.rlike(shapes[form]), c), F.lit(form)))
    one, two = read(reference, DATE_FORMS[0]), F.coalesce(*(read(other, f) for f in DATE_FORMS))
    none = F.coalesce(other, F.lit("")) == ""
    ok = one.isNotNull() & two.isNotNull()
    return F.struct((none | ok).alias("valid"), F.when(~none, F.coalesce(one == two, F.lit(False))).alias("match"))


def duration_agrees(a: Column, b: Column, tolerance: int = 2) -> Column:
    """Within ``tolerance`` seconds; nothing to compare with counts as agreement."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(True))


def plurality(votes: DataFrame, by: str, candidate: str, least: int = 2) -> DataFrame:
    """The candidate with ``least`` votes or more and strictly more than the next; null if there is none."""
    counts = votes.where(F.col(candidate).isNotNull()).groupBy(by, candidate).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), candidate)
    top = counts.withColumns({"rank": F.row_number().over(order), "next": F.lead("n").over(order)}).where("rank = 1")
    return top.select(by, F.when((F.col("n") >= least) & (F.col("n") > F.coalesce("next", F.lit(0))), F.col(candidate)).alias("winner"), F.col("n").alias("votes"))


def majority(votes: DataFrame, by: str, candidate: str, order_by: str, voters: int = 5) -> DataFrame:
    """Of the first ``voters`` votes: the candidate with two or more and over half, or a lone vote's."""
    first = votes.where(F.col(candidate).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order_by))).where(F.col("__n") <= voters)
    counts = first.groupBy(by, candidate).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    top = counts.withColumns({"total": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), candidate))}).where("rank = 1")
    ok = ((F.col("n") >= 2) & (F.col("n") * 2 > F.col("total"))) | (F.col("total") == 1)
    return top.select(by, F.when(ok, F.col(candidate)).alias("winner"), F.col("n").alias("votes"), F.col("total").alias("voters"))


def identity_gate(remote: DataFrame, local: DataFrame, by: str, title: str, remote_albums: DataFrame | None = None, local_albums: DataFrame | None = None, album: str = "album") -> DataFrame:
    """matched, remote titles, ratio, album_overlap and suspect (fewer than two matches, or under 0.3 with no common album)."""
    r, o = remote.select(by, title).where(F.col(title) != "").distinct(), local.select(by, title).where(F.col(title) != "").distinct()
    out = r.join(o.withColumn("hit", F.lit(1)), [by, title], "left").groupBy(by).agg(F.count("*").alias("remote_titles"), F.count("hit").alias("matched"))
    if remote_albums is not None:
        common = remote_albums.select(by, album).distinct().join(local_albums.select(by, album).distinct(), [by, album]).groupBy(by).agg(F.count("*").alias("album_overlap"))
        out = out.join(common, by, "left").withColumn("album_overlap", F.coalesce("album_overlap", F.lit(0)))
    else:
        out = out.withColumn("album_overlap", F.lit(0).cast("bigint"))
    share = F.col("matched") / F.greatest("remote_titles", F.lit(1))
    return out.withColumns({"ratio": share, "suspect": (F.col("matched") < 2) | ((share < 0.3) & (F.col("album_overlap") == 0))})


def homonym_choice(candidates: DataFrame, by: str) -> DataFrame:
    """Of candidates (by, candidate, position, overlap, albums): the one with strictly the most common albums, else the first
    with albums, else the first."""
    w = Window.partitionBy(by)
    order = w.orderBy(F.desc("overlap"), "position")
    df = candidates.withColumns({"r": F.row_number().over(order), "next": F.lead("overlap").over(order)})
    clear = (F.col("r") == 1) & (F.col("overlap") > 0) & (F.col("overlap") > F.coalesce("next", F.lit(-1)))
    rank = F.when(clear, 0).when(F.col("albums") > 0, 1).otherwise(2)
    return df.groupBy(by).agg(F.min_by("candidate", F.struct(rank.alias("rank"), F.col("position").alias("position"))).alias("choice"))


def clear_after_failure(tracks: DataFrame, attempts: DataFrame, by: str = "track_id", fields: tuple[str, ...] = ("bpm", "key", "mode", "musical_key")) -> DataFrame:
    """Null the audio fields where every attempted source has failed outright (ok is false; null means skipped and blocks)
    and there was a tempo."""
    failed = attempts.groupBy(by).agg(F.bool_and(F.coalesce(~F.col("ok"), F.lit(False))).alias("__failed"))
    df = tracks.join(failed, by, "left")
    gone = F.coalesce("__failed", F.lit(False)) & F.col("bpm").isNotNull()
    before = df.withColumn("__gone", gone)
    return before.withColumns({f: F.when(~F.col("__gone"), F.col(f)) for f in fields if f in tracks.columns}).drop("__gone", "__failed")


def run_summary(results: DataFrame, by: str = "source") -> DataFrame:
    """One mark for each source over its outcomes: any success, else any doubt, else all skipped, else failure; and counts."""
    return results.groupBy(by).agg(
        F.when(F.bool_or(F.col("outcome") == "ok"), "✓").when(F.bool_or(F.col("outcome") == "doubt"), "?").when(F.bool_and(F.col("outcome") == "skipped"), "-").otherwise("✗").alias("mark"),
        F.count_if(F.col("outcome") == "ok").alias("ok"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )


#: Likeness from which a sung line stands for a written one, and written lines of a section that are looked for.
SUNG, TRIED = 0.82, 3
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def annotate_sections(tracks: DataFrame, by: str = "track_id", structured: str = "lyrics", lrc: str = "lrc") -> DataFrame:
    """(by, annotated): section headers with the time span their first lines have in timed lyrics.

    A section begins where the first of its first three lines that can be found is sung: at the nearest equal line ahead, else
    the nearest similar one, always behind where the section before was found. That is a fold over the sections as a column
    expression; only for lines that no equal line is left for, sung lines within the edits that a similar one can have are
    looked for, and an Arrow batch says which pairs of lines are similar, each once. Texts without timed lines or without a section that is found stay as they are."""
    blank = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    text, timed = F.col(structured), parse.timed_lines(F.col(lrc))
    df = tracks.select(by, text.alias("s"), F.transform(timed, lambda x: F.struct(x["at"], x["text"])).alias("t"))
    df = df.withColumns({"lines": F.split(F.regexp_replace("s", rf"(?:{_LINE_END})\z", ""), _LINE_END), "sung": F.filter("t", lambda x: blank(x["text"]) != "")})
    df = df.withColumns({"keys": F.transform("sung", lambda x: line_key(x["text"])), "bare": F.transform("lines", blank)})
    is_head = lambda x: x.startswith("[") & x.endswith("]")
    heads = F.filter(F.transform("bare", lambda x, i: F.when(is_head(x), i)), lambda i: i.isNotNull())
    df = df.withColumn("heads", F.coalesce(heads, F.array().cast("array<int>")))

    def first_lines(head: Column, n: Column) -> Column:
        after = F.coalesce(F.get("heads", n + 1), F.size("bare"))
        return F.transform(F.slice(F.filter(F.slice("bare", head + 2, F.greatest(after - head - 1, F.lit(0))), lambda x: x != ""), 1, TRIED), line_key)

    df = df.withColumn("wanted", F.transform("heads", first_lines))
    equal = lambda w: F.filter(F.transform("keys", lambda k, i: F.when(k == w, i)), lambda i: i.isNotNull())
    df = df.withColumn("equal", F.transform("wanted", lambda ws: F.transform(ws, equal)))
    df = df.withColumn("near", F.when((F.size("keys") > 0) & (F.size("heads") > 0), _near_lines("wanted", "equal", "keys")))
    df = df.withColumn("pairs", F.array_distinct(F.flatten(F.flatten("near"))["pair"]))
    df = df.withColumn("similar", _similar(F.transform("pairs", lambda x: x["a"]), F.transform("pairs", lambda x: x["b"])))
    df = df.withColumn("pairs", F.filter("pairs", lambda x, i: F.get("similar", i)))
    among = lambda near: F.transform(F.filter(near, lambda x: F.array_contains("pairs", x["pair"])), lambda x: x["p"])
    df = df.withColumn("alike", F.transform("near", lambda lines: F.transform(lines, among)))

    def found(at: Column, section: Column, k: int) -> Column:
        ahead = lambda name: F.array_min(F.filter(F.get(section[name], F.lit(k)), lambda p: p >= at))
        return F.when(F.length(F.get(section["wanted"], F.lit(k))) >= 3, F.coalesce(ahead("equal"), ahead("alike")))

    def step(state: Column, section: Column) -> Column:
        here = F.coalesce(*(found(state["at"], section, k) for k in range(TRIED)))
        return F.struct(F.coalesce(here + 1, state["at"]).alias("at"), F.concat(state["starts"], F.array(here)).alias("starts"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    folded = F.aggregate(F.arrays_zip("wanted", "equal", "alike"), begin, step)["starts"]
    df = df.withColumn("starts", F.when(F.col("alike").isNotNull(), folded))
    clock = lambda t: F.format_string("%d:%02d", F.floor(t / 60), F.floor(t) % 60)
    time = lambda p: F.get("sung", p)["at"]

    def written(line: Column, i: Column) -> Column:
        start = F.get("starts", (F.array_position("heads", i) - 1).cast("int"))
        then = F.array_min(F.filter("starts", lambda p: p > start))
        until = F.coalesce(time(then), F.get("t", F.size("t") - 1)["at"])
        name = F.get("bare", i)
        noted = F.concat(F.regexp_replace(F.left(name, F.length(name) - 1), r"(?U)\s+$", ""), F.lit("  ⏱ "), clock(time(start)), F.lit(" → "), clock(until), F.lit("]"))
        return F.coalesce(F.when(F.array_contains("heads", i) & start.isNotNull(), noted), line)

    some = F.exists(F.coalesce("starts", F.array().cast("array<int>")), lambda p: p.isNotNull())
    return df.select(by, F.when(some, F.array_join(F.transform("lines", written), "\n")).otherwise(F.col("s")).alias("annotated"))


def _near_lines(wanted: str, equal: str, keys: str) -> Column:
    """For each wanted line the sung lines (p, pair of both) behind its last equal one that can be similar to it. What two lines
    don't match in is deleted from one or inserted into the other, so similar ones have no more edits than that."""

    def behind(line: Column, same: Column) -> Column:
        edits = lambda x: F.floor((F.length(line) + F.length(x)) * (1 - SUNG) + 1e-9).cast("int")
        close = lambda x: F.call_function("levenshtein", line, x, edits(x)) >= 0
        ahead = lambda p: (F.length(line) >= 3) & (p > F.coalesce(F.array_max(same), F.lit(-1)))
        found = lambda x, p: F.when(ahead(p) & close(x), F.struct(p.alias("p"), F.struct(line.alias("a"), x.alias("b")).alias("pair")))
        return F.filter(F.transform(keys, found), lambda x: x.isNotNull())

    return F.transform(wanted, lambda lines, i: F.transform(lines, lambda line, k: behind(line, F.get(F.get(equal, i), k))))


@F.arrow_udf(ArrayType(BooleanType()))
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """Which pairs of lines are similar."""
    known: dict[tuple[str, str], bool] = {}  # lines repeat
    out = []
    for pair in zip(a.flatten().to_pylist(), b.flatten().to_pylist()):
        if pair not in known:
            known[pair] = SequenceMatcher(None, *pair).ratio() >= SUNG
        out.append(known[pair])
    sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out, pa.bool_()), mask=a.is_null())


def resolved_lyrics(tracks: DataFrame, replies: DataFrame, by: str = "track_id", *, with_second: bool = True) -> DataFrame:
    """(by, lrc, source, confidence, text, text_source) of every track, out of what the lyrics services replied.

    ``tracks``: duration, lyrics, need_sync, need_text; ``replies``: source ('lrclib', 'ytmusic', 'musixmatch'), lrc, text,
    duration, text_source, one row a track and source. Timed lyrics are looked for where ``need_sync``: the first two services are
    cross-checked (the second only ``with_second``), the third counts where neither has lines. The duration is the track's, or
    else the second service's. A text is taken from the second service where ``need_text`` and the track has none."""
    of = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    second = {"__text": of("ytmusic", "text"), "__text_source": of("ytmusic", "text_source"), "__duration": of("ytmusic", "duration")}
    wide = replies.groupBy(by).agg(*(of(s, "lrc").alias(s) for s in ("lrclib", "ytmusic", "musixmatch")), *(c.alias(n) for n, c in second.items()))
    df = tracks.join(wide, by, "left")
    known = F.when(F.col("duration") != 0, F.col("duration"))
    df = df.withColumn("duration", F.coalesce(known, "__duration")).withColumn("ytmusic", F.col("ytmusic") if with_second else F.lit(None).cast("string"))
    df = cross_check(df)
    third = F.col("lrc").isNull() & (F.coalesce("musixmatch", F.lit("")) != "")
    take = lambda c, other: F.when(F.col("need_sync"), F.when(third, other).otherwise(F.col(c))).alias(c)
    wants = F.coalesce("need_text", F.lit(False)) & (F.coalesce("lyrics", F.lit("")) == "") & (F.coalesce("__text", F.lit("")) != "")
    text = [F.when(wants, F.col("__text")).alias("text"), F.when(wants, F.coalesce(F.nullif("__text_source", F.lit("")), F.lit("YouTube Music"))).alias("text_source")]
    return df.select(by, take("lrc", F.col("musixmatch")), take("source", F.lit("Musixmatch")), take("confidence", F.lit(1.0)), *text)
