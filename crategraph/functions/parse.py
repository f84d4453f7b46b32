"""Dates, durations, numbers, identifiers and timed lyrics out of text, as columns. What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no value".
NULL_LITERALS = ("None", "NULL", "")


def null_literals(c: Column) -> Column:
    return F.when(c.cast("string").isin(*NULL_LITERALS), None).otherwise(c)


def flexible_date(c: Column) -> Column:
    """Timestamp of ISO texts (date, or date and time with T or blank, Z or offset); else of their first ten characters."""
    c = F.trim(c.cast("string"))
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(c))
    day = F.substring(c, 1, 10)
    return F.coalesce(iso, F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))))


def iso_date(c: Column) -> Column:
    """US dates (long and short month names, month/day/year) and day/month/year with a leading zero day over 12 to ISO; other
    texts stay as they are, null and 'none' give ''."""
    c = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    day, named = r"^([A-Z][a-z]+ \d{1,2}, |\d{1,2}/\d{1,2}/)\d{4}$", F.initcap(c)
    iso = lambda text: F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("[MMMM d, yyyy][MMM d, yyyy][M/d/yyyy]")), "yyyy-MM-dd"), c)
    # initcap costs as much as the rest: only what starts with no digit and isn't capitalised yet meets it
    return F.when(c.rlike(day), iso(c)).when((c == "") | (F.lower(c) == "none"), "").when(c.rlike(r"^\D") & named.rlike(day), iso(named)).otherwise(c)


def day_first_date(c: Column) -> Column:
    """dd/MM/yyyy to an ISO text; null if it is no such date."""
    return F.date_format(F.try_to_timestamp(F.when(F.trim(c).rlike(r"^\d{2}/\d{2}/\d{4}$"), F.trim(c)), F.lit("dd/MM/yyyy")), "yyyy-MM-dd")


def duration_seconds(c: Column) -> Column:
    """Seconds of '228', '3:48' or '1:02:03'."""
    c = F.trim(null_literals(c.cast("string")))
    parts = F.transform(F.split(c, ":"), lambda x: x.try_cast("bigint"))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 60 + x)
    return F.when(c.rlike(r"^-?\d+(:\d+){0,2}$"), total)


def format_seconds(c: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    c = c.cast("bigint")
    h, m, s = F.floor(c / 3600), F.floor(c / 60), c % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m % 60, s)).otherwise(F.format_string("%d:%02d", m, s))


def digits(c: Column) -> Column:
    """The number made of a text's digits."""
    return F.regexp_replace(c.cast("string"), r"\D", "").try_cast("bigint")


def counted(c: Column) -> Column:
    """'1,2 M', '500 k', '3 Md', '2B' or '1 234 567' as a number."""
    c = F.trim(F.translate(c.cast("string"), "  ", "  "))
    size = F.lower(F.regexp_extract(c, r"(?i)(md|b|m|k)$", 1))
    number = F.translate(F.regexp_replace(c, r"(?i)(md|b|m|k)$", ""), ", ", ".").try_cast("double")
    unit = F.when(size.isin("md", "b"), 1e9).when(size == "m", 1e6).when(size == "k", 1e3)
    return F.when(size != "", (number * unit).cast("bigint")).otherwise(digits(c))


def video_id(url: Column) -> Column:
    """The 11 characters after v=, youtu.be/, /embed/ or /shorts/."""
    return F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def catalog_id(url: Column, kind: str = "track") -> Column:
    """The 22 characters after /track/, /artist/ or /album/ of a catalog url."""
    return F.nullif(F.regexp_extract(url, rf"[:/]{kind}[:/]([A-Za-z0-9]{{22}})", 1), F.lit(""))


LRC = r"^\[(\d+):(\d+)(?:[.:](\d+))?\]\s*(.*)$"


def timed_lines(lrc: Column) -> Column:
    """array<struct<at: double, text>> of the lines ``[mm:ss.cc] text``; the fraction counts hundredths whatever its length."""
    lines = F.filter(F.transform(F.split(F.coalesce(lrc, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x.rlike(LRC))

    def parsed(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, LRC, k)
        fraction = F.coalesce(F.nullif(part(3), F.lit("")).cast("double") / 100, F.lit(0.0))
        return F.struct((part(1).cast("int") * 60 + part(2).cast("int") + fraction).alias("at"), F.trim(part(4)).alias("text"))

    return F.transform(lines, parsed)


def lrc_line(milliseconds: Column, text: Column) -> Column:
    """``[mm:ss.cc] text`` from milliseconds."""
    ms = milliseconds.cast("bigint")
    return F.concat(F.format_string("[%02d:%02d.%02d] ", F.floor(ms / 60000), F.floor(ms / 1000) % 60, F.floor(ms / 10) % 100), text)


#: Fixed value: a run of days and levels.
DATED = r"(\d{2}/\d{2}/\d{4})\s*:\s*(.+?)(?=\s*\d{2}/\d{2}/\d{4}\s*:|$)"


def dated_levels(c: Column) -> Column:
    """array<struct<date, level>> of 'dd/mm/yyyy : level' runs such as '12/03/2019 : 2x Platine 01/02/2018 : Or'."""
    dates, levels = F.regexp_extract_all(c, F.lit(DATED), F.lit(1)), F.regexp_extract_all(c, F.lit(DATED), F.lit(2))
    pairs = F.zip_with(dates, levels, lambda d, v: F.struct(day_first_date(d).alias("date"), F.trim(v).alias("level")))
    return F.filter(pairs, lambda x: x["date"].isNotNull() & (x["level"] != ""))


#: How song pages put mode, key and beats.
MODE_PHRASES = (r"(?i)key\s+and\s+a\s+(major|minor)\s+mode", r"(?i)\b(major|minor)\s+mode\b")
KEY_PHRASE = r"(?i)with\s+a\s+([A-G][#b♯♭/]+)\s+key"
BEATS_PHRASE = r"(?i)time\s+signature\s+of\s+(\d+)\s+beats?\s+per\s+bar"


def song_details(text: Column) -> Column:
    """struct<mode, key, beats> read out of a song page's prose."""
    first = lambda *patterns: F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))
    return F.struct(
        F.lower(first(*MODE_PHRASES)).alias("mode"),
        first(KEY_PHRASE).alias("key"),
        first(BEATS_PHRASE).cast("int").alias("beats"),
    )


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def with_section_artist(lyrics: Column, artist: Column) -> Column:
    """Section headers such as [Couplet 1] that name no artist get ' : artist'."""
    return F.when(artist.isNull() | (artist == ""), lyrics).otherwise(F.regexp_replace(lyrics, F.lit(r"(?m)^\[([^\]:\n]+)\]$"), F.concat(F.lit("[$1 : "), F.regexp_replace(artist, r"([\\$])", r"\\$1"), F.lit("]"))))
