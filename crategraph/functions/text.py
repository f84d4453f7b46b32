"""Name and title normalisation as columns.

Unicode decomposition has no SQL function, so it alone runs in Arrow UDFs, once for each column; all else is built-in.
A null gives '' wherever a normal form is asked for. ``(?U)`` makes Java's \\w and \\s cover Unicode.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

APOSTROPHES = "’‘`´"
#: Zero-width space, non-joiner, joiner, word joiner and byte-order mark.
INVISIBLE = "​‌‍⁠﻿"

#: The patterns below, whose form defines the keys, as they are and in the order in which they are taken out.
#: Featuring clauses of a track title.
TITLE_CLAUSES = (r"(?iU)\s*[\(\[]\s*(?:feat|ft|avec|with)\.?[^\)\]]*[\)\]]", r"(?iU)\s+(?:feat|ft)\.?\s+[^\n]*$")
#: Bracketed parts, featuring clauses and punctuation of titles that sources are asked for.
ASKED_CLAUSES = (r"\([^\n]*?\)", r"\[[^\n]*?\]", r"feat\.[^\n]*$", r"ft\.[^\n]*$", r"(?U)[^\w\s]")
#: Bracketed parts and featuring clauses of release names.
RELEASE_CLAUSES = (r"\s*[()\[\]][^\n]*?[()\[\]]", r"\s*[()\[\]]", r"\s*\(?f(ea)?t\.?\s+[^\n]*")
#: Featuring clauses, bracketed parts and punctuation of titles in tempo pages.
LOOSE_CLAUSES = (r"(?i)\s*\(feat\.?\s+[^)]+\)", r"(?i)\s*\(ft\.?\s+[^)]+\)", r"(?i)\s*feat\.?\s+.+$", r"(?i)\s*ft\.?\s+.+$", r"(?i)\s*\[feat\.?\s+[^\]]+\]", r"(?i)\s*\[ft\.?\s+[^\]]+\]")
LOOSE_BRACKETS = (r"\s*\([^)]*\)", r"\s*\[[^\]]*\]")
LOOSE_PUNCTUATION = r"[\-_/.,:;!?\"'’]+"
#: Question marks that stand for an apostrophe: behind elided letters and words, ahead of English contractions.
ELIDED = (r"(?i)\b([CDJLMNST])\?(?=[A-Za-zÀ-ÿ])", r"(?i)\b(QU|JUSQU|LORSQU|PUISQU|QUOIQU|AUJOURD)\?(?=[A-Za-zÀ-ÿ])")
CONTRACTED = r"(?i)([A-Za-zÀ-ÿ])\?(S|T|RE|VE|LL|D|M)\b"


def _without(c: Column, patterns: tuple[str, ...]) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def _or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


@F.pandas_udf(StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Canonical decomposition without its combining marks."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(StringType())
def to_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(StringType())
def strip_compatible(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining characters."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def fold_case(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else x.casefold())


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; the order of the arguments matters. Null if either is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_title(c: Column) -> Column:
    """Key of a track title: featuring clauses, apostrophes, marks, dots and other punctuation gone, no blank ahead of digits."""
    c = to_ascii(F.translate(_without(_or_empty(c), TITLE_CLAUSES), "'" + APOSTROPHES, ""))
    c = F.regexp_replace(F.translate(c, ".", ""), r"[^\w\s]", " ")
    return F.lower(squeeze(F.regexp_replace(c, r"\s+(?=\d)", "")))


def normalize_certified(c: Column) -> Column:
    """Key of an artist or title in certification lists: upper case, no marks, symbols spelled out, ``'`` and ``-`` kept."""
    c = F.upper(strip_marks(squeeze(_or_empty(c))))
    for old, new in (("&", "AND"), ("$", "S"), ("Œ", "OE"), ("Æ", "AE")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.translate(c, APOSTROPHES + "–—", "''''--")
    return squeeze(F.regexp_replace(c, r"(?U)[^\w\s'-]", ""))


def display_name(c: Column) -> Column:
    """A credited name for display: no invisible characters, no trailing (Producer) and region such as (FRA)."""
    c = squeeze(F.translate(_or_empty(c), INVISIBLE, ""))
    c = F.trim(F.regexp_replace(c, r"(?iU)\s*\(\s*producer\s*\)\s*$", ""))
    return F.trim(F.regexp_replace(c, r"(?U)\s*\(\s*[A-Z]{2,4}\s*\)\s*$", ""))


def identity_key(c: Column) -> Column:
    """Key under which spellings of a credited name meet."""
    return fold_case(strip_marks(F.translate(display_name(c), APOSTROPHES, "''''")))


def enrichment_title(c: Column) -> Column:
    """Key used when sources are asked: lower case, no marks, bracketed parts and featuring clauses dropped."""
    return squeeze(_without(strip_marks(F.lower(_or_empty(c))), ASKED_CLAUSES))


def release_key(c: Column) -> Column:
    """Key of a release name: straight apostrophes, bracketed parts and featuring clauses dropped, marks kept."""
    return squeeze(_without(F.trim(F.lower(F.translate(_or_empty(c), APOSTROPHES, "''''"))), RELEASE_CLAUSES))


def plain_key(c: Column) -> Column:
    """Lower case ASCII letters and digits, single blanks between."""
    return F.trim(F.regexp_replace(strip_compatible(F.lower(_or_empty(c))), "[^a-z0-9]+", " "))


def title_core(c: Column) -> Column:
    """``plain_key`` of a title without bracketed parts and whatever follows a featuring word."""
    c = F.regexp_replace(strip_compatible(F.lower(_or_empty(c))), r"[\(\[\{][^\n]*?[\)\]\}]", " ")
    c = F.regexp_replace(c, r"\b(?:feat|ft|featuring|with|avec)\b[^\n]*$", " ")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def tempo_key(c: Column) -> Column:
    """Key in tempo databases: straight apostrophes, no marks, lower case."""
    return squeeze(F.lower(strip_compatible(F.translate(_or_empty(c), APOSTROPHES, "''''"))))


def loose_key(c: Column) -> Column:
    """Straight apostrophes, lower case, single blanks; marks stay."""
    return squeeze(F.lower(F.translate(_or_empty(c), APOSTROPHES, "''''")))


def loose_title_key(c: Column) -> Column:
    """``loose_key`` of a title without featuring clauses, bracketed parts and punctuation."""
    return squeeze(F.regexp_replace(loose_key(_without(_or_empty(c), LOOSE_CLAUSES + LOOSE_BRACKETS)), LOOSE_PUNCTUATION, " "))


def sort_key(c: Column) -> Column:
    """Lower case without marks."""
    return F.lower(strip_marks(_or_empty(c)))


def line_key(c: Column) -> Column:
    """Key of a lyrics line."""
    return squeeze(F.regexp_replace(F.lower(_or_empty(c)), "[^a-z0-9 ]", " "))


def album_key(c: Column) -> Column:
    return normalize_title(c)


def contains_word(text: Column, word: Column) -> Column:
    """Whether ``word`` occurs in ``text`` with no word character next to it; both are taken literally."""
    at = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(word, F.lit("\\E"), F.lit("")), F.lit(r"\E(?!\w)"))
    return F.rlike(text, at)


#: Words in which a question mark stands for the ligature (C?UR, S?UR, V?U, B?UF, N?UD, M?URS, F?TUS, ?UVRE, ?UF, ?IL, ?DIPE).
LIGATURE_WORDS = (r"\bC\?URS?\b", r"\bS\?URS?\b", r"\bV\?UX?\b", r"\bB\?UFS?\b", r"\bN\?UDS?\b", r"\bM\?URS\b", r"\bF\?TUS\b", r"(?<![A-Za-zÀ-ÿ])\?UVRES?\b", r"(?<![A-Za-zÀ-ÿ])\?UFS?\b", r"(?<![A-Za-zÀ-ÿ])\?IL\b", r"(?<![A-Za-zÀ-ÿ])\?DIPE\b")


def restore_marks(c: Column) -> Column:
    """Put back the ligature and the apostrophe where a question mark can stand for nothing else; others stay.

    A word in capitals gets the capital ligature. The word's two halves around the mark are matched with a look-ahead, so
    that the mark alone is replaced."""
    for word in LIGATURE_WORDS:
        before, after = word.split(r"\?")
        behind = before.replace(r"\b", "") if before.startswith(r"\b") else ""
        guard = rf"(?<=\b{behind})" if behind else before
        c = F.regexp_replace(c, rf"{guard}\?(?={after})", "Œ")
        c = F.regexp_replace(c, rf"(?i){guard}\?(?={after})", "œ")
    for elided in ELIDED:
        c = F.regexp_replace(c, elided, "$1'")
    return F.regexp_replace(c, CONTRACTED, "$1'$2")


def containment_score(artist: Column, title: Column, text: Column) -> Column:
    """Relevance of a search hit's text: 0.4 for each of artist and title within it, 0.1 for each of their words of three
    letters or more, at most 1; 0.5 without text."""
    a, t, x = (F.lower(F.translate(_or_empty(c), APOSTROPHES, "''''")) for c in (artist, title, text))
    inside = lambda c: F.when(F.contains(x, c), 0.4).otherwise(0.0)
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda w: (F.length(w) > 2) & F.contains(x, w))) * 0.1
    return F.when(_or_empty(text) == "", 0.5).otherwise(F.least(F.lit(1.0), inside(a) + inside(t) + words(a) + words(t)))


@F.pandas_udf(DoubleType())
def best_ratio(a: pd.Series, others: pd.Series) -> pd.Series:
    """The highest ratio of a text with those of an array; 0 without any."""
    return pd.Series([max((SequenceMatcher(None, x or "", y or "").ratio() for y in (ys if ys is not None else ())), default=0.0) for x, ys in zip(a, others)], dtype="float64")


def relevance(title: Column, artists: Column, wanted_title: Column, wanted_artist: Column) -> Column:
    """Six tenths the likeness of the titles and four tenths that of the nearest artist, in lower case."""
    low = lambda c: F.lower(_or_empty(c))
    return ratio(low(wanted_title), low(title)) * 0.6 + best_ratio(low(wanted_artist), F.transform(artists, low)) * 0.4


def slug(c: Column) -> Column:
    """Lower case, no dots and apostrophes, dashes for blanks, a capital first."""
    c = F.translate(F.lower(_or_empty(c)), " .'’", "-")
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def file_slug(c: Column, max_length: int = 80) -> Column:
    """ASCII letters, digits and dashes of a name, cut to ``max_length``."""
    c = F.regexp_replace(F.lower(to_ascii(_or_empty(c))), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(c, "^-+|-+$", ""), 1, max_length)
