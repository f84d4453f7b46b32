"""Certification lists in CSV of several dialects. Files are read as text by Spark, so any store and any size will do."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crategraph.functions import catalog, parse
from crategraph.functions.text import normalize_certified, squeeze, to_ascii
from crategraph.shared import join_measured, settle

UNIFIED = ("artist_clean", "title_clean", "cat", "level", "date", "country", "body", "artist_name", "title", "release_date", "publisher", "detail_url")


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, no) of text files in UTF-8 (with or without mark) or else Latin-1, NUL bytes dropped.

    Spark splits large files; lines keep their bytes, so that a file's encoding, which is UTF-8 only if all of its lines are, is
    one flag a file. Lines are numbered within each split on top of what the file's splits before hold. A file that changes
    while it is read is settled as it was."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")]
    raw = settle(spark.read.text(path).select(*meta, "value", F.monotonically_increasing_id().alias("id")))
    blocks = raw.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    along = Window.partitionBy("file").orderBy("at")  # a row for each split
    blocks = blocks.select("file", "at", "first", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.bool_and("valid").over(Window.partitionBy("file")).alias("valid"))
    df = join_measured(raw, settle(blocks), ["file", "at"], "inner")
    text = F.when(F.col("valid"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    no = (F.col("before") + F.col("id") - F.col("first")).cast("int")
    text = F.when(no == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return df.select("file", no.alias("no"), F.translate(text, "\x00", "").alias("line"))


def repaired(lines: DataFrame, separator: str = ";", column: int = 2) -> DataFrame:
    """Lines with more fields than their file's header (line 0): the surplus goes into field ``column``, in quotes; lines with
    quotes stay as they are. ``was_repaired`` tells."""
    head = settle(lines.where("no = 0").select("file", F.size(F.split("line", F.lit(re.escape(separator)))).alias("__n")))
    df = join_measured(lines, head, "file", "inner")
    fields = F.split("line", re.escape(separator))
    extra = F.size(fields) - F.col("__n")
    over = (F.col("no") > 0) & (extra > 0) & ~F.col("line").contains('"') & (F.trim("line") != "")
    merged = F.array_join(F.concat(F.slice(fields, F.lit(1), F.lit(column)), F.array(F.concat(F.lit('"'), F.array_join(F.slice(fields, F.lit(column + 1), extra + 1), separator), F.lit('"'))), F.slice(fields, extra + column + 2, F.greatest(F.size(fields), F.lit(1)))), separator)
    return df.withColumns({"line": F.when(over, merged).otherwise(F.col("line")), "was_repaired": over}).drop("__n")


def header_key(name: str) -> str:
    """A header without marks, case and punctuation."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", name.lower()) if c.isalnum())


def with_headers(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns by any of their known names, compared by ``header_key``; one that is missing is ''."""
    have = {header_key(c): c for c in df.columns}
    pick = lambda names: next((have[header_key(n)] for n in names if header_key(n) in have), None)
    return df.select(*((F.coalesce(F.col(f"`{pick(names)}`").cast("string"), F.lit("")) if pick(names) else F.lit("")).alias(out) for out, names in wanted.items()))


#: Header names of the French list.
FRENCH_HEADERS = {"artist": ("Interprète", "Interprete", "Artiste"), "title": ("Titre",), "publisher": ("Éditeur / Distributeur", "Editeur", "Éditeur"), "category": ("Catégorie",), "level": ("Certification",), "release_date": ("Date de sortie",), "certification_date": ("Date de constat",)}


def french_list(spark: SparkSession, path: str) -> DataFrame:
    """The French body's list: semicolons, surplus separators repaired, headers by name, dd/MM/yyyy dates to ISO, bad lines
    dropped, row order kept in ``pos``."""
    lines = repaired(decoded_lines(spark, path))
    header = lines.where("no = 0").orderBy("file").select("line").first()
    if header is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in FRENCH_HEADERS) + ", pos long")
    names = [h.strip().strip('"') for h in header[0].split(";")]
    schema = ", ".join(f"`c{k}` string" for k in range(len(names)))
    body = lines.where("no > 0 AND trim(line) <> ''").select(F.from_csv("line", F.lit(schema), {"sep": ";", "mode": "PERMISSIVE"}).alias("r"), F.col("no").cast("long").alias("pos"))
    wide = body.select("pos", *(F.col(f"r.c{k}").alias(n) for k, n in enumerate(names)))
    have = {header_key(n): n for n in names}
    pick = lambda options: next((have[header_key(o)] for o in options if header_key(o) in have), None)
    out = wide.select("pos", *((squeeze(F.coalesce(F.col(f"`{pick(o)}`"), F.lit(""))) if pick(o) else F.lit("")).alias(c) for c, o in FRENCH_HEADERS.items()))
    day = lambda c: F.coalesce(parse.day_first_date(F.col(c)), F.col(c))
    return out.withColumns({"release_date": day("release_date"), "certification_date": day("certification_date")})


SEPARATORS = ";,\t|"


def date_column(names: list[str], wanted: str | None = None) -> str | None:
    """The column of that name in any case, else the first with 'date' in its name."""
    low = {n.lower(): n for n in reversed(names)}
    return low.get((wanted or "").lower()) or next((n for n in names if "date" in n.lower()), None)


def probed(spark: SparkSession, path: str, wanted_date: str | None = None) -> DataFrame:
    """Lists with a header, in any of the encodings of ``decoded_lines`` and with the separator that a file's header has most of;
    all columns as text, and ``day``, what the date column (``date_column``) says, day first, null if it is no date.

    Files may differ in their layout; each distinct header is a branch of the plan, and a column that one lacks is null. An
    empty path gives no columns but ``day``."""
    lines = settle(decoded_lines(spark, path))
    heads = lines.where("no = 0").select("file", F.col("line").alias("head"))
    layouts = sorted(r[0] for r in heads.select("head").distinct().collect() if r[0].strip())  # a row for each layout
    out = None
    for head in layouts:
        separator = max(SEPARATORS, key=head.count)
        names = [n.strip().strip('"') for n in head.split(separator)]
        schema = ", ".join(f"`c{k}` string" for k in range(len(names)))
        own = join_measured(lines.where("no > 0 AND trim(line) <> ''"), settle(heads.where(F.col("head") == head).select("file")), "file", "left_semi")
        rows = own.select(F.from_csv("line", F.lit(schema), {"sep": separator, "mode": "PERMISSIVE"}).alias("r"))
        dated = date_column(names, wanted_date)
        day = read_day(F.col(f"r.c{names.index(dated)}")) if dated else F.lit(None).cast("date")
        part = rows.select(*(F.col(f"r.c{k}").alias(n) for k, n in enumerate(names)), day.alias("day"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "day date")


def read_day(c: Column) -> Column:
    """The day of yyyy-MM-dd, of dd/MM/yyyy or with dashes or dots, or of a US date that can't be day first."""
    c = F.trim(c)
    one = lambda shape, form: F.to_date(F.try_to_timestamp(F.when(c.rlike(shape), c), F.lit(form)))
    return F.coalesce(one(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), *(one(rf"^\d{{1,2}}{re.escape(x)}\d{{1,2}}{re.escape(x)}\d{{4}}$", f"{order[0]}{x}{order[1]}{x}yyyy") for order in ("dM", "Md") for x in "/-."))


def unified(rows: DataFrame, body: str, artist: str = "artist", title: str = "title", category: str = "category", level: str = "level", date: str = "certification_date") -> DataFrame:
    """A list in the schema that all bodies share."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    values: dict[str, Column] = {
        "artist_clean": normalize_certified(text(artist)), "title_clean": normalize_certified(text(title)), "cat": catalog.category_class(text(category)),
        "level": catalog.plain_us_level(text(level)), "date": parse.iso_date(text(date)), "country": F.lit(catalog.COUNTRIES[body]), "body": F.lit(body),
        "artist_name": text(artist), "title": text(title), "release_date": parse.iso_date(text("release_date")), "publisher": text("publisher"), "detail_url": text("detail_url"),
    }
    return rows.select(*(values[c].alias(c) for c in UNIFIED))


def all_bodies(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, lists)


def sidecar_freshness(text: Column) -> Column:
    """struct<updated, artists_updated, count> of a list's JSON sidecar: the latest of its update stamps that are not the
    artists' one, that one, and the number of rows."""
    m = F.from_json(text, "map<string,string>")
    stamps = F.map_filter(m, lambda k, v: F.contains(k, F.lit("update")) & ~F.contains(k, F.lit("artist")))
    return F.struct(F.array_max(F.map_values(stamps)).alias("updated"), F.try_element_at(m, F.lit("artists_last_update")).alias("artists_updated"), F.coalesce(F.try_element_at(m, F.lit("total_records")), F.try_element_at(m, F.lit("count"))).try_cast("bigint").alias("count"))


__all__ = ["all_bodies", "decoded_lines", "french_list", "probed", "repaired", "sidecar_freshness", "to_ascii", "unified", "with_headers"]
