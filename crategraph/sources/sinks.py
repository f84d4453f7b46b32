"""Exports and table versions. Everything is written by Spark's own writers, so a lost task is simply run again."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crategraph.functions.catalog import is_video_credit
from crategraph.functions.parse import word_count


def artist_documents(artists: DataFrame, tracks: DataFrame, credits: DataFrame) -> DataFrame:
    """One nested row an artist: tracks by title with music and video credits apart, lyrics counts and totals."""
    c = credits.withColumn("video", is_video_credit(F.col("role"), F.col("role_detail")))
    listed = lambda v: F.sort_array(F.collect_list(F.when(F.col("video") == v, F.struct("role", "name", "role_detail"))))
    per_track = c.groupBy("track_id").agg(listed(False).alias("music_credits"), listed(True).alias("video_credits"), F.count("*").alias("n_credits"))
    t = tracks.join(per_track, "track_id", "left").withColumns({"words": word_count(F.col("lyrics")), "characters": F.length(F.coalesce("lyrics", F.lit("")))})
    fields = ["title", "track_id", *(x for x in tracks.columns if x not in ("title", "track_id", "artist_id", "lyrics")), "words", "characters", "music_credits", "video_credits"]
    per_artist = t.groupBy("artist_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("tracks"), F.count("*").alias("total_tracks"), F.coalesce(F.sum("n_credits"), F.lit(0)).alias("total_credits"))
    return artists.join(per_artist, "artist_id", "left")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flat(df: DataFrame, separator: str = ", ") -> DataFrame:
    """Arrays of strings as joined text, for CSV."""
    return df.select(*(F.array_join(F.col(c).cast("array<string>"), separator).alias(c) if t.startswith("array<") and "struct" not in t else F.to_json(c).alias(c) if t.startswith(("array<", "struct<", "map<")) else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    flat(df).write.mode("overwrite").csv(path, header=True, sep=separator)


MANIFEST, CURRENT = "_manifest.json", "_current"


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, so that any store will do, and its Path class."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a temporary name, then move it over the old one."""
    fs, at = _fs(spark, path)
    spare = at(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(spare)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(spare, at(path)):  # stores without replacing renames
        fs.delete(at(path), False)
        fs.rename(spare, at(path))


def _get(spark: SparkSession, path: str) -> str | None:
    """A small file's text (Spark's own readers pass over names with an underscore ahead)."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return None
    source = fs.open(at(path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def digest(df: DataFrame) -> dict:
    """Rows, schema and an order-independent sum over the rows of a table, in one pass."""
    mark = F.xxhash64(*(F.to_json(F.struct(c)) if t.startswith(("map<", "variant")) else F.col(f"`{c}`") for c, t in df.dtypes)) if df.columns else F.lit(0)
    row = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.pmod(mark, F.lit(1 << 40)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor(mark), F.lit(0)).alias("xor")).first()
    return {"rows": row["rows"], "sum": row["sum"], "xor": row["xor"], "schema": df.schema.simpleString()}


def save_version(df: DataFrame, root: str, version: int, *, unfinished: str = "errorifexists") -> str:
    """A table as a version directory with a manifest of what was written, read back; then readers are pointed to it.

    A version without manifest was never finished; ``unfinished`` is the write mode for what it left. A finished version is not
    written again."""
    spark, path = df.sparkSession, f"{root}/version={version:06d}"
    if version in versions(spark, root):
        raise FileExistsError(path)
    df.write.mode(unfinished).parquet(path)
    _put(spark, f"{path}/{MANIFEST}", json.dumps(digest(spark.read.parquet(path))))
    _put(spark, f"{root}/{CURRENT}", str(version))
    return path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions, in order, damaged or not."""
    fs, at = _fs(spark, root)
    if not fs.exists(at(root)):
        return []
    found = [s.getPath() for s in fs.listStatus(at(root)) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(at(p, MANIFEST)))


def is_sound(spark: SparkSession, root: str, version: int) -> bool:
    """Whether a version reads back as its manifest says."""
    path = f"{root}/version={version:06d}"
    told = _get(spark, f"{path}/{MANIFEST}")
    if told is None:
        return False
    try:
        return digest(spark.read.parquet(path)) == json.loads(told)
    except (Py4JJavaError, PySparkException, ValueError):  # no readable file is left, or a broken one
        return False


def current_version(spark: SparkSession, root: str) -> int | None:
    told = _get(spark, f"{root}/{CURRENT}")
    return int(told) if told is not None else None


def load_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version; by default the current one, or where that is damaged the newest sound one before it. A damaged version that
    is asked for is refused."""
    known = versions(spark, root)
    if version is None:
        top = current_version(spark, root)
        version = next((v for v in reversed(known) if (top is None or v <= top) and is_sound(spark, root, v)), None)
    elif version not in known or not is_sound(spark, root, version):
        version = None
    if version is None:
        raise FileNotFoundError(f"no such sound version below {root}")
    return spark.read.parquet(f"{root}/version={version:06d}")


def restore_version(spark: SparkSession, root: str, version: int) -> None:
    """Point readers to an earlier version, if it is sound; nothing is copied."""
    if version not in versions(spark, root) or not is_sound(spark, root, version):
        raise FileNotFoundError(f"no such sound version below {root}")
    _put(spark, f"{root}/{CURRENT}", str(version))


def prune_versions(spark: SparkSession, root: str, keep: int = 10) -> list[int]:
    """Delete all but the newest ``keep`` versions, never the current one; those that went."""
    fs, at = _fs(spark, root)
    old = [v for v in versions(spark, root)[:-keep] if v != current_version(spark, root)]
    for v in old:
        fs.delete(at(f"{root}/version={v:06d}"), True)
    return old
