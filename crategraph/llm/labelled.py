"""Labelled training rows: a bounded sample of the documents that labels cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crategraph.shared import settle


def remainder(id_: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % modulus


def held_out(id_: Column, modulus: int, value: int) -> Column:
    return F.coalesce(remainder(id_, modulus) == value, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, label_id_col: str, *, size: int, modulus: int = 4, held: int = 2) -> DataFrame:
    """(id, text, label) of at most ``size`` labelled documents that are not held out: those of the least id hashes; ids that ``docs`` lacks
    count towards the size, too.

    Rows without an id or a label are left out; of several labels of an id the majority counts, 1 at a tie; of several rows
    of an id the least text. The id list is bounded by ``size``, so it is broadcast and the documents stay where they are.
    The result is settled."""
    known = labels.select(F.col(label_id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = known.where(~held_out(F.col("id"), modulus, held)).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(size)
    return settle(texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("id", "text", "label"))
