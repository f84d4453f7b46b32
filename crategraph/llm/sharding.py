"""Extendible hashing: documents to shards by hash-prefix bits, in DataFrame functions only.

A document's bits are the first 60 of the MD5 of its id and text. The directory starts with one shard; a shard over the
byte limit is split on its next bit, others stay, until every shard fits. Sizes of all prefixes are counted 12 bits at a
time: one aggregation over the documents, then only those in cells that still are too large go through a further one. The
directory (one row per 12-bit cell) goes to the documents by a broadcast if counting shows it small, else by a join.

Defined results: a text counts its UTF-8 bytes, a null none; a null id and an empty text are hashed like any value; one
document over the limit is a shard of its own; rows repeated in id and text share all bits, and where they are too many for
one shard, they fill numbered overflow pages of it, as many rows in each as fit; an empty table gives no shard. Extra
columns are kept, those named like one that is added as ``input_`` and their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crategraph.shared import join_measured, settle

BITS, STEP = 60, 12
HASH, SIZE = "__shard_hash", "__shard_size"


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x1f"), text).cast("binary"))
    return docs.withColumns({HASH: F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long"), SIZE: F.octet_length(text).cast("long")})


def _prefix(hash_: Column, bits: int) -> Column:
    return F.shiftright(hash_, BITS - bits)


def _cells(hashed: DataFrame, limit: int) -> list[DataFrame]:
    """Tables (__shard_cell, depth, prefix, bytes, docs), one per 12 bits: cells whose shard is known; depth is null where a
    cell must be split further. The last table has no such null."""
    tables: list[DataFrame] = []
    rest = hashed.select(HASH, SIZE)
    for bits in range(STEP, BITS + 1, STEP):
        fine = settle(rest.groupBy(_prefix(F.col(HASH), bits).alias("__shard_cell")).agg(F.sum(SIZE).alias("inside"), F.count("*").alias("n")))
        depths = F.explode(F.sequence(F.lit(bits - STEP + (bits > STEP)), F.lit(bits))).alias("depth")
        up = F.call_function("shiftright", F.col("__shard_cell"), F.lit(bits) - F.col("depth"))
        each = fine.select("__shard_cell", "inside", "n", depths).withColumn("prefix", up)
        sizes = each.groupBy("depth", "prefix").agg(F.sum("inside").alias("bytes"), F.sum("n").alias("docs"))
        fits = F.lit(bits == BITS) & (F.col("depth") == BITS) | (F.col("bytes") <= limit) | (F.col("docs") == 1)
        found = join_measured(each, settle(sizes.where(fits)), ["depth", "prefix"], "inner").groupBy("__shard_cell").agg(F.min_by(F.struct("depth", "prefix", "bytes", "docs"), "depth").alias("s"))
        cells = settle(fine.join(found, "__shard_cell", "left").select("__shard_cell", "s.depth", "s.prefix", "s.bytes", "s.docs"))
        tables.append(cells)
        open_ = cells.where("depth IS NULL").select(F.col("__shard_cell").alias("__shard_open"))
        if not open_.count():
            break
        rest = rest.withColumn("__shard_open", _prefix(F.col(HASH), bits)).join(open_, "__shard_open", "left_semi").drop("__shard_open")
    return tables


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 32 << 20) -> DataFrame:
    """``docs`` with shard (its prefix as a bit string, with ``.page`` for overflow pages), depth, shard_bytes, n_bytes."""
    hashed = _hashed(docs, id_col, text_col)
    tables = _cells(hashed, limit)
    df = hashed
    for k, cells in enumerate(tables):
        step = cells.select(F.col("__shard_cell").alias(f"__shard_cell{k}"), F.struct("depth", "prefix", "bytes", "docs").alias(f"__shard_at{k}"))
        df = join_measured(df.withColumn(f"__shard_cell{k}", _prefix(F.col(HASH), STEP * (k + 1))), step, f"__shard_cell{k}")
    at = F.coalesce(*(F.when(F.col(f"__shard_at{k}.depth").isNotNull(), F.col(f"__shard_at{k}")) for k in range(len(tables))))
    df = df.withColumn("__shard_at", at)
    name = F.when(F.col("__shard_at.depth") == 0, "").otherwise(F.lpad(F.bin("__shard_at.prefix"), F.col("__shard_at.depth"), F.lit("0")))
    out = {"shard": name, "depth": F.col("__shard_at.depth"), "shard_bytes": F.col("__shard_at.bytes"), "n_bytes": F.col(SIZE)}
    columns = [F.col(c).alias(f"input_{c}" if c.lower() in out else c) for c in docs.columns]
    if len(tables) < BITS // STEP or not tables[-1].where((F.col("bytes") > limit) & (F.col("docs") > 1)).count():
        return df.select(*columns, *(c.alias(n) for n, c in out.items()))
    stuck = (F.col("__shard_at.bytes") > limit) & (F.col("__shard_at.docs") > 1)
    plain = df.where(~stuck).select(*columns, *(c.alias(n) for n, c in out.items()))
    return plain.unionByName(_pages(df.where(stuck), limit).select(*columns, *(c.alias(n) for n, c in (out | {"shard": F.concat(name, F.lit("."), F.col("__shard_page")), "shard_bytes": F.col("__shard_bytes")}).items())))


def _pages(df: DataFrame, limit: int) -> DataFrame:
    """Number the rows of each hash, first by task and then within it, and cut the numbering into pages. Rows of one hash are
    equal, so it doesn't matter which of them gets which number."""
    df = settle(df.withColumn("__shard_task", F.spark_partition_id()))  # so both sides of the join read the same numbers
    counts = df.groupBy(HASH, "__shard_task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(HASH).orderBy("__shard_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(HASH, "__shard_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shard_offset"))
    own = Window.partitionBy(HASH, "__shard_task").orderBy(SIZE)
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col(SIZE), F.lit(1))))
    number = F.col("__shard_offset") + F.row_number().over(own) - 1
    df = df.join(offsets, [HASH, "__shard_task"]).withColumn("__shard_page", F.floor(number / fit))
    rows = F.least(fit, F.col("__shard_at.docs") - F.col("__shard_page") * fit)
    return df.withColumn("__shard_bytes", rows * F.col(SIZE))
