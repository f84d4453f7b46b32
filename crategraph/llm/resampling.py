"""Importance resampling towards a target distribution, in two Arrow passes.

Texts are lower-cased (A-Z only) and cut into words; a feature is a word, its bucket the CRC-32 of its bytes modulo
``BUCKETS``. The first pass gives one vector of bucket counts a task, with ``np.bincount``, and ``treeReduce`` merges them, so
that the driver meets a few vectors of 80 KB whatever the input. The second pass broadcasts the buckets' gains (80 KB) and
sums them over each document with ``np.bincount`` weights. Integer gains keep those sums exact. The draw is a Gumbel top-k:
documents are sorted by ranges of (score, id) and numbered within each range on top of what the ranges before hold.

Defined results: a null or empty text has no features, weight 0, and is never drawn; a null id is hashed as '' and, among equal
scores, comes last; repeated rows are drawn and ranked one by one; a long text is a chunk of its own; columns other than the two named
ones are ignored, whatever they are called; an empty table gives no rows, an empty target gains that favour rare buckets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crategraph.llm import text as T
from crategraph.shared import settle

BUCKETS = 10_000
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
#: Words of more bytes are hashed one by one.
SHORT = 48


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of bytes: the k-th byte of all spans that have one at a time, longest spans first."""
    length = end - start
    out = np.empty(len(start), np.uint32)
    long = np.flatnonzero(length > SHORT)
    for i in long:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    order = np.argsort(-length, kind="stable")[len(long) :]
    at, size = start[order], length[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    more = np.searchsorted(-size, -np.arange(SHORT + 1), "left")  # spans with more than k bytes
    for k in range(int(size[0]) if len(size) else 0):
        n = more[k]
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    out[order] = ~state
    return out


def _features(chunk: T.Chunk) -> tuple[T.Words, np.ndarray]:
    w = T.words(chunk, T.PUNCTUATION, lower=True)
    return w, (crc32(w.data, w.start, w.end) % BUCKETS).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                total += np.bincount(_features(chunk)[1], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    T.text_batches(docs.sparkSession)
    vectors = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "counts binary").rdd
    vectors = vectors.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    return np.zeros(BUCKETS, np.int64) if vectors.getNumPartitions() == 0 else vectors.treeReduce(np.add, depth=3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, with one added to every count."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b) + 1.0) * s / ((float(a) + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight) of every row."""
    spark = docs.sparkSession
    T.text_batches(spark)
    held = spark.sparkContext.broadcast(gain)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for chunk in T.chunks(batch.column(1)):
                w, bucket = _features(chunk)
                here = slice(chunk.first, chunk.first + chunk.size)
                n[here] = w.counts
                total[here] = np.bincount(w.doc, held.value[bucket].astype(np.float64), chunk.size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total)], ["doc_id", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sum_up, f"doc_id {kind}, n_features bigint, weight bigint")


def draw(weighed: DataFrame, *, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``weighed`` with score and rank: of the N documents with at least ``least_words`` features the floor(percent N / 100) of
    the highest scores, ties to the smaller id, are ranked 1, 2, 3, ...; all others have a null rank."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = settle(weighed.withColumn("score", (F.col("weight") + noise).cast("bigint")))
    able = F.col("n_features") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place = scored.where(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    place = settle(place.withColumns({"__range": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = place.groupBy("__range").agg(F.count("*").alias("n"))
    offsets = sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    wanted = place.count() * percent // 100
    rank = F.col("__before") + F.col("__row") + 1
    ranked = place.join(F.broadcast(offsets), "__range").withColumn("rank", F.when(rank <= wanted, rank))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*rest.columns).unionAll(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", *, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, drawn towards the texts of ``target``."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    return draw(weigh(docs, gain, id_col, text_col), percent=percent, least_words=least_words, seed=seed)
