"""Temperature mixing of sources, in DataFrame functions only.

Token shares p of the sources are raised to an exponent t and normalised to weights. The exponent is bisected so that the
weights reach an entropy, or so that no source repeats more than a limit. The budget is the least one at which every source
is read at least once in full, so nothing is lost: sources below their weight repeat. A source's weight times the budget is
its quota. Its documents are read in permutation order, a fresh permutation for each epoch, the last epoch up to the quota.
The whole mixture is a sequence of blocks, each of which takes from every source its weight's share of ``block_tokens``.

Prefix sums over a permutation are taken in two steps, so that a source with a third of all rows is never in one task:
documents fall by hash into buckets of at least 500 documents, bucket totals are summed along the permutation, and the
rest within each bucket.

Defined results: a null source is a source of its own; a null or empty text has no tokens and is read once per epoch; a
source without tokens is read once; repeated rows are read once each; with an empty table the result is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crategraph.shared import join_measured, settle

WORD = r"[^\x20\x09-\x0D]+"
PROBES = 15
KEY, TOKENS, MARK = "__mix_key", "__mix_tokens", "__mix_mark"


@dataclass
class Plan:
    """``sources``: __mix_key, source, docs, tokens, weight, epochs, buckets (settled, one row a source)."""

    sources: DataFrame
    exponent: float
    budget: float
    seed: int


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.col(source_col).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({
        KEY: F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)),
        TOKENS: F.regexp_count(text, F.lit(WORD)).cast("long"),
        MARK: F.xxhash64(F.col(id_col), text),
    })


def _place(seed: int, epoch: Column) -> Column:
    """A document's place in the permutation of an epoch, in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(MARK, F.lit(seed), epoch.cast("int")), 11) * F.lit(2.0**-53)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, repetition_limit: float | None = 4.0, target_entropy: float | None = None, seed: int = 0) -> Plan:
    """Weights of the sources. ``target_entropy`` (nats) has precedence over ``repetition_limit``; a value out of reach gives
    the nearest exponent in [0, 1]."""
    keyed = _keyed(docs, id_col, text_col, source_col)
    sources = settle(keyed.groupBy(KEY).agg(F.count("*").alias("docs"), F.sum(TOKENS).alias("tokens")))
    full = sources.where("tokens > 0")
    total, most, least = full.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not total:
        exponent, norm, budget, most, total = 1.0, 1.0, 0.0, 1, 1
    else:
        exponent = _bisect(full, total, most, least, target_entropy, repetition_limit)
        norm = full.agg(F.sum(F.pow(F.col("tokens") / total, F.lit(exponent)))).first()[0]
        budget = most * norm / (most / total) ** exponent  # the largest source is read exactly once
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(exponent)) / norm).otherwise(0.0)
    epochs = F.when(F.col("tokens") > 0, F.greatest(F.lit(1.0), F.round(weight * budget / F.col("tokens"), 9))).otherwise(1.0)
    buckets = F.ceil(F.col("docs") / F.greatest(F.lit(500.0), F.sqrt("docs")))
    return Plan(settle(sources.withColumns({"weight": weight, "epochs": epochs, "buckets": buckets})), exponent, budget, seed)


def _bisect(sources: DataFrame, total: int, most: int, least: int, entropy: float | None, limit: float | None) -> float:
    """The exponent in [0, 1], by repeated section: each pass over the source totals tries ``PROBES`` values inside the
    bracket and keeps the section where the criterion changes."""
    if entropy is None and (limit is None or most / least <= limit):
        return 1.0 if limit is None else 0.0

    def gives(values: list[float]) -> list[bool]:
        """Whether each exponent is large enough."""
        if entropy is None:
            return [(most / least) ** (1 - t) <= limit for t in values]
        p = F.col("tokens") / total
        sums = sources.agg(*(c for t in values for c in (F.sum(F.pow(p, F.lit(t))), F.sum(F.pow(p, F.lit(t)) * F.log(p))))).first()
        return [math.log(sums[2 * k]) - t * sums[2 * k + 1] / sums[2 * k] <= entropy for k, t in enumerate(values)]

    low, high = 0.0, 1.0
    if entropy is not None and not gives([1.0])[0]:
        return 1.0
    while high - low > 1e-9:
        values = [low + (high - low) * (k + 1) / (PROBES + 1) for k in range(PROBES)]
        enough = gives(values)
        first = enough.index(True) if True in enough else PROBES
        low, high = ([low, *values, high])[first : first + 2]
    return high


def realise(docs: DataFrame, p: Plan, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block_tokens: int = 1 << 20) -> DataFrame:
    """One row per reading of a document: id, source, n_tokens, epoch, the block it falls into and its rank key there."""
    keyed = _keyed(docs, id_col, text_col, source_col).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), KEY, TOKENS, MARK)
    df = join_measured(keyed, p.sources, KEY).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("epochs").cast("int") - 1)))
    df = df.withColumn("place", _place(p.seed, F.col("epoch"))).withColumn("bucket", F.floor(F.col("place") * F.col("buckets")))
    totals = df.groupBy(KEY, "epoch", "bucket").agg(F.sum(TOKENS).alias("inside"))
    along = Window.partitionBy(KEY, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(KEY, "epoch", "bucket", F.coalesce(F.sum("inside").over(along), F.lit(0)).alias("offset"))
    within = Window.partitionBy(KEY, "epoch", "bucket").orderBy("place", MARK, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(offsets, [KEY, "epoch", "bucket"])
    before = F.col("offset") + F.coalesce(F.sum(TOKENS).over(within), F.lit(0))
    df = df.withColumn("start", F.col("epoch") * F.col("tokens") + before)
    df = df.where((F.col("epoch") == 0) | (F.col("start") < F.col("epochs") * F.col("tokens")))
    block = F.when(F.col("weight") > 0, F.floor(F.col("start") / (F.col("weight") * block_tokens))).otherwise(0).cast("long")
    df = df.withColumn("block", block)
    return df.select("doc_id", "source", F.col(TOKENS).alias("n_tokens"), F.col("epoch").cast("long").alias("epoch"), "block", F.xxhash64(MARK, F.lit(p.seed), "epoch", "block").alias("rank_key"), F.round("weight", 9).alias("weight"))


def apply(docs: DataFrame, p: Plan, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mixture reads it; columns as in ``docs``.

    Texts hardly move: in the last, partial epoch all buckets before the one where the quota ends are read and all after it
    are not; only that one bucket of each source is shuffled and sorted."""
    keyed = _keyed(docs, id_col, text_col, source_col)
    df = join_measured(keyed, p.sources.withColumnsRenamed({c: f"__mix_{c}" for c in ("docs", "tokens", "weight", "epochs", "buckets")} | {"tokens": "__mix_total"}), KEY)
    last = (F.ceil("__mix_epochs") - 1).cast("int")  # the last epoch's number; 0 where a source is read once
    df = df.withColumn("__mix_place", _place(p.seed, last)).withColumn("__mix_bucket", F.floor(F.col("__mix_place") * F.col("__mix_buckets")))
    room = (F.col("__mix_epochs") - last) * F.col("__mix_total")
    totals = settle(df.where(last > 0).groupBy(KEY, "__mix_bucket").agg(F.sum(TOKENS).alias("inside"), F.first(room).alias("room")))
    along = Window.partitionBy(KEY).orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = totals.withColumn("offset", F.coalesce(F.sum("inside").over(along), F.lit(0))).where("offset < room")
    edge = settle(edge.groupBy(KEY).agg(F.max("__mix_bucket").alias("__mix_edge"), F.max("offset").alias("__mix_offset")))
    df = join_measured(df, edge, KEY)
    columns = docs.columns
    repeated = F.explode(F.array_repeat(F.lit(0), F.when(last == 0, 1).otherwise(last + (F.col("__mix_bucket") < F.col("__mix_edge")).cast("int"))))
    whole = df.withColumn("__mix_copy", repeated)
    within = Window.partitionBy(KEY, "__mix_bucket").orderBy("__mix_place", MARK, F.col(id_col)).rowsBetween(Window.unboundedPreceding, -1)
    partial = df.where((last > 0) & (F.col("__mix_bucket") == F.col("__mix_edge")))
    partial = partial.withColumn("__mix_before", F.col("__mix_offset") + F.coalesce(F.sum(TOKENS).over(within), F.lit(0))).where(F.col("__mix_before") < room)
    return whole.select(*columns).unionByName(partial.select(*columns))
