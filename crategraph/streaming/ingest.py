"""Feeds into versioned tables, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crategraph.sources import sinks


def into_versions(stream: DataFrame, root: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Each batch is merged with the newest version into the next one. A batch that is run again finds its version written and
    is skipped, so a restart changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        known = sinks.versions(spark, root)
        if number + 1 in known:
            return
        base = sinks.load_version(spark, root) if known else batch.limit(0)
        sinks.save_version(merge(base, batch), root, number + 1, unfinished="overwrite")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, length: str = "30 days", lateness: str = "7 days") -> DataFrame:
    """Counts by time window; rows later than ``lateness`` are dropped once their window has been closed."""
    e = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", lateness)
    return e.groupBy(F.window("__at", length).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_seen(events: DataFrame, key: list[str], at: str, lateness: str = "1 day") -> DataFrame:
    """Each key once within the lateness: repeats of a feed are dropped."""
    return events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", lateness).dropDuplicatesWithinWatermark(key).drop("__at")


def live_cache(entries: DataFrame, now) -> DataFrame:
    """Cached search results that have not expired."""
    return entries.where(F.col("expires_at") > now)
