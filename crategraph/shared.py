"""Session helpers used across the library: where durable intermediates live and how lineage is cut."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a local one where that is unset and everything runs on
    one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="crategraph-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder for a table or archive that outlives one job."""
    return f"{shared_root(spark)}/crategraph-{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_measured(df: DataFrame, small: DataFrame, on, how: str = "left", max_rows: int = 200_000) -> DataFrame:
    """Join with a settled table that is expected to be small: broadcast if counting it shows at most ``max_rows`` narrow
    rows, else an ordinary shuffle join, whose hot keys adaptive execution splits."""
    from pyspark.sql import functions as F

    return df.join(F.broadcast(small) if small.count() <= max_rows else small, on, how)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by its keys to so many tasks that each has about ``rows`` rows at most, and no fewer than a shuffle has."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def gathered(df: DataFrame, n: int, rows: int) -> DataFrame:
    """``df``, settled and of at most ``n`` rows, read by so many tasks that each has about ``rows`` rows. A table with fewer
    partitions keeps them; one cut finer than its rows call for costs the driver a record, and a shuffle three files, for each task."""
    return df.coalesce(max(1, -(-n // rows)))


def release_shuffles(spark: SparkSession) -> None:
    """Let each query remove its shuffle files when it ends, rather than whenever the driver collects its garbage. For jobs of many
    settled steps; it holds for the session. What was removed is made again if it is asked for."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def give_back() -> None:
    """Return what this Python process has freed to the system. Arrow's pool and the C library keep it for later use, and on the
    driver it would count beside the JVM's memory for the rest of the session."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def whole_text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let at most ``rows`` rows of whole texts travel to Python in an Arrow batch; a session's lower setting stays. The default of
    10,000 holds tens of MB several times over in each task."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf)) <= rows:
        spark.conf.set(conf, rows)
