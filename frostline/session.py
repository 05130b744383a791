"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", app: str = "frostline", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


# What a large cluster should set beside its own sizes; all are standard Spark settings.
CLUSTER_SETTINGS = {
    # Runtime plans: split skewed joins and rebalanced writes, pack small partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Size of a rebalanced write's tasks, and so of the files of a partitioned table.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # Merge a task's heartbeats into sessions before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.session.timeZone": "UTC",
}


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="frostline-")


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_root()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, label: str) -> DataFrame:
    """Write once and read back, so later passes see the very same rows.

    Used where a plan is read twice and must not be evaluated twice (sampled range
    bounds, row positions). The table survives the loss of an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
