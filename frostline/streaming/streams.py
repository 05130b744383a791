"""Streaming forms: continuous archive, stale heartbeats, tail of the task log."""

from __future__ import annotations

import zlib
from datetime import datetime
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.operators.checks import guard_duplicates
from frostline.operators.joins import within_keys_of
from frostline.plans.archive import archive_bounded, archive_move, job_predicate
from frostline.sources import paths
from frostline.sources.store import Store
from frostline.spec import ArchiveJob


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_tick=None,
                glob=None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_tick is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_tick)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_tick=None):
    """The files of a stored table: those in its folder, or the one file that it is."""
    if paths.is_folder(spark, path):
        return file_stream(spark, path, schema, files_per_tick)
    folder, _, name = path.rstrip("/").rpartition("/")
    return file_stream(spark, folder, schema, files_per_tick, name)


def archive_stream(stream: DataFrame, job: ArchiveJob, checkpoint: str, interval=None):
    """Archive matching rows of each tick; a tick that is replayed adds nothing.

    ``interval`` keeps the query running; without it, it works off what is there and
    ends. How much a tick takes is set on the stream (files per tick).
    """
    spark = stream.sparkSession
    target = Store(spark, job.target)
    target.ensure(stream.drop(*job.exclude).schema)
    predicate = job_predicate(job, stream.schema)
    origin = f"{job.name}-{zlib.crc32(checkpoint.encode()):08x}"

    def tick(rows: DataFrame, number: int) -> None:
        base = target.snapshot()
        if number <= base.runs.get(origin, {"tick": -1})["tick"]:
            return
        found = rows.filter(predicate).drop(*job.exclude)
        if job.keys and base.parts and job.on_duplicate != "append":
            there = within_keys_of(base.read(spark), found, job.keys)
            found = guard_duplicates(found, there, job.keys, job.on_duplicate)
        target.append(found, origin, {"tick": number})

    writer = stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def move_stream(
    spark: SparkSession, job: ArchiveJob, checkpoint: str, interval=None, moves_per_tick=None
):
    """Move matching rows of a stored table to its target as they come.

    The table's own list of commits is the stream: a new version starts a tick, and a tick is a
    series of bounded moves of at most ``job.max_rows`` rows (one move of all matching rows where
    that is unset), ended by one that finds nothing left or after ``moves_per_tick``. A move is
    a commit too, so a backlog left by that limit starts the next tick by itself; the stream
    comes to rest once a tick finds no row.

    A move's run id comes from the checkpoint, the tick and its place in the tick: a replayed
    tick takes up the very moves it had begun and adds nothing twice.

    ``interval`` keeps the query running; without it, it works off the commits that are there in
    one tick and ends, and a backlog waits for the next start. Moves always begin with the newest
    version. Jobs that keep their source rows are for ``archive_stream``.
    """
    if not job.delete_source:
        raise ValueError("a moving stream needs a job that deletes its source rows")
    if moves_per_tick is not None and moves_per_tick < 1:
        raise ValueError("moves_per_tick must be positive, or None for no limit")
    source = Store(spark, job.source)
    source.snapshot()  # there must be a table
    origin = f"{job.name}-{zlib.crc32(checkpoint.encode()):08x}"
    move = archive_move if job.max_rows is None else archive_bounded

    def tick(commits: DataFrame, number: int) -> None:
        for place in count():
            result = move(spark, job, f"{origin}-{number}-{place}")
            if not result.rows_left or place + 1 == moves_per_tick:
                return

    # Only that there are new commits matters, not what they say: no commit is read.
    commits = spark.readStream.schema("value string").option("pathGlobFilter", "[0-9]*.json")
    writer = commits.text(source.commits_path()).writeStream.foreachBatch(tick)
    writer = writer.option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def stale_stream(
    beats: DataFrame, *, task, ts, status, terminal=(), timeout="5 minutes", delay
) -> DataFrame:
    """Tasks whose heartbeat stopped for the time-out, each reported once per silence.

    A session window closes exactly when no heartbeat came for that long; sessions
    that ended in a terminal status are no failure. Heartbeats later than ``delay`` behind
    the newest one are dropped, so it has to cover the disorder of the source.
    """
    sessions = (
        beats.withWatermark(ts, delay)
        .groupBy(F.col(task), F.session_window(ts, timeout).alias("_beat"))
        .agg(
            F.max(ts).alias("last_heartbeat"),
            F.max_by(status, ts).alias("last_status"),
            F.count(F.lit(1)).alias("heartbeats"),
        )
    )
    if terminal:
        sessions = sessions.filter(~F.col("last_status").isin(*terminal))
    return sessions.select(
        task, "last_heartbeat", F.col("_beat.end").alias("stale_at"), "last_status", "heartbeats"
    )


def tail_logs(stream: DataFrame, *, ts, task=None, task_column=None, since: datetime | None = None):
    """Log entries as they come; the query's checkpoint is the cursor after the start."""
    if task is not None:
        stream = stream.filter(F.col(task_column) == F.lit(task))
    if since is not None:
        edge = F.lit(since.isoformat(sep=" ")).cast(stream.schema[ts].dataType)
        stream = stream.filter(F.col(ts) >= edge)
    return stream
