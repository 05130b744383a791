"""The run log: one appended row per run, read by the run log operators."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.sources import paths

# Job run status codes (see functions.status.JOB_STATUS).
SUCCESS, FAILED, SKIPPED = 2, 3, 4

SCHEMA = (
    "run_id string, job string, source string, target string, partition_no int, "
    "method string, status int, rows bigint, batches bigint, started_at timestamp_ntz, "
    "finished_at timestamp_ntz, duration_seconds double, throughput double, message string, "
    "conflicts bigint, rows_left bigint"
)


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def new_run_id() -> str:
    return uuid.uuid4().hex


@dataclass(frozen=True)
class RunResult:
    """What a run did. ``batches`` counts bounded batches; a resumed run repeats its facts.

    ``conflicts`` are rows left where they were because the target has their key with other
    content, ``rows_left`` matching rows that a bounded run did not take.
    """

    run_id: str
    job: str
    source: str
    target: str
    method: str
    status: int
    rows: int = 0
    batches: int = 0
    partition_no: int | None = None
    started_at: datetime | None = None
    finished_at: datetime | None = None
    message: str | None = None
    conflicts: int = 0
    rows_left: int = 0

    @property
    def succeeded(self) -> bool:
        return self.status in (SUCCESS, SKIPPED)

    def record(self) -> dict:
        facts = asdict(self)
        start, end = self.started_at, self.finished_at
        seconds = max(0.0, (end - start).total_seconds()) if start and end else None
        facts["duration_seconds"] = seconds
        facts["throughput"] = self.rows / seconds if seconds else 0.0
        return facts


class RunLog:
    """Append-only table of runs in day folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, results) -> None:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows = [tuple(r.record()[n] for n in names) for r in results]
        if rows:
            frame = self.spark.createDataFrame(rows, SCHEMA)
            day = F.to_date(F.coalesce("finished_at", F.lit(utc_now())))
            frame.withColumn("run_date", day).coalesce(1).write.mode("append").partitionBy(
                "run_date"
            ).parquet(self.path)

    def failures_in_row(self, job: str) -> int:
        """Failed runs of a job since its last run that did not fail."""
        if not paths.exists(self.spark, self.path):
            return 0
        runs = self.read().filter(F.col("job") == job).select("status", "finished_at")
        failed = F.col("status") == FAILED
        last_good = runs.agg(F.max(F.when(~failed, F.col("finished_at")))).scalar()
        since = last_good.isNull() | (F.col("finished_at") > last_good)
        return runs.filter(failed & since).count()

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA + ", run_date date").parquet(self.path)
