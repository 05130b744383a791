"""Analysis of the run log: dashboards, statistics, streaks, recent and stale tasks."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.functions.metrics import audit_text, job_time
from frostline.functions.names import free_names
from frostline.operators.ordering import global_rank, with_segments

# Row counts used when none (or a non-positive one) is given, and the
# heartbeat time-out.
HEARTBEAT_TIMEOUT = timedelta(minutes=5)


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def job_dashboard(
    jobs: DataFrame, today: date, tz="UTC", *, enabled, status, last_run, total_rows,
    success, failed, running,
) -> DataFrame:
    """Totals over all jobs and today's runs; ``tz`` says whose today it is.

    ``last_run`` is in UTC. The mean is cut to a whole number.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(last_run))
    ran_today = F.to_date(local) == F.lit(today)
    state = F.col(status)
    counted = jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        _count(F.col(enabled)).alias("enabled_jobs"),
        _count(state == running).alias("running_jobs"),
        _count(ran_today).alias("today_runs"),
        _count(ran_today & (state == success)).alias("today_success"),
        _count(ran_today & (state == failed)).alias("today_failed"),
        F.coalesce(F.sum(total_rows), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.avg(total_rows), F.lit(0)).cast("bigint").alias("mean_rows"),
    )
    return counted.withColumn(
        "today_success_rate", _share(F.col("today_success"), F.col("today_runs"))
    )


def job_stats(runs: DataFrame, *, job, status, rows, success, failed, skipped) -> DataFrame:
    """Per job: finished runs by outcome, success rate, rows and mean rows per run.

    Only terminal states count as runs; ``raw_updates`` counts every logged state.
    """
    state = F.col(status)
    done = state.isin(success, failed, skipped)
    return (
        runs.groupBy(job)
        .agg(
            _count(done).alias("runs"),
            _count(state == success).alias("success"),
            _count(state == failed).alias("failed"),
            _count(state == skipped).alias("skipped"),
            F.count(F.lit(1)).alias("raw_updates"),
            F.coalesce(F.sum(F.when(state == success, F.col(rows))), F.lit(0))
            .cast("bigint")
            .alias("archived_rows"),
        )
        .withColumn("success_rate", _share(F.col("success"), F.col("runs")))
        .withColumn(
            "mean_rows", F.when(F.col("runs") > 0, F.expr("archived_rows div runs")).otherwise(0)
        )
    )


def job_stats_legacy(jobs: DataFrame, *, job, updates, streak, rows) -> DataFrame:
    """Statistics from the job row alone: failures are the current streak, skips are 0."""
    total, failures = F.col(updates), F.col(streak)
    return jobs.select(
        job,
        total.alias("runs"),
        (total - failures).alias("success"),
        failures.alias("failed"),
        F.lit(0).cast("bigint").alias("skipped"),
        _share(total - failures, total).alias("success_rate"),
        F.when(total > 0, F.expr(f"`{rows}` div `{updates}`")).otherwise(0).alias("mean_rows"),
    )


def batch_summary(results: DataFrame, *, succeeded, rows) -> DataFrame:
    """Tasks of a batch run by outcome, and the rows of the successful ones."""
    good = F.coalesce(F.col(succeeded), F.lit(False))
    return results.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(good).alias("success"),
        F.count_if(~good).alias("failed"),
        F.coalesce(F.sum(F.when(good, F.col(rows))), F.lit(0)).cast("bigint").alias("rows"),
    )


def status_counts(jobs: DataFrame, status: str) -> DataFrame:
    return jobs.groupBy(status).agg(F.count(F.lit(1)).alias("jobs"))


def max_retry(history: DataFrame, *, job, states) -> DataFrame:
    """Highest retry count per job; ``states`` is an array of (name, created_at, data).

    The key is matched without regard to case and text that is no integer is skipped.
    """
    pairs = history.select(job, F.explode(states).alias("_s")).select(
        job, F.explode("_s.data").alias("_k", "_v")
    )
    retries = pairs.filter(F.lower("_k") == "retrycount").withColumn(
        "_n", F.trim("_v").try_cast("int")
    )
    return retries.filter(F.col("_n").isNotNull()).groupBy(job).agg(
        F.max("_n").alias("retry_count")
    )


def latest_audit(history: DataFrame, *, job, states) -> DataFrame:
    """Audit text of each job: from the newest state whose result has one, of equally new
    ones the last text in order."""
    told = (
        history.select(job, F.explode(states).alias("_s"))
        .withColumn("_audit", audit_text(F.try_element_at("_s.data", F.lit("Result"))))
        .filter(F.col("_audit").isNotNull())
    )
    return told.groupBy(job).agg(
        F.max_by("_audit", F.struct("_s.created_at", "_audit")).alias("audit")
    )


def ordered_concat(df: DataFrame, group, order: str, column: str, separator=", ") -> DataFrame:
    """Names of each group in order, joined to one text.

    Repeats collapse map-side first, so a group holds its distinct names only.
    """
    group = list(group)
    names = df.select(*group, order, column).distinct()
    listed = names.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(order, column))).alias("_n")
    )
    joined = F.array_join(F.transform("_n", lambda n: n[column].cast("string")), separator)
    return listed.select(*group, joined.alias("names"))


# Latest rows and streaks.


def latest_per(df: DataFrame, key, ts: str, tie=()) -> DataFrame:
    """The latest row of each key, by time and then the tie columns, which should leave no ties.

    The greatest time per key is a hash aggregate over two columns; the rows that have it are
    few, and only they are ranked by the rest.
    """
    keys = [key] if isinstance(key, str) else list(key)
    when, top = free_names(df.columns, "_top", "_row")
    newest = df.groupBy(*keys).agg(F.max(ts).alias(when))
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]
    same.append(F.col(f"r.`{ts}`").eqNullSafe(F.col(f"n.`{when}`")))
    last = df.alias("r").join(newest.alias("n"), same, "left_semi")
    rest = [c for c in df.columns if c not in keys]
    found = last.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias(top))
    return found.select(*keys, f"{top}.*").select(*df.columns)


def latest_log(logs: DataFrame, *, task, ts, entry) -> DataFrame:
    """Latest log entry of each task; equal times fall back on the entry id."""
    return latest_per(logs, task, ts, (entry,))


def config_stages(configs, tasks, *, key, task_key, ts, tie, stage, task_stage) -> DataFrame:
    """Stage of each configuration: that of its latest task, else its own."""
    newest = latest_per(tasks.select(task_key, ts, tie, task_stage), task_key, ts, (tie,)).select(
        F.col(task_key).alias("_task_key"), F.col(task_stage).alias("_stage"), F.col(tie)
    )
    return (
        configs.join(newest, F.col(key) == F.col("_task_key"), "left")
        .withColumn(stage, F.coalesce("_stage", F.col(stage)))
        .select(*configs.columns, F.col(tie).alias("last_task"))
    )


def failure_streak(
    runs: DataFrame, max_failures: int, *, job, ts, tie, status, failed, resets, segment=None
) -> DataFrame:
    """Failures in a row at each run of a job, and whether the job would be disabled.

    A failure adds one, any status in ``resets`` starts over, others leave the count. Histories
    are cut into segments of equally many rows (``with_segments``), so one busy job or day never
    sits in a single task. A segment's summary is the failures after its last reset; composed in
    order they give the count each segment starts with, which leads it in as an extra row.
    """
    seg, fail, reset, real, failed_so_far, at_reset, had_reset, still_open, era, upto = free_names(
        runs.columns, *[f"_{n}" for n in "seg fail reset real sum at had open era upto".split()]
    )
    cut = with_segments(runs, [ts, tie], seg) if segment is None else runs.withColumn(seg, segment)
    state = F.col(status)
    rows = cut.withColumns({
        fail: F.coalesce(state == failed, F.lit(False)).cast("bigint"),
        reset: F.coalesce(state.isin(*resets), F.lit(False)),
        real: F.lit(1),
    })
    inside = Window.partitionBy(job, seg).orderBy(real, ts, tie)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)

    def counted(part):
        """Failures so far in the segment, and those before its last reset."""
        sums = part.withColumn(failed_so_far, F.sum(fail).over(so_far))
        before = F.when(F.col(reset), F.col(failed_so_far) - F.col(fail))
        return sums.withColumn(at_reset, F.coalesce(F.max(before).over(so_far), F.lit(0)))

    narrow = rows.select(job, seg, real, ts, tie, fail, reset)
    ends = counted(narrow).groupBy(job, seg).agg(
        F.max(F.col(reset).cast("int")).alias(had_reset),
        (F.max(failed_so_far) - F.max(at_reset)).alias(still_open),
    )
    across = Window.partitionBy(job).orderBy(seg)  # a row per segment
    stretch = Window.partitionBy(job, era).orderBy(seg)
    lead_in = (
        ends.withColumn(era, F.sum(had_reset).over(across))
        .withColumn(upto, F.sum(still_open).over(stretch))
        .select(
            job, seg, F.lag(upto).over(across).alias(fail), F.lit(False).alias(reset),
            F.lit(0).alias(real),
        )
        .filter(F.col(fail) > 0)
    )
    led = counted(rows.unionByName(lead_in, allowMissingColumns=True)).filter(F.col(real) == 1)
    streak = F.col(failed_so_far) - F.col(at_reset)
    return led.withColumn("streak", streak).select(
        *runs.columns, "streak", ((F.col(fail) == 1) & (streak >= max_failures)).alias("disabled")
    )


# Lists.


# Up to here the head of a list is merged in one task; a deeper slice is ranked over all.
DEEP = 100_000


def _slice(df: DataFrame, order, offset: int, size: int) -> DataFrame:
    """Rows offset + 1 … offset + size of an ordered list. The order should be total."""
    if offset + size <= DEEP:
        return df.orderBy(*order).offset(offset).limit(size)
    ranked = global_rank(df, order, limit=offset + size, name="_rank")
    return ranked.filter(F.col("_rank") > offset).orderBy("_rank").drop("_rank")


def _first(df: DataFrame, order, n) -> DataFrame:
    """The first ``n`` rows in order, or all of them."""
    if n is not None and n <= 0:
        raise ValueError("n must be positive, or None for all rows")
    return df.orderBy(*order) if n is None else _slice(df, order, 0, n)


def recent(tasks, n=None, *, ts, tie, owner=None, owner_column=None, deleted=None) -> DataFrame:
    """Most recent tasks first, of one owner if given; all of them unless ``n`` is given."""
    if deleted is not None:
        tasks = tasks.filter(~F.coalesce(F.col(deleted), F.lit(False)))
    if owner is not None:
        tasks = tasks.filter(F.col(owner_column) == F.lit(owner))
    return _first(tasks, [F.desc(ts), F.desc(tie)], n)


def _stamp(df: DataFrame, column: str, moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast(df.schema[column].dataType)


def logs_since(logs, task, since=None, n=None, *, task_column, ts, entry) -> DataFrame:
    """Log entries of a task from a time on (inclusive), by time and id; the first ``n`` or all."""
    found = logs.filter(F.col(task_column) == F.lit(task))
    if since is not None:
        found = found.filter(F.col(ts) >= _stamp(logs, ts, since))
    return _first(found, [ts, entry], n)


def page(df: DataFrame, order, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an ordered list, with the total row count on each row."""
    number, size = max(1, number), max(1, size)
    total = df.agg(F.count(F.lit(1))).scalar()
    return _slice(df, order, (number - 1) * size, size).withColumn("total_rows", total)


def stale(tasks, now: datetime, timeout=HEARTBEAT_TIMEOUT, *, status, monitored, heartbeat):
    """Watched tasks whose heartbeat is older than the time-out, oldest first."""
    wait = timeout if timeout > timedelta(0) else HEARTBEAT_TIMEOUT
    edge = _stamp(tasks, heartbeat, now - wait)
    late = tasks.filter(F.col(status).isin(*monitored) & (F.col(heartbeat) < edge))
    return late.orderBy(heartbeat)


def merged_jobs(parts, page_index: int, size: int, tie="job_id") -> DataFrame:
    """Job lists of several statuses as one, newest first, one page (from 0) of it.

    Each list has any of finished_at, started_at, scheduled_at, created_at.
    """
    times = ("finished_at", "started_at", "scheduled_at", "created_at")
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for missing in [t for t in times if t not in merged.columns]:
        merged = merged.withColumn(missing, F.lit(None).cast(T.TimestampNTZType()))
    index, size = max(0, page_index), max(1, size)
    timed = merged.withColumn("sort_time", job_time(*[F.col(t) for t in times]))
    return _slice(timed, [F.desc("sort_time"), F.desc(tie)], index * size, size)
