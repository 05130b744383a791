"""Run log analysis and scalar expressions; ``events`` stands in for the log.

A user is a job, an event one logged state: purchase = success, error = failed,
view = skipped, click = running, signup = not started; ``value`` counts rows.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from frostline.functions import metrics, values
from frostline.functions.status import stage_name
from frostline.operators import ordering
from frostline.operators import runlog as rl
from frostline.spec import ValueKind
from frostline.workload.moves import _code
from frostline.workload.registry import query, table


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("n_rows", F.col("value").cast("bigint"))


ROWS = "CAST(trunc(value) AS BIGINT)"
RATE = "CASE WHEN {w} > 0 THEN {p} / {w} * 100 ELSE CAST(0 AS DOUBLE) END"


def _dashboard_sql(shift):
    day = f"CAST(ts + INTERVAL {shift} HOUR AS DATE) = DATE '2024-01-15'"
    return (
        "SELECT *, " + RATE.format(w="today_runs", p="today_success")
        + " AS today_success_rate FROM (SELECT CAST(count(*) AS BIGINT) AS total_jobs, "
        "CAST(count(*) FILTER (WHERE value >= 10) AS BIGINT) AS enabled_jobs, "
        "CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS running_jobs, "
        f"CAST(count(*) FILTER (WHERE {day}) AS BIGINT) AS today_runs, "
        f"CAST(count(*) FILTER (WHERE {day} AND event_type = 'purchase') AS BIGINT) "
        "AS today_success, "
        f"CAST(count(*) FILTER (WHERE {day} AND event_type = 'error') AS BIGINT) AS today_failed, "
        f"CAST(sum({ROWS}) AS BIGINT) AS total_rows, "
        f"CAST(trunc(avg({ROWS})) AS BIGINT) AS mean_rows FROM events)"
    )


def _dashboard(spark, sf, tz):
    jobs = _events(spark, sf).withColumn("enabled", F.col("value") >= 10)
    return rl.job_dashboard(
        jobs, date(2024, 1, 15), tz, enabled="enabled", status="event_type", last_run="ts",
        total_rows="n_rows", success="purchase", failed="error", running="click",
    )


@query(_dashboard_sql(0))
def job_dashboard(spark, sf):
    return _dashboard(spark, sf, "UTC")


@query(_dashboard_sql(8))
def job_dashboard_local_day(spark, sf):
    return _dashboard(spark, sf, "Asia/Shanghai")


@query("SELECT *, " + RATE.format(w="runs", p="success") + " AS success_rate, "
       "CASE WHEN runs > 0 THEN archived_rows // runs ELSE 0 END AS mean_rows FROM ("
       "SELECT user_id, CAST(count(*) FILTER (WHERE event_type IN ('purchase', 'error', 'view')) "
       "AS BIGINT) AS runs, "
       "CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS success, "
       "CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed, "
       "CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS skipped, "
       "CAST(count(*) AS BIGINT) AS raw_updates, "
       f"CAST(coalesce(sum({ROWS}) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) "
       "AS archived_rows FROM events GROUP BY user_id)")
def job_stats(spark, sf):
    return rl.job_stats(
        _events(spark, sf), job="user_id", status="event_type", rows="n_rows",
        success="purchase", failed="error", skipped="view",
    )


@query("SELECT user_id, updates AS runs, updates - streak AS success, streak AS failed, "
       "CAST(0 AS BIGINT) AS skipped, (updates - streak) / updates * 100 AS success_rate, "
       "archived // updates AS mean_rows FROM (SELECT user_id, "
       "CAST(count(*) AS BIGINT) AS updates, "
       "CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS streak, "
       f"CAST(sum({ROWS}) AS BIGINT) AS archived FROM events GROUP BY user_id)")
def job_stats_legacy(spark, sf):
    jobs = _events(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("updates"),
        F.count_if(F.col("event_type") == "error").alias("streak"),
        F.sum("n_rows").alias("archived"),
    )
    return rl.job_stats_legacy(
        jobs, job="user_id", updates="updates", streak="streak", rows="archived"
    )


@query("SELECT CAST(count(*) AS BIGINT) AS tasks, "
       "CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS success, "
       "CAST(count(*) FILTER (WHERE event_type <> 'purchase') AS BIGINT) AS failed, "
       f"CAST(sum({ROWS}) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS rows FROM events")
def batch_summary(spark, sf):
    results = _events(spark, sf).withColumn("ok", F.col("event_type") == "purchase")
    return rl.batch_summary(results, succeeded="ok", rows="n_rows")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS jobs FROM events GROUP BY 1")
def status_counts(spark, sf):
    return rl.status_counts(table(spark, sf, "events"), "event_type")


@query("SELECT user_id, CAST(max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS INTEGER) "
       "AS retry_count FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id")
def max_retry(spark, sf):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    state = F.struct(
        kind.alias("name"),
        F.col("ts").alias("created_at"),
        F.when(kind == "error", F.create_map(F.lit("RetryCount"), k))
        .when(kind == "click", F.create_map(F.lit("RETRYCOUNT"), F.concat(F.lit(" "), k)))
        .when(kind == "view", F.create_map(F.lit("RetryCount"), F.concat(k, F.lit("x"))))
        .otherwise(F.create_map(F.lit("Queue"), k))
        .alias("data"),
    )
    history = table(spark, sf, "events").withColumn("states", F.array(state))
    return rl.max_retry(history, job="user_id", states="states")


# Latest rows, streaks, order checks and batches.


@query("SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'PendingValidation' "
       "WHEN 'click' THEN 'Running' WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' "
       "ELSE 'Cancelled' END AS stage FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
       "ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_task_stage(spark, sf):
    tasks = table(spark, sf, "events").withColumn("status", _code())
    newest = rl.latest_per(tasks, "user_id", "ts", ("event_id",))
    return newest.select("user_id", "event_id", "ts", stage_name(F.col("status")).alias("stage"))


@query("SELECT event_id, user_id, ts, event_type, value, props FROM (SELECT *, row_number() OVER "
       "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_log_entry(spark, sf):
    logs = table(spark, sf, "events")
    found = rl.latest_log(logs, task="user_id", ts="ts", entry="event_id")
    return found.select("event_id", "user_id", "ts", "event_type", "value", "props")


@query("SELECT event_id, user_id, streak, is_fail AND streak >= 2 AS disabled FROM (SELECT *, "
       "CAST(sum(CASE WHEN is_fail THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island "
       "ORDER BY ts, event_id) AS BIGINT) AS streak FROM (SELECT event_id, user_id, ts, "
       "event_type = 'error' AS is_fail, sum(CASE WHEN event_type IN ('purchase', 'view') THEN 1 "
       "ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events))")
def failure_streak(spark, sf):
    streaks = rl.failure_streak(
        table(spark, sf, "events"), 2, job="user_id", ts="ts", tie="event_id",
        status="event_type", failed="error", resets=("purchase", "view"),
    )
    return streaks.select("event_id", "user_id", "streak", "disabled")


@query("SELECT event_id, user_id, value, previous FROM (SELECT *, lag(value) OVER ("
       "PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) "
       "WHERE previous >= value")
def adjacent_violations(spark, sf):
    found = ordering.adjacent_violations(
        table(spark, sf, "events"), "value", ["user_id"], ["ts", "event_id"]
    )
    return found.select("event_id", "user_id", "value", "previous")


@query("SELECT o_orderkey, r AS row_rank, (r - 1) // 500 + 1 AS batch_no FROM (SELECT o_orderkey, "
       "row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)")
def assign_batches(spark, sf):
    found = ordering.assign_batches(table(spark, sf, "orders"), ["o_orderkey"], 500)
    return found.select("o_orderkey", "row_rank", "batch_no")


@query("SELECT o_orderkey, o_orderdate, r AS row_rank, (r - 1) // 500 + 1 AS batch_no FROM ("
       "SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders) "
       "WHERE r <= 5000")
def assign_batches_capped(spark, sf):
    found = ordering.assign_batches(
        table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 500, 5000
    )
    return found.select("o_orderkey", "o_orderdate", "row_rank", "batch_no")


@query("SELECT l_returnflag, r AS row_rank FROM (SELECT l_returnflag, "
       "row_number() OVER (ORDER BY l_returnflag) AS r FROM lineitem)")
def rank_with_ties(spark, sf):
    flags = table(spark, sf, "lineitem").select("l_returnflag")
    return ordering.global_rank(flags, ["l_returnflag"], unique=False)


# Ordered lists.


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_tasks(spark, sf):
    found = rl.recent(table(spark, sf, "events"), 20, ts="ts", tie="event_id")
    return found.select("event_id", "ts")


@query("SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 5")
def recent_tasks_of_owner(spark, sf):
    found = rl.recent(
        table(spark, sf, "events"), 5, ts="ts", tie="event_id", owner=7, owner_column="user_id"
    )
    return found.select("event_id", "ts")


@query("SELECT event_id, ts FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '2024-01-10' "
       "ORDER BY ts, event_id")
def logs_since(spark, sf):
    found = rl.logs_since(
        table(spark, sf, "events"), 3, datetime(2024, 1, 10), task_column="user_id", ts="ts",
        entry="event_id",
    )
    return found.select("event_id", "ts")


@query("SELECT o_orderkey, o_totalprice, (SELECT CAST(count(*) AS BIGINT) FROM orders) "
       "AS total_rows FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 75")
def page_of_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rl.page(orders, [F.desc("o_totalprice"), "o_orderkey"], 4, 25)


@query("SELECT event_id, ts FROM events WHERE event_type IN ('click', 'signup') "
       "AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 MINUTE")
def stale_tasks(spark, sf):
    found = rl.stale(
        table(spark, sf, "events"), datetime(2024, 1, 20), timedelta(0), status="event_type",
        monitored=("click", "signup"), heartbeat="ts",
    )
    return found.select("event_id", "ts")


@query("SELECT job_id, status, sort_time FROM (SELECT event_id AS job_id, CASE event_type "
       "WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Processing' "
       "WHEN 'signup' THEN 'Scheduled' ELSE 'Enqueued' END AS status, CASE event_type "
       "WHEN 'purchase' THEN ts + INTERVAL 2 HOUR WHEN 'click' THEN ts + INTERVAL 1 HOUR "
       "ELSE ts END AS sort_time FROM events) "
       "ORDER BY sort_time DESC, job_id DESC LIMIT 40 OFFSET 80")
def merged_job_list(spark, sf):
    events = table(spark, sf, "events")

    def part(kind, status, **times):
        rows = events.filter(F.col("event_type") == kind)
        return rows.select(
            F.col("event_id").alias("job_id"),
            F.lit(status).alias("status"),
            F.col("ts").alias("created_at"),
            *[(F.col("ts") + F.expr(v)).alias(k) for k, v in times.items()],
        )

    hour = "INTERVAL '{}' HOUR"
    parts = [
        part("view", "Enqueued"),
        part("signup", "Scheduled", scheduled_at=hour.format(0)),
        part("click", "Processing", started_at=hour.format(1)),
        part("purchase", "Succeeded", started_at=hour.format(1), finished_at=hour.format(2)),
        part("error", "Failed", finished_at=hour.format(0)),
    ]
    return rl.merged_jobs(parts, 2, 40).select("job_id", "status", "sort_time")


# Scalar expressions.


@query("SELECT o_orderkey, TRY_CAST(o_orderkey AS INTEGER) AS as_int, "
       "TRUE AS rejected, date_trunc('day', o_orderdate)::DATE AS as_date, "
       "o_orderdate AS as_time, "
       "'0000abcd-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS as_guid "
       "FROM orders")
def parse_boundaries(spark, sf):
    key = F.col("o_orderkey").cast("string")
    guid = F.concat(F.lit("{0000ABCD-0000-4000-8000-"), F.lpad(key, 12, "0"), F.lit("}"))
    parse = values.parse_boundary
    return table(spark, sf, "orders").select(
        "o_orderkey",
        parse(F.concat(F.lit(" "), key), ValueKind.INT).alias("as_int"),
        parse(F.col("o_orderpriority"), ValueKind.BIGINT).isNull().alias("rejected"),
        parse(F.date_format("o_orderdate", "yyyy-MM-dd"), ValueKind.DATE).alias("as_date"),
        parse(F.col("o_orderdate").cast("string"), ValueKind.DATETIME2).alias("as_time"),
        parse(guid, ValueKind.GUID).alias("as_guid"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '''%Y-%m-%d''') AS as_date, "
       "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS as_time, "
       "strftime(o_orderdate, '''%Y-%m-%d %H:%M:%S.%f0''') AS as_time2, "
       "CAST(o_orderkey AS VARCHAR) AS as_int, "
       "'''it''''s ' || o_orderpriority || '''' AS as_text FROM orders")
def boundary_literals(spark, sf):
    text = F.concat(F.lit("it's "), F.col("o_orderpriority"))
    when, literal = F.col("o_orderdate"), values.boundary_literal
    return table(spark, sf, "orders").select(
        "o_orderkey",
        literal(when, ValueKind.DATE).alias("as_date"),
        values.boundary_text(when, ValueKind.DATETIME).alias("as_time"),
        literal(when, ValueKind.DATETIME2).alias("as_time2"),
        literal(F.col("o_orderkey"), ValueKind.BIGINT).alias("as_int"),
        literal(text, ValueKind.STRING).alias("as_text"),
    )


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'run ' || event_id END "
       "AS audit FROM events")
def audit_texts(spark, sf):
    kind = F.col("event_type")
    plain = F.to_json(F.struct(F.concat(F.lit("run "), "event_id").alias("AuditMarkdown")))
    wrapped = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"'))
    result = (
        F.when(kind == "click", plain)
        .when(kind == "view", wrapped)
        .when(kind == "purchase", F.lit("null"))
        .when(kind == "error", F.lit("not json"))
        .otherwise(F.lit('{"AuditMarkdown": " "}'))
    )
    return table(spark, sf, "events").select(
        "event_id", metrics.audit_text(result).alias("audit")
    )


@query("SELECT user_id, arg_max('run ' || event_id, ts) AS audit FROM events "
       "WHERE event_type IN ('purchase', 'view') GROUP BY user_id")
def latest_audit(spark, sf):
    kind = F.col("event_type")
    told = F.to_json(F.struct(F.concat(F.lit("run "), "event_id").alias("AuditMarkdown")))
    result = F.when(kind.isin("purchase", "view"), told).otherwise(F.lit("null"))
    state = F.struct(
        kind.alias("name"),
        F.col("ts").alias("created_at"),
        F.create_map(F.lit("Result"), result).alias("data"),
    )
    history = table(spark, sf, "events").withColumn("states", F.array(state))
    return rl.latest_audit(history, job="user_id", states="states")


@query("SELECT c_custkey, coalesce(t.event_type, 'draft') AS stage FROM customer LEFT JOIN ("
       "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
       "ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1) t "
       "ON c_custkey = t.user_id")
def config_stages(spark, sf):
    configs = table(spark, sf, "customer").select("c_custkey", F.lit("draft").alias("stage"))
    found = rl.config_stages(
        configs, table(spark, sf, "events"), key="c_custkey", task_key="user_id", ts="ts",
        tie="event_id", stage="stage", task_stage="event_type",
    )
    return found.select("c_custkey", "stage")


STOP = "TIMESTAMP '2024-01-15'"
GAP = f"greatest(CAST(0 AS DOUBLE), date_diff('microsecond', ts, {STOP}) / 1000000.0)"


@query(f"SELECT event_id, CASE WHEN event_type = 'click' THEN value / 1000 ELSE {GAP} END "
       f"AS seconds, CASE WHEN {GAP} > 0 THEN value / {GAP} ELSE CAST(0 AS DOUBLE) END AS rate, "
       "CASE WHEN user_id = 0 THEN CAST(0 AS DOUBLE) ELSE "
       "least(CAST(100 AS DOUBLE), value / user_id * 100) END AS percent FROM events")
def run_metrics(spark, sf):
    stop = F.lit("2024-01-15").cast("timestamp_ntz")
    given = F.when(F.col("event_type") == "click", F.col("value"))
    took = metrics.seconds_between(F.col("ts"), stop)
    return table(spark, sf, "events").select(
        "event_id",
        metrics.duration_seconds(given, F.col("ts"), stop).alias("seconds"),
        metrics.throughput(F.col("value"), took).alias("rate"),
        metrics.percent_complete(F.col("value"), F.col("user_id")).alias("percent"),
    )
