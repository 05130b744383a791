"""Archive jobs, partition maintenance and streams, run on copies of whole tables.

Each query runs its job in a new folder under the shared scratch folder and returns
what the job left behind. The given files are adopted as the source and only read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.plans import archive as ar
from frostline.plans import maintain as mt
from frostline.plans import profiles
from frostline.plans.runs import RunLog
from frostline.session import scratch_path
from frostline.sources import files
from frostline.sources.store import Store
from frostline.spec import ArchiveJob, PartitionSpec, ValueKind
from frostline.streaming import streams
from frostline.workload.registry import AS_OF, YEARS, by_year, pno_sql, query, table

OLD = "o_orderdate <= TIMESTAMP '2001-08-02' - INTERVAL 1000 DAY"


def _adopted(spark, sf, name="orders"):
    root = scratch_path(spark, "job")
    store = Store(spark, f"{root}/{name}")
    store.adopt(f"{sf}/{name}.parquet")
    return root, store


def _job(root, **given) -> ArchiveJob:
    settings = dict(
        name="orders-1000-days", source=f"{root}/orders", target=f"{root}/archive",
        filter_column="o_orderdate", where="<= DATEADD(DAY, -1000, GETDATE())",
        keys=("o_orderkey",), as_of=AS_OF,
    )
    return ArchiveJob(**{**settings, **given})


def _partitioned(spark, sf):
    root, store = _adopted(spark, sf)
    mt.to_partitioned(spark, store.path, by_year())
    return root, store


def _numbered(spark, store: Store):
    """Rows with the partition they are stored in, read partition by partition."""
    parts = [
        store.read(n).withColumn("pno", F.lit(n))
        for n in range(1, store.snapshot().spec.partition_count + 1)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT * FROM lineitem")
def append_rows(spark, sf):
    items = table(spark, sf, "lineitem")
    store = Store(spark, scratch_path(spark, "append"))
    store.append(items, "first")
    store.append(items, "first")  # the same run again adds nothing
    return store.read()


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def export_and_load_text(spark, sf):
    documents = table(spark, sf, "documents")
    path = scratch_path(spark, "export")
    files.export(documents, path, "unicode")
    return files.load(spark, path, documents.schema, "unicode")


@query("SELECT * FROM events")
def export_and_load_char(spark, sf):
    events = table(spark, sf, "events")
    path = scratch_path(spark, "export")
    files.export(events, path, "char")
    return files.load(spark, path, events.schema, "char")


@query("SELECT * FROM documents")
def export_and_load_lines(spark, sf):
    """Texts with their line breaks, one record a line, so that files can be split."""
    documents = table(spark, sf, "documents")
    path = scratch_path(spark, "export")
    files.export(documents, path, "lines")
    return files.load(spark, path, documents.schema, "lines")


@query("SELECT event_id % 10 = 0 AS was_rejected, CAST(count(*) AS BIGINT) AS rows FROM events "
       "GROUP BY 1")
def load_with_rejects(spark, sf):
    """Every tenth row of a text export holds no number where one is due."""
    events = table(spark, sf, "events")
    path = scratch_path(spark, "export")
    broken = F.when(F.col("event_id") % 10 == 0, F.lit("no number"))
    texts = events.withColumn("value", F.coalesce(broken, F.col("value").cast("string")))
    files.export(texts, path, "char")
    good = files.load(spark, path, events.schema, "char", max_errors=None)
    bad = files.rejected(spark, path, events.schema, "char")
    sides = [df.select(F.lit(flag).alias("was_rejected")) for df, flag in ((good, False), (bad, True))]
    return sides[0].unionByName(sides[1]).groupBy("was_rejected").agg(F.count(F.lit(1)).alias("rows"))


@query(f"SELECT * FROM orders WHERE {OLD}")
def archive_copy(spark, sf):
    root, _ = _adopted(spark, sf)
    job = _job(root, delete_source=False)
    ar.archive_copy(spark, job)
    ar.archive_copy(spark, job)  # nothing new the second time
    return Store(spark, job.target).read()


def _moved(spark, sf):
    root, store = _adopted(spark, sf)
    ar.archive_move(spark, _job(root))
    return store, Store(spark, f"{root}/archive")


@query(f"SELECT * FROM orders WHERE {OLD}")
def archive_move_target(spark, sf):
    return _moved(spark, sf)[1].read()


@query(f"SELECT * FROM orders WHERE NOT ({OLD})")
def archive_move_source(spark, sf):
    return _moved(spark, sf)[0].read()


FIRST = f"(SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE {OLD})"


def _bounded(spark, sf):
    root, store = _adopted(spark, sf)
    job = _job(root, batch_size=500, max_rows=2000)
    ar.archive_bounded(spark, job)
    ar.archive_bounded(spark, job)
    return store, Store(spark, job.target)


@query(f"SELECT * EXCLUDE (r) FROM {FIRST} WHERE r <= 4000")
def archive_bounded_target(spark, sf):
    return _bounded(spark, sf)[1].read()


@query(f"SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {FIRST} "
       "WHERE r <= 4000)")
def archive_bounded_source(spark, sf):
    return _bounded(spark, sf)[0].read()


def _repeated_keys(spark, sf):
    """Three runs over rows that share keys, cut in the middle of a key's rows."""
    root, store = _adopted(spark, sf, "lineitem")
    job = ArchiveJob(
        name="items", source=store.path, target=f"{root}/archive", filter_column="l_shipdate",
        where="<= DATEADD(DAY, -1000, GETDATE())", keys=("l_orderkey",), as_of=AS_OF,
        batch_size=1, max_rows=1001, on_duplicate="append",
    )
    for _ in range(3):
        ar.archive_bounded(spark, job)
    return store, Store(spark, job.target)


# Which rows of one key go first is open, so the counts per key and the union are compared.
SHIPPED = "l_shipdate <= TIMESTAMP '2001-08-02' - INTERVAL 1000 DAY"


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS rows FROM (SELECT l_orderkey, row_number() "
       f"OVER (ORDER BY l_orderkey) AS r FROM lineitem WHERE {SHIPPED}) WHERE r <= 3003 "
       "GROUP BY l_orderkey")
def archive_bounded_repeated_keys_target(spark, sf):
    rows = _repeated_keys(spark, sf)[1].read().groupBy("l_orderkey")
    return rows.agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT * FROM lineitem")
def archive_bounded_repeated_keys_union(spark, sf):
    source, target = _repeated_keys(spark, sf)
    return source.read().unionByName(target.read())


@query("SELECT side, o_orderkey, o_totalprice FROM (SELECT 'source' AS side, * FROM orders WHERE "
       f"NOT ({OLD}) OR o_orderkey % 7 = 0 UNION ALL SELECT 'target', * REPLACE (CASE WHEN "
       f"o_orderkey % 7 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE {OLD})")
def archive_move_conflicting_rows(spark, sf):
    """Old orders whose key the archive has at another price stay where they are."""
    root, store = _adopted(spark, sf)
    job = _job(root)
    old = store.read().filter(ar.job_predicate(job, store.snapshot().schema))
    target = Store(spark, job.target)
    target.append(old.filter("o_orderkey % 7 = 0").withColumn("o_totalprice", F.lit(-1.0)), "before")
    ar.archive_move(spark, job)
    sides = [s.read().select(F.lit(n).alias("side"), "o_orderkey", "o_totalprice")
             for n, s in (("source", store), ("target", target))]
    return sides[0].unionByName(sides[1])


# Orders that a loader adds to the source while a move is under way: old, with new keys.
LATE = f"SELECT o_orderkey + 100000000 AS o_orderkey FROM orders WHERE {OLD} AND o_orderkey % 10 = 0"


def _late(rows, key):
    return rows.withColumn(key, (F.col(key) + 100_000_000).cast(rows.schema[key].dataType))


@query(f"SELECT 'source' AS side, o_orderkey FROM orders WHERE NOT ({OLD}) UNION ALL "
       f"SELECT 'target', o_orderkey FROM orders WHERE {OLD} UNION ALL "
       f"SELECT 'target', o_orderkey FROM ({LATE})")
def archive_move_source_raced(spark, sf):
    """The source is appended to between the two commits of a move, in 'append' mode: the run
    is taken up again, another run moves what came meanwhile, and no row goes twice."""
    root, store = _adopted(spark, sf)
    job = _job(root, on_duplicate="append")
    old = store.read().filter(ar.job_predicate(job, store.snapshot().schema))
    late = _late(old.filter("o_orderkey % 10 = 0"), "o_orderkey")
    ar.begin_move(spark, job, "first")
    ar.load_move(spark, job, "first")
    store.append(late)  # here the first run stops
    ar.archive_move(spark, job, "second")
    ar.archive_move(spark, job, "first")
    sides = [s.read().select(F.lit(n).alias("side"), "o_orderkey")
             for n, s in (("source", store), ("target", Store(spark, job.target)))]
    return sides[0].unionByName(sides[1])


RACED = f"""
WITH taken AS (
  SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_orderkey, row_number() OVER (
    ORDER BY l_orderkey) AS r FROM lineitem WHERE {SHIPPED}) WHERE r <= 3003 GROUP BY 1
), total AS (
  SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_orderkey FROM lineitem UNION ALL
    SELECT l_orderkey + 100000000 FROM lineitem WHERE {SHIPPED} AND l_linenumber = 1) GROUP BY 1
)
SELECT 'target' AS side, l_orderkey, n AS rows FROM taken UNION ALL
SELECT 'source', a.l_orderkey, a.n - coalesce(t.n, 0) FROM total a LEFT JOIN taken t
ON a.l_orderkey = t.l_orderkey WHERE a.n > coalesce(t.n, 0)
"""


@query(RACED)
def archive_bounded_raced(spark, sf):
    """Three bounded runs over repeated keys claim their rows while a loader appends, and end in
    another order than they began."""
    root, store = _adopted(spark, sf, "lineitem")
    job = ArchiveJob(
        name="items", source=store.path, target=f"{root}/archive", filter_column="l_shipdate",
        where="<= DATEADD(DAY, -1000, GETDATE())", keys=("l_orderkey",), as_of=AS_OF,
        batch_size=1, max_rows=1001, on_duplicate="append",
    )
    old = store.read().filter(ar.job_predicate(job, store.snapshot().schema))
    late = _late(old.filter("l_linenumber = 1"), "l_orderkey")
    ar.begin_move(spark, job, "a", bounded=True)
    store.append(late)
    ar.begin_move(spark, job, "b", bounded=True)
    ar.load_move(spark, job, "a")
    for run in ("c", "b", "a"):
        ar.archive_bounded(spark, job, run)
    sides = [s.read().groupBy(F.lit(n).alias("side"), "l_orderkey").agg(F.count(F.lit(1)).alias("rows"))
             for n, s in (("source", store), ("target", Store(spark, job.target)))]
    return sides[0].unionByName(sides[1])


CLASHING = ("_pno", "_at", "_bounds", "_row", "_file", "bits", "span")


@query("SELECT side, o_orderkey, pno, " + ", ".join(f"o_orderkey + {i} AS {c}" for i, c in enumerate(CLASHING))
       + f" FROM (SELECT CASE WHEN r <= 3000 THEN 'target' ELSE 'source' END AS side, o_orderkey, pno "
       f"FROM (SELECT o_orderkey, {pno_sql('o_orderdate', YEARS)} AS pno, CASE WHEN {OLD} THEN row_number() "
       f"OVER (PARTITION BY {OLD} ORDER BY o_orderkey) ELSE 1000000000 END AS r FROM orders))")
def convert_with_clashing_columns(spark, sf):
    """A table whose columns bear the names of helper columns is partitioned, and rows of it
    are moved; every value stays what it was."""
    root = scratch_path(spark, "job")
    columns = {c: F.col("o_orderkey") + F.lit(i).cast("bigint") for i, c in enumerate(CLASHING)}
    store = Store(spark, f"{root}/orders")
    store.append(table(spark, sf, "orders").withColumns(columns))
    job = _job(root, batch_size=1000, max_rows=3000)
    mt.to_partitioned(spark, store.path, by_year(), content=True)
    Store(spark, job.target).create(store.snapshot().schema, by_year())
    ar.archive_bounded(spark, job)
    sides = [_numbered(spark, s).select(F.lit(n).alias("side"), "o_orderkey", "pno", *CLASHING)
             for n, s in (("source", store), ("target", Store(spark, job.target)))]
    return sides[0].unionByName(sides[1])


PNO = pno_sql("o_orderdate", YEARS)


@query(f"SELECT *, {PNO} AS pno FROM orders")
def convert_to_partitioned(spark, sf):
    return _numbered(spark, _partitioned(spark, sf)[1])


@query(f"SELECT *, {pno_sql('o_orderdate', (*YEARS[:2], '1997-07-01', *YEARS[2:]))} AS pno "
       "FROM orders")
def split_stored_table(spark, sf):
    _, store = _partitioned(spark, sf)
    mt.apply_split(spark, store.path, ["1997-07-01"])
    return _numbered(spark, store)


@query(f"SELECT *, {pno_sql('o_orderdate', (*YEARS[:2], *YEARS[3:]))} AS pno FROM orders")
def merge_stored_table(spark, sf):
    _, store = _partitioned(spark, sf)
    mt.apply_merge(spark, store.path, "0003")
    return _numbered(spark, store)


@query(f"SELECT side, o_orderkey FROM (SELECT CASE WHEN {PNO} = 3 THEN 'target' ELSE 'source' "
       "END AS side, o_orderkey FROM orders)")
def switch_partition(spark, sf):
    root, store = _partitioned(spark, sf)
    target = Store(spark, f"{root}/switched")
    target.create(store.snapshot().schema, by_year())
    mt.switch_partition(spark, store.path, target.path, 3, "switch-1")
    sides = [s.read().select(F.lit(n).alias("side"), "o_orderkey")
             for n, s in (("source", store), ("target", target))]
    return sides[0].unionByName(sides[1])


@query(f"SELECT * FROM orders WHERE {PNO} <> 2")
def truncate_partition(spark, sf):
    _, store = _partitioned(spark, sf)
    mt.truncate_partition(spark, store.path, 2, confirm=True)
    return store.read()


def _archived_partition(spark, sf):
    root, store = _partitioned(spark, sf)
    ar.archive_partition(spark, _job(root), 1)
    return store, Store(spark, f"{root}/archive")


@query(f"SELECT * FROM orders WHERE {PNO} = 1")
def archive_partition_target(spark, sf):
    return _archived_partition(spark, sf)[1].read()


@query(f"SELECT * FROM orders WHERE {PNO} <> 1")
def archive_partition_source(spark, sf):
    return _archived_partition(spark, sf)[0].read()


@query(f"SELECT * FROM orders WHERE {PNO} = 4")
def resume_from_staged(spark, sf):
    root, _ = _partitioned(spark, sf)
    job = _job(root)
    ar.stage_partition(spark, job, 4)  # a run that stopped after staging
    ar.archive_partition(spark, job, 4)
    return Store(spark, job.target).read()


@query("SELECT CAST(4 AS BIGINT) AS tasks, CAST(3 AS BIGINT) AS success, "
       "CAST(1 AS BIGINT) AS failed, CAST(least(count(*) FILTER (WHERE "
       f"{OLD}), 1000) + least(count(*) FILTER (WHERE o_orderstatus = 'P'), 1000) AS BIGINT) "
       "AS rows FROM orders")
def archive_many_jobs(spark, sf):
    root, _ = _adopted(spark, sf)
    log = RunLog(spark, f"{root}/runs")
    limits = dict(batch_size=500, max_rows=1000)
    jobs = [
        _job(root, name="pending", filter_column="o_orderstatus", where="= 'P'",
             target=f"{root}/pending", delete_source=False, **limits),
        _job(root, **limits),
        _job(root, name="broken", where="< 5; --", **limits),
        _job(root, name="off", enabled=False, **limits),
    ]
    ar.archive_many(spark, jobs, log)
    return ar.summarise(log.read())


def _years(spark, sf, root):
    """The orders as one table per year."""
    orders = table(spark, sf, "orders")
    for start in YEARS[:-1]:
        edges = [F.lit(f"{int(start[:4]) + i}-01-01").cast("timestamp_ntz") for i in (0, 1)]
        inside = (F.col("o_orderdate") >= edges[0]) & (F.col("o_orderdate") < edges[1])
        Store(spark, f"{root}/{start[:4]}").append(orders.filter(inside))


# Runs of three tries per year: a year with known keys fails twice and is skipped then; another
# moves its rows at the first try and finds nothing at the others.
@query("SELECT job, status, CAST(count(*) AS BIGINT) AS runs, CAST(max(CASE WHEN status = 2 THEN old ELSE 0 "
       "END) AS BIGINT) AS rows FROM (SELECT y AS job, old, CASE WHEN bad > 0 THEN CASE WHEN try > 2 "
       "THEN 4 ELSE 3 END WHEN old = 0 OR try > 1 THEN 4 ELSE 2 END AS status FROM (SELECT "
       "CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS old, "
       "count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE "
       "o_custkey % 500 = 0 AND o_orderstatus = 'F' AND year(o_orderdate) % 2 = 1)) AS bad FROM orders "
       "WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1), "
       "(VALUES (1), (2), (3)) AS t(try)) GROUP BY 1, 2")
def archive_many_jobs_disabled(spark, sf):
    """One job per year moves the finished orders. The archive of the odd years already holds
    some of their keys, which a job is told to fail at: it is tried twice, then skipped."""
    root = scratch_path(spark, "job")
    _years(spark, sf, root)
    jobs = []
    for start in YEARS[:-1]:
        year = start[:4]
        job = _job(root, name=year, source=f"{root}/{year}", target=f"{root}/archive-{year}",
                   filter_column="o_orderstatus", where="= 'F'", method="move", on_duplicate="fail", max_failures=2)
        if int(year) % 2:
            known = Store(spark, job.source).read().filter("o_custkey % 500 = 0 AND o_orderstatus = 'F'")
            Store(spark, job.target).append(known)
        jobs.append(job)
    log = RunLog(spark, f"{root}/runs")
    results = [r for _ in range(3) for r in ar.archive_many(spark, jobs, log, at_once=3)]
    runs = spark.createDataFrame([(r.job, r.status, r.rows) for r in results], "job string, status int, rows bigint")
    return runs.groupBy("job", "status").agg(F.count(F.lit(1)).alias("runs"), F.max("rows").alias("rows"))


@query("SELECT job, method, status, rows, target_rows FROM (SELECT 'copy' AS job, 'copy' AS method, "
       f"2 AS status, CAST(count(*) FILTER (WHERE {OLD}) AS BIGINT) AS rows, "
       f"CAST(count(*) FILTER (WHERE {OLD}) AS BIGINT) AS target_rows FROM orders UNION ALL "
       f"SELECT 'move', 'move', 2, count(*) FILTER (WHERE {OLD}), count(*) FILTER (WHERE {OLD}) FROM orders "
       f"UNION ALL SELECT 'bounded', 'bounded', 2, least(2000, count(*) FILTER (WHERE {OLD})), "
       f"least(2000, count(*) FILTER (WHERE {OLD})) FROM orders UNION ALL "
       f"SELECT 'partition', 'partition', 2, count(*) FILTER (WHERE {pno_sql('o_orderdate', YEARS)} = 2), "
       f"count(*) FILTER (WHERE {pno_sql('o_orderdate', YEARS)} = 2) FROM orders)")
def archive_many_methods(spark, sf):
    """Four jobs on four tables, one of each method, side by side."""
    root = scratch_path(spark, "job")
    jobs = []
    for method in ("copy", "move", "bounded", "partition"):
        store = Store(spark, f"{root}/{method}")
        store.adopt(f"{sf}/orders.parquet")
        limits = dict(batch_size=500, max_rows=2000) if method == "bounded" else {}
        if method == "partition":
            mt.to_partitioned(spark, store.path, by_year())
            limits = dict(partition_no=2)
        jobs.append(_job(root, name=method, method=method, source=store.path, target=f"{root}/{method}-archive", **limits))
    results = ar.archive_many(spark, jobs, at_once=4)
    landed = [Store(spark, j.target).read().agg(F.lit(j.name).alias("job"), F.count(F.lit(1)).alias("target_rows"))
              for j in jobs]
    told = [(r.job, r.method, r.status, r.rows) for r in results]
    runs = spark.createDataFrame(told, "job string, method string, status int, rows bigint")
    return runs.join(reduce(DataFrame.unionByName, landed), "job")


# Streams.


@query(f"SELECT * FROM orders WHERE {OLD}")
def archive_stream(spark, sf):
    root = scratch_path(spark, "stream")
    orders = table(spark, sf, "orders")
    stream = streams.table_stream(spark, f"{sf}/orders.parquet", orders.schema, 1)
    job = _job(root)
    streams.archive_stream(stream, job, f"{root}/checkpoint").awaitTermination()
    return Store(spark, job.target).read()


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN {OLD} THEN 'target' ELSE 'source' "
       "END AS side FROM orders")
def archive_stream_moved(spark, sf):
    """Half of the table comes, then the other, each worked off by bounded moves."""
    root = scratch_path(spark, "stream-moved")
    orders = table(spark, sf, "orders")
    budget = max(1, orders.count() // 6)
    job = _job(root, max_rows=budget, batch_size=min(budget, 5_000))
    source = Store(spark, job.source)
    for half in (0, 1):
        source.append(orders.filter(F.pmod("o_orderkey", F.lit(2)) == half))
        streams.move_stream(spark, job, f"{root}/checkpoint").awaitTermination()
    both = [
        store.read().select("o_orderkey", "o_custkey", "o_totalprice", F.lit(side).alias("side"))
        for store, side in ((source, "source"), (Store(spark, job.target), "target"))
    ]
    return both[0].unionByName(both[1])


KEPT = ("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) "
    "AS max_value, CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) - count({c}) AS BIGINT) "
    "AS null_rows, TRUE AS distinct_near, TRUE AS median_near FROM orders WHERE NOT "
    f"coalesce({OLD}, FALSE)".replace("{c}", c)
    for c in KEPT
))
def profile_merged(spark, sf):
    """Profiles kept per part over two appends and a move; estimates held against exact figures."""
    root = scratch_path(spark, "profiled")
    orders, job = table(spark, sf, "orders"), _job(root)
    source = Store(spark, job.source)
    for half in (0, 1):
        source.append(orders.filter(F.pmod("o_orderkey", F.lit(2)) == half))
        profiles.refresh_profile(spark, source, KEPT)
    ar.archive_move(spark, job)
    profiles.refresh_profile(spark, source, KEPT)
    found, rows = profiles.merged_profile(spark, source, KEPT), source.read()
    checks = []
    for r in found.collect():  # a row per column
        c = r["column_name"]
        near = F.abs(F.count_distinct(c) - F.lit(r["distinct_rows"])) <= 0.05 * F.count_distinct(c)
        median = F.lit(True)
        if r["quantiles"] is not None:
            q = F.lit(r["quantiles"][0]).cast(orders.schema[c].dataType)
            share = 0.03 * F.count(c)
            half = F.count(c) / 2
            median = (F.count_if(F.col(c) < q) <= half + share) & (F.count_if(F.col(c) <= q) >= half - share)
        checks.append(F.struct(F.lit(c).alias("column_name"), near.alias("distinct_near"), median.alias("median_near")))
    held = rows.agg(F.array(*checks).alias("_c")).select(F.inline("_c"))
    return found.join(F.broadcast(held), "column_name").drop("distinct_rows", "quantiles")


def _drained(stream, root):
    """Everything a query emits until its source is worked off."""
    (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


@query("SELECT user_id, last_heartbeat, last_heartbeat + INTERVAL 5 MINUTE AS stale_at, "
       "last_status, heartbeats FROM (SELECT user_id, max(ts) AS last_heartbeat, "
       "arg_max(event_type, ts) AS last_status, CAST(count(*) AS BIGINT) AS heartbeats FROM ("
       "SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END) OVER ("
       "PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER ("
       "PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s) "
       "WHERE last_heartbeat + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) "
       "AND last_status NOT IN ('purchase', 'error')")
def stale_heartbeat_stream(spark, sf):
    events = table(spark, sf, "events")
    # the table's files are in no order of time, so one tick takes them all
    beats = streams.table_stream(spark, f"{sf}/events.parquet", events.schema)
    # Event-time windows of a stream need an instant; the session zone is UTC.
    beats = beats.withColumn("ts", F.to_timestamp(F.col("ts")))
    stale = streams.stale_stream(
        beats, task="user_id", ts="ts", status="event_type", terminal=("purchase", "error"),
        delay="0 seconds",
    )
    found = _drained(stale, scratch_path(spark, "stale"))
    return found.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("last_heartbeat", "stale_at")}
    )


SLICES = 6
JITTER = 600  # seconds


@query("WITH w AS (SELECT max(ts) AS top, (CAST(floor(epoch(max(ts))) AS BIGINT) - "
       f"CAST(floor(epoch(min(ts))) AS BIGINT)) // {SLICES} + 1 + {2 * JITTER} AS delay FROM events) "
       "SELECT user_id, last_heartbeat, last_heartbeat + INTERVAL 5 MINUTE AS stale_at, "
       "last_status, heartbeats FROM (SELECT user_id, max(ts) AS last_heartbeat, "
       "arg_max(event_type, ts) AS last_status, CAST(count(*) AS BIGINT) AS heartbeats FROM ("
       "SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END) OVER ("
       "PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER ("
       "PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s), w "
       "WHERE last_heartbeat + INTERVAL 5 MINUTE <= top - to_seconds(delay) "
       "AND last_status NOT IN ('purchase', 'error')")
def stale_heartbeat_ticks(spark, sf):
    """The heartbeats come in slices of time, out of order within and across them, a file a tick;
    the delay covers that disorder, so no beat is late."""
    root = scratch_path(spark, "stale-ticks")
    events = table(spark, sf, "events").withColumn("ts", F.to_timestamp("ts"))
    seconds = F.unix_timestamp("ts")
    low, high = events.agg(F.min(seconds), F.max(seconds)).first()
    width = (high - low) // SLICES + 1
    came = F.floor((seconds + F.pmod("event_id", F.lit(JITTER)) - low) / width)
    for number in range(SLICES + 1):  # the files' times give their order; the last holds a rest
        part = events.filter(F.least(came, F.lit(SLICES)) == number)
        part.write.mode("append").parquet(f"{root}/beats")
    stale = streams.stale_stream(
        streams.file_stream(spark, f"{root}/beats", events.schema, 1),
        task="user_id", ts="ts", status="event_type", terminal=("purchase", "error"),
        delay=f"{width + 2 * JITTER} seconds",
    )
    return _drained(stale, root).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("last_heartbeat", "stale_at")}
    )


@query("SELECT * FROM events WHERE user_id = 5 AND ts >= TIMESTAMP '2024-01-12'")
def tail_log_stream(spark, sf):
    events = table(spark, sf, "events")
    stream = streams.table_stream(spark, f"{sf}/events.parquet", events.schema, 1)
    tail = streams.tail_logs(
        stream, ts="ts", task=5, task_column="user_id", since=AS_OF.replace(2024, 1, 12)
    )
    return _drained(tail, scratch_path(spark, "tail"))


@query("SELECT CAST(n AS INTEGER) AS partition_number, CAST(coalesce(c, 0) AS BIGINT) AS rows "
       "FROM (SELECT unnest(range(1, 13)) AS n) LEFT JOIN (SELECT "
       f"{pno_sql('l_orderkey', range(2000, 24000, 2000), literal='{}')} AS n, count(*) AS c "
       "FROM lineitem GROUP BY 1) USING (n)")
def stored_partition_rows(spark, sf):
    _, store = _adopted(spark, sf, "lineitem")
    spec = PartitionSpec("l_orderkey", ValueKind.BIGINT, tuple(range(2000, 24000, 2000)))
    mt.to_partitioned(spark, store.path, spec)
    counts = [
        store.read(n).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(n).alias("partition_number"), "rows"
        )
        for n in range(1, spec.partition_count + 1)
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
