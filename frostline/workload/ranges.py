"""Range partitioning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from frostline.operators import ranges as rg
from frostline.spec import PartitionSpec, Retention, ValueKind
from frostline.workload.registry import (
    AS_OF,
    TABLES,
    YEARS,
    by_year,
    list_sql,
    pno_sql,
    query,
    table,
    year_text,
)

RIGHT = pno_sql("o_orderdate", YEARS)
LEFT = pno_sql("o_orderdate", YEARS, right=False)
YEAR_LIST = list_sql(YEARS, year_text)

# Boundaries on both sides of the data leave empty partitions.
WIDE = ("1990-01-01", *YEARS, "2005-01-01", "2006-01-01")
WIDE_LIST = list_sql(WIDE, year_text)
WIDE_PNO = pno_sql("o_orderdate", WIDE)


def _wide(right=True):
    return PartitionSpec("o_orderdate", ValueKind.DATETIME2, WIDE, right)


def _counts(pno, source="orders"):
    return f"(SELECT {pno} AS n, count(*) AS c FROM {source} GROUP BY 1)"


def _detail(listing, pno, columns, where=""):
    return (
        f"SELECT {columns} FROM {listing} p LEFT JOIN {_counts(pno)} q USING (n) {where}"
    )


@query(f"SELECT o_orderkey, {RIGHT} AS pno FROM orders")
def assign_right(spark, sf):
    orders = table(spark, sf, "orders")
    return rg.with_partition_no(orders, by_year(), "pno").select("o_orderkey", "pno")


@query(f"SELECT o_orderkey, {LEFT} AS pno FROM orders")
def assign_left(spark, sf):
    orders = table(spark, sf, "orders")
    return rg.with_partition_no(orders, by_year(False), "pno").select("o_orderkey", "pno")


MANY = tuple(range(10, 30_000, 20))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey < 10 THEN 1 "
       f"ELSE least((l_orderkey - 10) // 20 + 2, {len(MANY) + 1}) END AS INTEGER) AS pno "
       "FROM lineitem")
def assign_many_boundaries(spark, sf):
    spec = PartitionSpec("l_orderkey", ValueKind.BIGINT, MANY)
    items = table(spark, sf, "lineitem")
    return rg.with_partition_no(items, spec, "pno").select("l_orderkey", "l_linenumber", "pno")


@query(_detail(WIDE_LIST, WIDE_PNO,
               "n AS partition_number, lpad(CAST(n AS VARCHAR), 4, '0') AS sort_key, "
               "lo AS lower_bound, hi AS upper_bound, coalesce(hi, 'N/A') AS boundary_value, "
               "'RIGHT' AS range_type, CAST(coalesce(c, 0) AS BIGINT) AS row_count"))
def partition_detail(spark, sf):
    return rg.partition_detail(table(spark, sf, "orders"), _wide())


@query(f"SELECT {LEFT} AS partition_number, CAST(count(*) AS BIGINT) AS row_count "
       "FROM orders GROUP BY 1")
def partition_rows(spark, sf):
    return rg.partition_rows(table(spark, sf, "orders"), by_year(False))


KEY_STEPS = tuple(range(5_000, 40_000, 5_000))


@query("WITH r AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem), "
       "b AS (SELECT unnest(range(lo + 2500, hi + 1, 2500)) AS b FROM r "
       "UNION SELECT 1000), "
       "o AS (SELECT b, row_number() OVER (ORDER BY b) AS i, lead(b) OVER (ORDER BY b) AS nxt "
       "FROM b), "
       "p AS (SELECT 1 AS n, CAST(NULL AS BIGINT) AS lo, min(b) AS hi FROM b "
       "UNION ALL SELECT i + 1, b, nxt FROM o) "
       "SELECT CAST(p.n AS INTEGER) AS partition_number, CAST(lo AS VARCHAR) AS lower_bound, "
       "CAST(hi AS VARCHAR) AS upper_bound, coalesce(lo <> 1000, FALSE) AS is_new, "
       "CAST(count(l_orderkey) AS BIGINT) AS row_count FROM p LEFT JOIN lineitem "
       "ON (lo IS NULL OR l_orderkey >= lo) AND (hi IS NULL OR l_orderkey < hi) "
       "GROUP BY ALL")
def propose_numeric(spark, sf):
    return rg.propose_numeric(table(spark, sf, "lineitem"), "l_orderkey", 2500, existing=(1000,))


def _proposed_dates(first, last, step, inside):
    series = f"range(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL {step})"
    return (
        f"WITH b AS (SELECT unnest({series}) AS b UNION SELECT TIMESTAMP '1999-01-01'), "
        "o AS (SELECT b, row_number() OVER (ORDER BY b) AS i, lead(b) OVER (ORDER BY b) AS nxt "
        "FROM b), p AS (SELECT 1 AS n, CAST(NULL AS TIMESTAMP) AS lo, min(b) AS hi FROM b "
        "UNION ALL SELECT i + 1, b, nxt FROM o) "
        "SELECT CAST(p.n AS INTEGER) AS partition_number, "
        "strftime(lo, '%Y-%m-%d %H:%M:%S.0000000') AS lower_bound, "
        "strftime(hi, '%Y-%m-%d %H:%M:%S.0000000') AS upper_bound, "
        "coalesce(lo <> TIMESTAMP '1999-01-01', FALSE) AS is_new, "
        "CAST(count(o_orderkey) AS BIGINT) AS row_count FROM p LEFT JOIN orders "
        "ON (lo IS NULL OR o_orderdate >= lo) AND (hi IS NULL OR o_orderdate < hi) GROUP BY ALL"
    )


@query(_proposed_dates("1996-05-01", "2000-06-01", "1 MONTH", False))
def propose_monthly(spark, sf):
    return rg.propose_dates(
        table(spark, sf, "orders"), "o_orderdate", "month", "both",
        datetime(1996, 5, 17), datetime(2000, 5, 20), existing=("1999-01-01",),
    )


@query(_proposed_dates("1997-05-01", "2000-05-01", "1 YEAR", True))
def propose_yearly_inside(spark, sf):
    return rg.propose_dates(
        table(spark, sf, "orders"), "o_orderdate", "year", "inside",
        datetime(1996, 5, 17), datetime(2000, 5, 1), existing=("1999-01-01",),
    )


@query("SELECT lpad(CAST(row_number() OVER (ORDER BY m) AS VARCHAR), 4, '0') AS sort_key, "
       "m AS boundary FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)")
def normalise_boundaries(spark, sf):
    months = table(spark, sf, "orders").select(
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m")
    )
    return rg.normalise_boundaries(months, "m")


SPLIT = ("1997-07-01", "1999-04-01", "2002-01-01")
ALL_BOUNDS = tuple(sorted((*YEARS, *SPLIT)))
AFTER = pno_sql("o_orderdate", ALL_BOUNDS)


def _split_sql():
    old = [1 + sum(y < b or y == b for y in YEARS) for b in ALL_BOUNDS]
    olds = [1, *old]
    mapping = ", ".join(f"({i + 1}, {o})" for i, o in enumerate(olds))
    return (
        f"SELECT n AS partition_number, CAST(o AS INTEGER) AS old_partition_number, "
        "lo AS lower_bound, hi AS upper_bound, count(*) OVER (PARTITION BY o) > 1 AS is_split, "
        "CAST(coalesce(c, 0) AS BIGINT) AS row_count, "
        "CAST(sum(coalesce(c, 0)) OVER (PARTITION BY o) AS BIGINT) AS old_row_count "
        f"FROM {list_sql(ALL_BOUNDS, year_text)} p LEFT JOIN {_counts(AFTER)} q USING (n) "
        f"JOIN (VALUES {mapping}) AS m(n, o) USING (n)"
    )


@query(_split_sql())
def split_impact(spark, sf):
    return rg.split_impact(table(spark, sf, "orders"), by_year(), SPLIT)


@query(_split_sql())
def sync_impact(spark, sf):
    wanted = ("1999-01-01", *SPLIT, "1998-01-01")
    return rg.sync_impact(table(spark, sf, "orders"), by_year(), wanted)


@query("SELECT sort_key, boundary, left_partition, right_partition, left_rows, right_rows, "
       "left_rows + right_rows AS merged_rows, left_rows = 0 OR right_rows = 0 AS blocked FROM ("
       "SELECT lpad(CAST(n AS VARCHAR), 4, '0') AS sort_key, hi AS boundary, "
       "n AS left_partition, n + 1 AS right_partition, "
       "CAST(coalesce(c, 0) AS BIGINT) AS left_rows, "
       "CAST(lead(coalesce(c, 0)) OVER (ORDER BY n) AS BIGINT) AS right_rows "
       f"FROM {WIDE_LIST} p LEFT JOIN {_counts(WIDE_PNO)} q USING (n)) WHERE boundary IS NOT NULL")
def merge_impact(spark, sf):
    return rg.merge_impact(table(spark, sf, "orders"), _wide())


@query("SELECT '0004' AS sort_key, '1998-01-01 00:00:00.0000000' AS boundary, "
       "CAST(4 AS INTEGER) AS left_partition, CAST(5 AS INTEGER) AS right_partition, l AS left_rows, "
       "r AS right_rows, CAST(l + r AS BIGINT) AS merged_rows, l = 0 OR r = 0 AS blocked FROM (SELECT "
       "CAST(count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS BIGINT) AS l, "
       "CAST(count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS BIGINT) AS r FROM orders "
       "WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')")
def merge_impact_of_boundary(spark, sf):
    return rg.merge_impact(table(spark, sf, "orders"), _wide(), "0004")


@query(_detail(WIDE_LIST, WIDE_PNO,
               "lpad(CAST(n AS VARCHAR), 4, '0') AS boundary_key, "
               "CAST(coalesce(c, 0) AS BIGINT) AS row_count, coalesce(c, 0) > 0 AS has_data, "
               "coalesce(c, 0) > 0 AS needs_staging, CASE WHEN coalesce(c, 0) > 0 THEN "
               "'partition still holds data; switch it out first' END AS warning"))
def partition_safety(spark, sf):
    return rg.safety(table(spark, sf, "orders"), _wide())


@query(_detail(WIDE_LIST, WIDE_PNO,
               "n AS partition_number, hi AS boundary_value, "
               "CAST(coalesce(c, 0) AS BIGINT) AS row_count",
               "WHERE hi < '1998-06-01'"))
def partitions_to_archive(spark, sf):
    return rg.partitions_to_archive(
        table(spark, sf, "orders"), _wide(),
        lambda b: b < F.lit("1998-06-01").cast("timestamp_ntz"),
    )


@query("SELECT CAST(4 AS INTEGER) AS partition_number, '1998-01-01 00:00:00.0000000' "
       "AS boundary_value, CAST(count(*) AS BIGINT) AS row_count FROM orders "
       "WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def find_partition_by_number(spark, sf):
    return rg.find_partition(table(spark, sf, "orders"), by_year(), "4")


@query("SELECT CAST(3 AS INTEGER) AS partition_number, '1998-01-01 00:00:00.0000000' "
       "AS boundary_value, CAST(count(*) AS BIGINT) AS row_count FROM orders "
       "WHERE o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1998-01-01'")
def find_partition_by_boundary(spark, sf):
    return rg.find_partition(
        table(spark, sf, "orders"), by_year(False), "1998-01-01 00:00:00.0000000"
    )


@query("SELECT partition_number, boundary_value, row_count FROM ("
       + _detail(WIDE_LIST, WIDE_PNO,
                 "n AS partition_number, coalesce(hi, 'N/A') AS boundary_value, "
                 "CAST(c AS BIGINT) AS row_count, "
                 "row_number() OVER (ORDER BY n DESC) AS age", "WHERE c > 0")
       + ") WHERE age > 3")
def expired_keep_latest(spark, sf):
    return rg.expired_partitions(table(spark, sf, "orders"), _wide(), Retention(keep_latest=3))


@query(_detail(WIDE_LIST, WIDE_PNO,
               "n AS partition_number, coalesce(hi, 'N/A') AS boundary_value, "
               "CAST(c AS BIGINT) AS row_count",
               "WHERE c > 0 AND CAST(left(hi, 19) AS TIMESTAMP) <= "
               "TIMESTAMP '2001-08-02' - INTERVAL 1200 DAY"))
def expired_keep_days(spark, sf):
    return rg.expired_partitions(
        table(spark, sf, "orders"), _wide(), Retention(keep_days=1200), AS_OF
    )


@query("SELECT CAST(count(*) AS BIGINT) AS residual_rows FROM lineitem "
       "WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2000-01-01'")
def residual_rows(spark, sf):
    return rg.residual(table(spark, sf, "lineitem"), by_year(column="l_shipdate"), 5)


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count, "
    f"{'TRUE' if t == 'orders' else 'FALSE'} AS is_partitioned, "
    f"CAST({7 if t == 'orders' else 0} AS INTEGER) AS partition_count, "
    f"{'FALSE' if t == 'orders' else 'count(*) > 0'} AS archivable FROM {t}"
    for t in TABLES))
def table_inventory(spark, sf):
    frames = {name: table(spark, sf, name) for name in TABLES}
    return rg.table_inventory(frames, {"orders": by_year()})


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count, "
    f"count(*) > 0 AS archivable FROM {t}" for t in TABLES if t not in ("orders", "lineitem")))
def unpartitioned_tables(spark, sf):
    frames = {name: table(spark, sf, name) for name in TABLES}
    specs = {"orders": by_year(), "lineitem": by_year(column="l_shipdate")}
    return rg.unpartitioned_tables(frames, specs)
