"""Key lookups, enrichment, purge, profiles and the checks around a move."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.functions.status import UNKNOWN_SOURCE, UNKNOWN_TABLE, display_text
from frostline.operators import checks, joins
from frostline.operators import profile as pf
from frostline.workload.registry import YEARS, by_year, pno_sql, query, table

# The archive so far holds the finished orders; the batch is everything before 1998.
OLD = "o_orderdate < TIMESTAMP '1998-01-01'"


def _archive(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")


def _batch(spark, sf):
    edge = F.lit("1998-01-01").cast("timestamp_ntz")
    return table(spark, sf, "orders").filter(F.col("o_orderdate") < edge)


@query(f"SELECT CAST(count(*) AS BIGINT) AS existing_rows FROM orders t WHERE "
       f"t.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM orders s WHERE s.{OLD} "
       "AND s.o_orderkey = t.o_orderkey)")
def existing_rows(spark, sf):
    return joins.existing_rows(_archive(spark, sf), _batch(spark, sf), ["o_orderkey"])


@query("SELECT CAST(count(*) AS BIGINT) AS existing_rows FROM lineitem t WHERE EXISTS ("
       f"SELECT 1 FROM orders s WHERE s.{OLD} AND s.o_orderkey = t.l_orderkey)")
def existing_rows_repeated_keys(spark, sf):
    keys = _batch(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.existing_rows(table(spark, sf, "lineitem"), keys, ["l_orderkey"])


@query(f"SELECT s.* FROM orders s WHERE s.{OLD} AND NOT EXISTS (SELECT 1 FROM orders t "
       "WHERE t.o_orderstatus = 'F' AND t.o_orderkey = s.o_orderkey)")
def new_rows(spark, sf):
    return joins.new_rows(_batch(spark, sf), _archive(spark, sf), ["o_orderkey"])


@query("SELECT s.l_orderkey, s.l_suppkey, s.l_linenumber FROM lineitem s WHERE NOT EXISTS ("
       "SELECT 1 FROM lineitem t WHERE t.l_returnflag = 'R' AND t.l_suppkey = s.l_suppkey "
       "AND t.l_linenumber = s.l_linenumber AND t.l_orderkey = s.l_orderkey)")
def new_rows_composite_key(spark, sf):
    items = table(spark, sf, "lineitem")
    there = items.filter(F.col("l_returnflag") == "R")
    keys = ["l_orderkey", "l_suppkey", "l_linenumber"]
    return joins.new_rows(items.select(*keys), there, keys)


STATUS_CODE = {"signup": 0, "click": 3, "purchase": 4, "error": 5, "view": 6}


def _code(column="event_type"):
    table_ = F.create_map(*[F.lit(x) for pair in STATUS_CODE.items() for x in pair])
    return F.try_element_at(table_, F.col(column))


@query("SELECT event_id, coalesce(c_name, '未知数据库') AS source_name, "
       "coalesce(c_mktsegment, '未知对象') AS source_table, CASE event_type "
       "WHEN 'signup' THEN '待校验' WHEN 'click' THEN '执行中' WHEN 'purchase' THEN '已成功' "
       "WHEN 'error' THEN '已失败' ELSE '已取消' END AS status_text "
       "FROM events LEFT JOIN customer ON user_id * 11 = c_custkey")
def enrich_tasks(spark, sf):
    tasks = table(spark, sf, "events").withColumn("source_id", F.col("user_id") * 11)
    fields = {"source_name": ("c_name", UNKNOWN_SOURCE),
              "source_table": ("c_mktsegment", UNKNOWN_TABLE)}
    lookups = [(table(spark, sf, "customer"), "source_id", "c_custkey", fields)]
    return joins.enrich(tasks, lookups).select(
        "event_id", "source_name", "source_table", display_text(_code()).alias("status_text")
    )


def _purged(spark, sf):
    parent = table(spark, sf, "orders").withColumn("deleted", F.col("o_orderstatus") == "P")
    children = {"lineitem": table(spark, sf, "lineitem")}
    return joins.purge_deleted(
        parent, children, key="o_orderkey", deleted="deleted", child_key="l_orderkey"
    )


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def purge_deleted_parent(spark, sf):
    return _purged(spark, sf)[0].select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN ("
       "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def purge_deleted_children(spark, sf):
    return _purged(spark, sf)[1]["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")


# Profiles.

PROFILED = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")


def _profile_sql(columns, source, extra="", cast=False):
    value = (lambda c: f"CAST({c} AS VARCHAR)") if cast else (lambda c: c)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(min({value(c)}) AS VARCHAR) AS min_value, "
        f"CAST(max({value(c)}) AS VARCHAR) AS max_value, CAST(count(*) AS BIGINT) AS total_rows"
        f"{extra.format(c=c)} FROM {source}"
        for c in columns
    )


DISTINCT = ", CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_rows"


@query(_profile_sql(PROFILED, "lineitem", DISTINCT))
def profile_exact(spark, sf):
    return pf.profile(table(spark, sf, "lineitem"), PROFILED)


@query(_profile_sql(("c_custkey", "c_name", "c_nationkey"), "customer", DISTINCT, cast=True))
def profile_as_text(spark, sf):
    columns = ("c_custkey", "c_name", "c_nationkey")
    return pf.profile(table(spark, sf, "customer"), columns, compare="text")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) "
    "AS max_value, CAST(count(*) AS BIGINT) AS total_rows, TRUE AS within_10_percent FROM lineitem"
    for c in PROFILED
))
def profile_approximate(spark, sf):
    """Sketched distinct counts, held against the exact ones."""
    items = table(spark, sf, "lineitem")
    exact = pf.profile(items, PROFILED).select("column_name", F.col("distinct_rows").alias("exact"))
    found = pf.profile(items, PROFILED, approximate=True).join(exact, "column_name")
    near = F.abs(F.col("distinct_rows") - F.col("exact")) <= 0.1 * F.col("exact")
    return found.select(
        "column_name", "min_value", "max_value", "total_rows", near.alias("within_10_percent")
    )


@query(_profile_sql(PROFILED, "lineitem"))
def profile_bounds(spark, sf):
    return pf.profile_bounds(table(spark, sf, "lineitem"), PROFILED)


@query("SELECT *, FALSE AS is_approximate FROM ("
       + _profile_sql(("o_orderdate",), "orders", DISTINCT) + ")")
def profile_auto(spark, sf):
    return pf.profile_auto(table(spark, sf, "orders"), "o_orderdate")


# Checks.

HALF = "o_orderstatus <> 'P' OR o_orderdate < TIMESTAMP '1998-01-01'"


@query("SELECT partition_number, source_rows, target_rows, source_rows = target_rows AS matches "
       f"FROM (SELECT {pno_sql('o_orderdate', YEARS)} AS partition_number, "
       "CAST(count(*) AS BIGINT) AS source_rows, "
       f"CAST(count(*) FILTER (WHERE {HALF}) AS BIGINT) AS target_rows FROM orders GROUP BY 1)")
def reconcile_by_partition(spark, sf):
    orders = table(spark, sf, "orders")
    edge = F.lit("1998-01-01").cast("timestamp_ntz")
    half = orders.filter((F.col("o_orderstatus") != "P") | (F.col("o_orderdate") < edge))
    return checks.reconcile_by(orders, half, by_year())


@query("SELECT partition_number, source_rows, target_rows, touched = 0 AS matches "
       f"FROM (SELECT {pno_sql('o_orderdate', YEARS)} AS partition_number, "
       "CAST(count(*) AS BIGINT) AS source_rows, CAST(count(*) AS BIGINT) AS target_rows, "
       "count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-06-01' AND o_orderstatus = 'P') "
       "AS touched FROM orders GROUP BY 1)")
def reconcile_changed_rows(spark, sf):
    orders = table(spark, sf, "orders")
    late = F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz")
    changed = orders.withColumn(
        "o_custkey",
        F.when(late & (F.col("o_orderstatus") == "P"), -F.col("o_custkey") - 1).otherwise(
            F.col("o_custkey")
        ),
    )
    return checks.reconcile_by(orders, changed, by_year())


@query(f"SELECT s.o_orderkey, s.o_custkey FROM orders s WHERE s.{OLD} AND NOT EXISTS ("
       "SELECT 1 FROM orders t WHERE t.o_orderstatus = 'F' AND t.o_orderkey = s.o_orderkey)")
def guard_duplicates_skip(spark, sf):
    kept = checks.guard_duplicates(
        _batch(spark, sf), _archive(spark, sf), ["o_orderkey"], "skip"
    )
    return kept.select("o_orderkey", "o_custkey")


@query("SELECT 'text' AS column_name, 'length' AS issue, "
       "CAST(count(*) FILTER (WHERE length(text) > 4000) AS BIGINT) AS bad_rows FROM documents "
       "UNION ALL SELECT 'lang', 'length', CAST(count(*) FILTER (WHERE length(lang) > 1) "
       "AS BIGINT) FROM documents "
       "UNION ALL SELECT 'n_chars', 'range', CAST(count(*) FILTER (WHERE n_chars > 32767) "
       "AS BIGINT) FROM documents "
       "UNION ALL SELECT 'source', 'missing', CAST(count(*) AS BIGINT) FROM documents")
def fit_audit_documents(spark, sf):
    target = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.VarcharType(4000)),
            T.StructField("lang", T.VarcharType(1)),
            T.StructField("n_chars", T.ShortType()),
        ]
    )
    return checks.fit_audit(table(spark, sf, "documents"), target)


@query("SELECT 'o_totalprice' AS column_name, issue, CAST(n AS BIGINT) AS bad_rows FROM ("
       "SELECT 'precision' AS issue, count(*) FILTER (WHERE abs(round(o_totalprice, 1)) >= 1e5) "
       "AS n FROM orders UNION ALL SELECT 'scale', count(*) FILTER (WHERE "
       "abs(round(o_totalprice, 1)) < 1e5 AND round(o_totalprice, 1) <> o_totalprice) FROM orders)")
def fit_audit_decimal(spark, sf):
    target = T.StructType([T.StructField("o_totalprice", T.DecimalType(6, 1))])
    return checks.fit_audit(table(spark, sf, "orders").select("o_totalprice"), target)


@query("SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS null_rows "
       "FROM orders")
def null_partition_keys(spark, sf):
    orders = table(spark, sf, "orders").withColumn(
        "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    )
    return checks.null_keys(orders, "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS batch_rows FROM lineitem "
       "GROUP BY 1, 2 HAVING count(*) > 1")
def key_violations(spark, sf):
    return checks.key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"SELECT o_orderkey, CAST(1 AS BIGINT) AS batch_rows, CAST(1 AS BIGINT) AS target_rows "
       f"FROM orders WHERE {OLD} AND o_orderstatus = 'F'")
def key_violations_with_target(spark, sf):
    return checks.key_violations(_batch(spark, sf), ["o_orderkey"], _archive(spark, sf))


@query("SELECT o_custkey, o_orderpriority, CAST(count(*) AS BIGINT) AS total_records, "
       "CAST(count(*) FILTER (WHERE o_orderstatus <> 'P') AS BIGINT) AS active_records, "
       "CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS deleted_records "
       "FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    orders = table(spark, sf, "orders").withColumn("deleted", F.col("o_orderstatus") == "P")
    return checks.duplicate_groups(orders, ["o_custkey", "o_orderpriority"], deleted="deleted")


@query("SELECT 'discount_cap' AS rule, CAST(count(*) FILTER (WHERE NOT (l_discount <= 0.05)) "
       "AS BIGINT) AS violations FROM lineitem UNION ALL SELECT 'ships_before_2001', "
       "CAST(count(*) FILTER (WHERE l_returnflag <> 'N' AND l_shipdate >= "
       "TIMESTAMP '2001-01-01') AS BIGINT) FROM lineitem")
def rule_violations(spark, sf):
    items = table(spark, sf, "lineitem").withColumn(
        "shipped", F.when(F.col("l_returnflag") != "N", F.col("l_shipdate"))
    )
    rules = {
        "discount_cap": F.col("l_discount") <= 0.05,
        "ships_before_2001": "shipped < TIMESTAMP_NTZ'2001-01-01'",  # NULL passes
    }
    return checks.rule_violations(items, rules)


PART_3 = "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'"


@query("SELECT code, severity, CAST(n AS BIGINT) AS rows, FALSE AS may_proceed FROM ("
       "SELECT 'TargetPartitionNotEmpty' AS code, 'fix' AS severity, count(*) AS n FROM orders "
       f"WHERE {PART_3} AND o_orderstatus = 'F' UNION ALL "
       f"SELECT 'KeyInTarget', 'warning', count(*) FROM orders WHERE {PART_3} "
       "AND o_orderstatus = 'F' UNION ALL "
       f"SELECT 'RuleViolation', 'blocker', count(*) FROM orders WHERE {PART_3} "
       "AND NOT (o_totalprice < 90000)) WHERE n > 0")
def inspect_move(spark, sf):
    return checks.inspect_move(
        table(spark, sf, "orders"),
        _archive(spark, sf),
        by_year(),
        3,
        ["o_orderkey"],
        rules={"price_cap": F.col("o_totalprice") < 90000},
    )


@query("SELECT l_returnflag, l_linestatus, string_agg(y, ', ' ORDER BY y) AS names FROM ("
       "SELECT DISTINCT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS VARCHAR) AS y "
       "FROM lineitem) GROUP BY 1, 2")
def ordered_concat(spark, sf):
    from frostline.operators.runlog import ordered_concat as concat

    items = table(spark, sf, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        F.year("l_shipdate").alias("ord"),
        F.year("l_shipdate").cast("string").alias("y"),
    )
    return concat(items, ["l_returnflag", "l_linestatus"], "ord", "y")

