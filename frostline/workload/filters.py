"""Scans and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline.operators import filters as fl
from frostline.operators.filters import Condition
from frostline.operators.ranges import read_partition
from frostline.sources.files import scan
from frostline.workload.registry import AS_OF, NOW, by_year, query, table


def _orders(spark, sf, *conditions):
    orders = table(spark, sf, "orders")
    return orders.filter(fl.compile_filter(conditions, orders.schema, AS_OF))


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_returnflag, l_extendedprice, "
    "l_partkey, l_suppkey FROM lineitem"
)
def scan_copyable_columns(spark, sf):
    return scan(table(spark, sf, "lineitem"), exclude=("l_tax", "l_discount", "l_linestatus"))


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' "
       "AND o_orderdate < TIMESTAMP '1998-01-01'")
def read_partition_right(spark, sf):
    return read_partition(table(spark, sf, "orders"), by_year(), 3)


@query("SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' OR o_orderdate IS NULL")
def read_partition_left_first(spark, sf):
    return read_partition(table(spark, sf, "orders"), by_year(False), 1)


@query("SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '2001-08-02' - INTERVAL 1000 DAY")
def filter_relative_days(spark, sf):
    return _orders(spark, sf, Condition("o_orderdate", "RelativeDays", "1000"))


@query("SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' "
       "AND TIMESTAMP '1998-09-15 12:00:00'")
def filter_date_range(spark, sf):
    return _orders(
        spark, sf, Condition("o_orderdate", "DateRange", "1997-03-01", "1998-09-15 12:00:00")
    )


@query("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01'")
def filter_date_before(spark, sf):
    return _orders(spark, sf, Condition("o_orderdate", "LessThan", "1996-06-01 00:00:00"))


@query("SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01'")
def filter_date_after(spark, sf):
    return _orders(spark, sf, Condition("o_orderdate", "GreaterThan", "2001-01-01 00:00:00"))


@query("SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000.5")
def filter_number_between(spark, sf):
    return _orders(spark, sf, Condition("o_totalprice", "Between", "1000", "50000.5"))


@query("""
SELECT op, CAST(count(*) AS BIGINT) AS matching FROM (
  SELECT 'Equals' AS op FROM part WHERE p_size = 25
  UNION ALL SELECT 'NotEquals' FROM part WHERE p_size <> 25
  UNION ALL SELECT 'GreaterThan' FROM part WHERE p_size > 25
  UNION ALL SELECT 'GreaterThanOrEqual' FROM part WHERE p_size >= 25
  UNION ALL SELECT 'LessThan' FROM part WHERE p_size < 25
  UNION ALL SELECT 'LessThanOrEqual' FROM part WHERE p_size <= 25) GROUP BY op
""")
def filter_number_operators(spark, sf):
    part = table(spark, sf, "part")
    named = [
        F.struct(
            F.lit(op).alias("op"),
            F.count_if(fl.compile_condition(Condition("p_size", op, "25"), part.schema)).alias(
                "matching"
            ),
        )
        for op in fl.NUMBER_OPERATORS
        if op != "Between"
    ]
    return part.agg(F.array(*named).alias("_f")).select(F.inline("_f"))


@query("""
SELECT op, CAST(count(*) AS BIGINT) AS matching FROM (
  SELECT 'Equals' AS op FROM orders WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT 'NotEquals' FROM orders WHERE o_orderpriority <> '2-HIGH'
  UNION ALL SELECT 'Contains' FROM orders WHERE contains(o_orderpriority, 'E')
  UNION ALL SELECT 'StartsWith' FROM orders WHERE starts_with(o_orderpriority, '1-')
  UNION ALL SELECT 'EndsWith' FROM orders WHERE ends_with(o_orderpriority, 'W')) GROUP BY op
""")
def filter_text_operators(spark, sf):
    orders = table(spark, sf, "orders")
    wanted = {"Equals": "2-HIGH", "NotEquals": "2-HIGH", "Contains": "E", "StartsWith": "1-",
              "EndsWith": "W"}
    named = [
        F.struct(
            F.lit(op).alias("op"),
            F.count_if(
                fl.compile_condition(Condition("o_orderpriority", op, text), orders.schema)
            ).alias("matching"),
        )
        for op, text in wanted.items()
    ]
    return orders.agg(F.array(*named).alias("_f")).select(F.inline("_f"))


@query("SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY "
       "AND o_totalprice >= 20000 AND contains(o_orderpriority, 'URGENT')")
def filter_all_conditions(spark, sf):
    return _orders(
        spark,
        sf,
        Condition("o_orderdate", "RelativeDays", "365"),
        Condition("o_totalprice", "GreaterThanOrEqual", "20000"),
        Condition("o_orderpriority", "Contains", "URGENT"),
        Condition("o_orderstatus", "Equals", ""),  # incomplete, dropped
        Condition("o_custkey", "Between", "5", None),  # incomplete, dropped
    )


STORED = """{"Version": "1.0", "Filters": [
  {"FieldName": "l_shipdate", "Operator": "RelativeDays", "Value": "RELATIVE:900",
   "ValueEnd": null, "LogicalOperator": "AND"},
  {"FieldName": "l_quantity", "Operator": "Between", "Value": "5", "ValueEnd": "40.5",
   "LogicalOperator": "AND"},
  {"FieldName": "l_returnflag", "Operator": "NotEquals", "Value": "N", "ValueEnd": null,
   "LogicalOperator": "AND"}]}"""


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem "
       "WHERE l_shipdate <= TIMESTAMP '2001-08-02' - INTERVAL 900 DAY "
       "AND l_quantity BETWEEN 5 AND 40.5 AND l_returnflag <> 'N'")
def filter_stored_definition(spark, sf):
    items = table(spark, sf, "lineitem")
    kept = items.filter(fl.filter_from_json(STORED, items.schema, AS_OF))
    return kept.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@query("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-02' - INTERVAL 700 DAY")
def filter_raw_fragment(spark, sf):
    text = "< DATEADD(DAY, -700, GETDATE())"
    return table(spark, sf, "orders").filter(fl.raw_filter("o_orderdate", text, AS_OF))


@query("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' "
       "AND (o_orderstatus = 'F' OR o_totalprice > 90000)")
def filter_raw_predicate(spark, sf):
    text = "[o_orderdate] < '1999-01-01' AND ([o_orderstatus] = 'F' OR o_totalprice > 90000)"
    return table(spark, sf, "orders").filter(fl.raw_filter("o_orderdate", text))


@query("SELECT CAST(count(*) FILTER (WHERE l_shipdate <= TIMESTAMP '2001-08-02' "
       "- INTERVAL 1000 DAY) AS BIGINT) AS matching_rows, CAST(count(*) AS BIGINT) AS total_rows "
       "FROM lineitem")
def estimate_rows(spark, sf):
    items = table(spark, sf, "lineitem")
    old = fl.compile_filter(
        [Condition("l_shipdate", "RelativeDays", "1000")], items.schema, AS_OF
    )
    return fl.estimate(items, old)


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_size <= 25 AND "
       "(contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') "
       "OR contains(lower(p_type), 'bolt'))")
def search_jobs(spark, sf):
    jobs = table(spark, sf, "part").withColumn("enabled", F.col("p_size") <= 25)
    found = fl.search_jobs(
        jobs, True, " BOLT ", flag="enabled", columns=("p_name", "p_brand", "p_type")
    )
    return found.select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT event_id, user_id, event_type FROM events "
       "WHERE value >= 20 AND event_type IN ('signup', 'click', 'view')")
def active_tasks(spark, sf):
    tasks = table(spark, sf, "events").withColumn("deleted", F.col("value") < 20)
    open_states = ("signup", "click", "view")
    kept = fl.active(tasks, status="event_type", statuses=open_states, deleted="deleted")
    return kept.select("event_id", "user_id", "event_type")


@query("SELECT event_id, ts FROM events WHERE event_type <> 'error' "
       "AND ts <= TIMESTAMP '2024-01-15 12:00:00'")
def due_jobs(spark, sf):
    jobs = table(spark, sf, "events").withColumn("enabled", F.col("event_type") != "error")
    now = NOW.replace(day=15, hour=12)
    return fl.due_jobs(jobs, now, enabled="enabled", next_run="ts").select("event_id", "ts")


@query("SELECT status, method, CAST(count(*) AS BIGINT) AS rows FROM ("
       "SELECT CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status, "
       "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority "
       "ELSE '5-LOW' END AS method FROM orders) GROUP BY status, method")
def recode_status(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("method")
    )
    coded = fl.recode(orders, "status", {"P": "F"})
    coded = fl.recode(coded, "method", {}, default="5-LOW", valid=("1-URGENT", "2-HIGH"))
    return coded.groupBy("status", "method").agg(F.count(F.lit(1)).alias("rows"))
