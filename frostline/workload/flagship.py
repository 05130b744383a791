"""The query to look at first: what a retention rule would archive, per partition."""

from __future__ import annotations

from frostline.operators.filters import Condition, compile_filter
from frostline.operators.ranges import partition_rows
from frostline.workload.registry import AS_OF, YEARS, by_year, pno_sql, query, table


@query(f"SELECT {pno_sql('o_orderdate', YEARS)} AS partition_number, "
       "CAST(count(*) AS BIGINT) AS row_count FROM orders "
       "WHERE o_orderdate <= TIMESTAMP '2001-08-02' - INTERVAL 1000 DAY GROUP BY 1")
def archive_candidates(spark, sf):
    orders = table(spark, sf, "orders")
    old = compile_filter([Condition("o_orderdate", "RelativeDays", "1000")], orders.schema, AS_OF)
    return partition_rows(orders.filter(old), by_year())
