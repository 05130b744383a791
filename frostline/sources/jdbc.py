"""Parallel reads and batched writes of a database table.

The driver jar of the database is the caller's; nothing here connects by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed value: rows per write batch.
BATCH_SIZE = 10_000


def read_options(url, query, column=None, lower=None, upper=None, partitions=None, **extra) -> dict:
    """Options of a read that splits a query into ranges of one column.

    The bounds only set the width of the ranges; rows outside them are read too.
    """
    options = {"url": url, "dbtable": f"({query}) src", "pushDownPredicate": "true", **extra}
    split = (column, lower, upper, partitions)
    if any(v is not None for v in split):
        if any(v is None for v in split):
            raise ValueError("column, lower, upper and partitions go together")
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def scan_jdbc(spark: SparkSession, url, query, column=None, lower=None, upper=None,
              partitions=None, **extra) -> DataFrame:
    options = read_options(url, query, column, lower, upper, partitions, **extra)
    return spark.read.format("jdbc").options(**options).load()


def write_options(url, table, batch_size=BATCH_SIZE, partitions=None, **extra) -> dict:
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    options = {"url": url, "dbtable": table, "batchsize": str(batch_size), **extra}
    return options if partitions is None else options | {"numPartitions": str(partitions)}


def append_jdbc(df: DataFrame, url, table, batch_size=BATCH_SIZE, partitions=None, **extra):
    options = write_options(url, table, batch_size, partitions, **extra)
    df.write.format("jdbc").options(**options).mode("append").save()
