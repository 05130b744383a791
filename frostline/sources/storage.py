"""Sizes of stored tables from file listings; no file is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1024 * 1024


def data_files(spark: SparkSession, path) -> DataFrame:
    """Path and length of every data file below a folder (or several); listing many
    folders runs on executors."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length")
    )


def storage_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and MB below a folder."""
    return data_files(spark, path).agg(
        F.count(F.lit(1)).alias("files"),
        F.round(F.coalesce(F.sum("length"), F.lit(0)) / MB, 2).alias("size_mb"),
    )


def partition_sizes(spark: SparkSession, path: str, column: str = "_pno") -> DataFrame:
    """MB per partition of a table stored in ``column=value`` folders."""
    number = F.regexp_extract("path", f"/{column}=([0-9]+)/", 1)
    return (
        data_files(spark, path)
        .withColumn("partition_number", number.try_cast("int"))
        .filter(F.col("partition_number").isNotNull())
        .groupBy("partition_number")
        .agg(F.round(F.sum("length") / MB, 2).alias("size_mb"))
    )
