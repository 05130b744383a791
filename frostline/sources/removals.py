"""Rows that are gone from a table's files, as bitmaps over the rows' places.

A file is never changed. A commit names tables of bitmaps, one per span of 32 768 rows of a
file that lost any; readers leave the marked rows out. Taking rows away thus writes a few bytes
per row at most, whatever the size of the files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.names import free_names

SPAN_BITS = 15
SCHEMA = "file string, span bigint, bits binary"
# Spans whose bitmaps (4 KB each) every executor may hold; beyond that the join shuffles.
BROADCAST_SPANS = 4096


@dataclass(frozen=True)
class Removal:
    """A stored table of bitmaps: its folder, its spans and the rows it marks."""

    path: str
    spans: int
    rows: int


def bitmaps(addressed: DataFrame, file: str, row: str) -> DataFrame:
    """One bitmap per file and span of the given row addresses."""
    place = F.col(row).bitwiseAND(F.lit((1 << SPAN_BITS) - 1))
    return addressed.groupBy(
        F.col(file).alias("file"), F.shiftright(row, SPAN_BITS).cast("bigint").alias("span")
    ).agg(F.bitmap_construct_agg(place).alias("bits"))


def read_bitmaps(spark: SparkSession, removals) -> DataFrame:
    """The bitmaps of several removals, one per file and span."""
    found = spark.read.schema(SCHEMA).parquet(*[r.path for r in removals])
    if len(removals) < 2:
        return found
    return found.groupBy("file", "span").agg(F.bitmap_or_agg("bits").alias("bits"))


def _marked(row: Column, bits: Column) -> Column:
    """Whether a row's bit is set; NULL where its span has no bitmap."""
    place = row.bitwiseAND(F.lit((1 << SPAN_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), place.bitwiseAND(F.lit(7))) == 1


def _joined(addressed: DataFrame, removals, file: str, row: str, how: str):
    marks = read_bitmaps(addressed.sparkSession, removals)
    of_file, span, bits = free_names(addressed.columns, "of_file", "span", "bits")
    marks = marks.select(F.col("file").alias(of_file), F.col("span").alias(span), F.col("bits").alias(bits))
    small = sum(r.spans for r in removals) <= BROADCAST_SPANS
    marks = marks.hint("broadcast" if small else "shuffle_merge")
    same = (F.col(file) == F.col(of_file)) & (F.shiftright(row, SPAN_BITS) == F.col(span))
    joined = addressed.join(marks, same, how)
    return joined, _marked(F.col(row), F.col(bits)), addressed.columns


def without(addressed: DataFrame, removals, file: str, row: str) -> DataFrame:
    """The rows that no removal marks."""
    if not removals:
        return addressed
    joined, marked, columns = _joined(addressed, removals, file, row, "left")
    return joined.filter(~F.coalesce(marked, F.lit(False))).select(*columns)


def only(addressed: DataFrame, removals, file: str, row: str) -> DataFrame:
    """The rows that a removal marks."""
    joined, marked, columns = _joined(addressed, removals, file, row, "inner")
    return joined.filter(marked).select(*columns)


def rows_per_folder(spark: SparkSession, removals) -> DataFrame:
    """(folder, file, rows) marked: a row per file's folder and per file."""
    marks = read_bitmaps(spark, removals).select("file", F.bitmap_count("bits").alias("n"))
    per_file = marks.groupBy("file").agg(F.sum("n").alias("rows"))
    return per_file.groupBy(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).agg(
        F.sum("rows").alias("rows"), F.min("file").alias("file")
    )


def total(removals) -> int:
    return reduce(lambda a, b: a + b.rows, removals, 0)
