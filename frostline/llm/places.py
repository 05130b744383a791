"""Places of rows in the order of their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import parallelism
from frostline.operators.ordering import PLACE_BITS
from frostline.session import write_scratch


def free_name(wanted: str, *taken) -> str:
    """``wanted``, with underscores in front until no name in ``taken`` equals it.

    Names are compared as Spark does, without regard to case.
    """
    used = {str(n).lower() for n in taken}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted


def places_in_groups(rows: DataFrame, group: str, order: list[Column], name: str, label: str) -> DataFrame:
    """``rows`` with each row's place in its group, from 0 on, in the given order.

    Rows are spread by ranges of (group, order, a row number written before the shuffle), so
    neither a group nor a run of equal rows has to fit one task. A range holds consecutive
    rows; one short row per group and range then tells how many rows of the group lie in the
    ranges before. Nulls form a group of their own and come first.
    """
    tie = free_name("tie", *rows.columns, name)
    at = free_name("at", *rows.columns, name)
    spark = rows.sparkSession
    stable = write_scratch(rows.withColumn(tie, F.monotonically_increasing_id()), f"{label}-rows")
    sort = [F.asc_nulls_first(group), *order, F.asc(tie)]
    placed = write_scratch(
        stable.repartitionByRange(parallelism(spark), *sort)
        .sortWithinPartitions(*sort)
        .withColumn(at, F.monotonically_increasing_id())
        .drop(tie),
        f"{label}-sorted",
    )
    ranged = placed.withColumn("__range__", F.shiftright(at, PLACE_BITS))
    runs = ranged.groupBy(F.col(group).alias("__group__"), "__range__").agg(
        F.count(F.lit(1)).alias("__rows__"), F.min(at).alias("__first__")
    )
    earlier = Window.partitionBy("__group__").orderBy("__range__").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("__range__").alias("__in__"),
        "__group__",
        (F.coalesce(F.sum("__rows__").over(earlier), F.lit(0)) - F.col("__first__")).alias("__shift__"),
    )
    same = (F.col("__range__") == F.col("__in__")) & F.col(group).eqNullSafe(F.col("__group__"))
    return ranged.join(runs, same).select(*rows.columns, (F.col(at) + F.col("__shift__")).alias(name))
