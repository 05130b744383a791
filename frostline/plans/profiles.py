"""Profiles of stored tables that are kept per part and merged, so that they read no row again.

A part of a table never changes, so its profile (rows, nulls, bounds, a distinct-count sketch and
a quantile sketch per column) is worked out once and kept in a table beside it. Appends add parts
and moves mark rows of some: only these are read by the next refresh. The profile of the whole
table is a merge of its parts' rows, a few KB each.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.plans.archive import unquoted
from frostline.sources import removals
from frostline.sources.store import Part, Snapshot, Store

SCHEMA = (
    "part string, column_name string, total_rows bigint, null_rows bigint, "
    "low_long bigint, high_long bigint, low_double double, high_double double, "
    "low_text string, high_text string, values binary, spread_long binary, spread_double binary"
)
# Parts that one job reads; a larger refresh takes several.
PARTS_PER_JOB = 64


class ProfileMissing(Exception):
    """Parts of the table, as it is now, have no profile yet."""


def _kind(dtype) -> str:
    if isinstance(dtype, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "long"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, T.StringType):
        return "text"
    raise ValueError(f"no profile per part for columns of type {dtype.simpleString()}")


def _as_long(name: str, dtype):
    """Integers as they are, days since 1970, microseconds since 1970."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(name).cast("bigint")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("bigint")


def _from_long(value, dtype):
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(value.cast("int"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(value).cast(dtype)
    return value


def _figures(schema: T.StructType, name: str):
    """One column's profile as a struct of aggregates."""
    dtype = schema[name].dataType
    kind = _kind(dtype)
    value = {"long": _as_long(name, dtype), "double": F.col(name).cast("double"), "text": F.col(name)}[kind]
    own = {
        "column_name": F.lit(name),
        "total_rows": F.count(F.lit(1)),
        "null_rows": F.count_if(F.col(name).isNull()),
        f"low_{kind}": F.min(value),
        f"high_{kind}": F.max(value),
        # the sketch takes integers and texts only
        "values": F.hll_sketch_agg(value.cast("string") if kind == "double" else value),
    }
    if kind != "text":
        sketch = F.kll_sketch_agg_bigint if kind == "long" else F.kll_sketch_agg_double
        own[f"spread_{kind}"] = sketch(value)
    wanted = T.StructType.fromDDL(SCHEMA)[1:]
    return F.struct(*[
        own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted
    ])


def _keys(spark: SparkSession, s: Snapshot) -> dict[str, Part]:
    """The parts of a version by a name that changes when rows of them are marked as gone. A row
    per folder that lost any comes back, as for a move."""
    lost = {}
    if s.removed:
        for r in removals.rows_per_folder(spark, s.removed).collect():
            lost[unquoted(r["folder"])] = r["rows"]

    def name(part: Part) -> str:
        files = zlib.crc32("|".join(part.files or ()).encode())
        path = unquoted(part.path)
        gone = sum(n for folder, n in lost.items() if f"{path}/".startswith(f"{folder}/"))
        return f"{path}#{files:08x}#{gone}"

    return {name(p): p for p in s.parts}


def _kept(table: Store) -> Store:
    return Store(table.spark, f"{table.path}_profile")


def refresh_profile(spark: SparkSession, table: Store, columns) -> int:
    """Profile the parts that have none for some of the columns; returns how many were read.

    Columns are integers, dates, times, floats or texts. An empty table has no parts.
    """
    s, kept = table.snapshot(), _kept(table)
    columns = list(dict.fromkeys(columns))
    figures = F.array(*[_figures(s.schema, c) for c in columns])
    kept.ensure(T.StructType.fromDDL(SCHEMA))
    wanted = F.col("column_name").isin(*columns)
    have = kept.read().filter(wanted).groupBy("part").agg(F.count_distinct("column_name").alias("n"))
    known = {r["part"] for r in have.filter(F.col("n") == len(columns)).collect()}
    new = [(k, p) for k, p in _keys(spark, s).items() if k not in known]
    for i in range(0, len(new), PARTS_PER_JOB):
        found = [
            Snapshot(s.version, s.schema, s.spec, (part,), removed=s.removed).read(spark)
            .agg(figures.alias("f")).select(F.lit(key).alias("part"), F.inline("f"))
            for key, part in new[i : i + PARTS_PER_JOB]
        ]
        kept.append(reduce(DataFrame.unionByName, found))
    return len(new)


def merged_profile(spark: SparkSession, table: Store, columns, shares=(0.5,)) -> DataFrame:
    """(column_name, min_value, max_value, total_rows, null_rows, distinct_rows, quantiles).

    Rows, nulls and bounds are exact; the distinct count is a sketch's estimate (about 2 %), and
    so are the quantiles, as texts in the order of ``shares`` (about 1 % of the ranks; NULL for
    texts). Only profiles are read. A table without parts gives no rows; parts without a profile
    are an error.
    """
    s, kept = table.snapshot(), _kept(table)
    columns = list(dict.fromkeys(columns))
    keys = list(_keys(spark, s))
    if not keys:
        return spark.createDataFrame(
            [], "column_name string, min_value string, max_value string, total_rows bigint, "
            "null_rows bigint, distinct_rows bigint, quantiles array<string>",
        )
    if not kept.exists():
        raise ProfileMissing(f"{table.path} has no profile")
    now = spark.createDataFrame([(k,) for k in keys], "part string")
    rows = kept.read().filter(F.col("column_name").isin(*columns))
    # two refreshes at a time may both have read a part
    rows = rows.join(now, "part", "left_semi").dropDuplicates(["part", "column_name"])
    there = rows.count()
    if there != len(keys) * len(columns):
        raise ProfileMissing(f"{len(keys) * len(columns) - there} profiles of {table.path} are missing")
    merged = rows.groupBy("column_name").agg(
        *[F.sum(c).alias(c) for c in ("total_rows", "null_rows")],
        *[F.min(f"low_{k}").alias(f"low_{k}") for k in ("long", "double", "text")],
        *[F.max(f"high_{k}").alias(f"high_{k}") for k in ("long", "double", "text")],
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct_rows"),
        F.kll_merge_agg_bigint("spread_long").alias("spread_long"),
        F.kll_merge_agg_double("spread_double").alias("spread_double"),
    )
    ranks = F.array(*[F.lit(float(q)) for q in shares])
    filled = F.col("total_rows") > F.col("null_rows")
    branches = []
    for c in columns:
        dtype = s.schema[c].dataType
        kind = _kind(dtype)
        shown = (lambda v: _from_long(v, dtype).cast("string")) if kind == "long" else (lambda v: v.cast("string"))
        quantiles = F.lit(None).cast("array<string>")
        if kind != "text":
            found = {"long": F.kll_sketch_get_quantile_bigint, "double": F.kll_sketch_get_quantile_double}[kind]
            quantiles = F.when(filled, F.transform(found(f"spread_{kind}", ranks), shown))
        branches.append((c, shown(F.col(f"low_{kind}")), shown(F.col(f"high_{kind}")), quantiles))

    def pick(i):
        return F.coalesce(*[F.when(F.col("column_name") == b[0], b[i]) for b in branches])

    return merged.select(
        "column_name", pick(1).alias("min_value"), pick(2).alias("max_value"), "total_rows",
        "null_rows", "distinct_rows", pick(3).alias("quantiles"),
    )
