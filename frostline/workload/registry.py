"""Named queries over the given tables, each with the SQL that must agree with it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from frostline.spec import PartitionSpec, ValueKind

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Moments the queries take as "now"; nothing reads a clock.
AS_OF = datetime(2001, 8, 2)
NOW = datetime(2024, 1, 31)

YEARS = tuple(f"{y}-01-01" for y in range(1996, 2002))


def query(sql: str | None = None):
    """Register a function under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_year(range_right=True, column="o_orderdate") -> PartitionSpec:
    return PartitionSpec(column, ValueKind.DATETIME2, YEARS, range_right)


def pno_sql(column: str, boundaries, right=True, literal="TIMESTAMP '{}'") -> str:
    """Partition number as SQL, by counting boundaries one by one."""
    op = ">=" if right else ">"
    terms = [
        f"CASE WHEN {column} {op} {literal.format(b)} THEN 1 ELSE 0 END" for b in boundaries
    ]
    return "CAST(1 + " + " + ".join(terms) + " AS INTEGER)"


def year_text(year: str) -> str:
    return f"{year} 00:00:00.0000000"


def list_sql(boundaries, text=lambda b: b) -> str:
    """The partition list as VALUES: number, lower bound, upper bound."""
    texts = [None, *[text(b) for b in boundaries], None]
    show = lambda v: "NULL" if v is None else f"'{v}'"
    rows = [f"({i + 1}, {show(a)}, {show(b)})" for i, (a, b) in enumerate(zip(texts, texts[1:]))]
    return (
        "(SELECT CAST(n AS INTEGER) AS n, CAST(lo AS VARCHAR) AS lo, CAST(hi AS VARCHAR) AS hi "
        "FROM (VALUES " + ", ".join(rows) + ") AS v(n, lo, hi))"
    )
