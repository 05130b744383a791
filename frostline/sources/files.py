"""Scans of copyable columns and file round trips with tolerated bad rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The formats of a file.
FORMATS = ("native", "unicode", "char", "lines")
# How a line break within a text, and the escape itself, are written in the format of lines; in
# the order in which they are read back.
ESCAPES = (("\\n", "\n"), ("\\r", "\r"), ("\\s", "\\"))
# Keeps one file small enough for one task, as text with line breaks cannot be split.
ROWS_PER_FILE = 1_000_000

BAD_ROW = "_corrupt_record"
# What a quoted empty field reads as until it is turned back into an empty text; an
# unquoted one is NULL.
EMPTY = "\u0001empty\u0001"


class TooManyBadRows(Exception):
    """More rows could not be parsed than the load tolerates."""


def scan(df: DataFrame, exclude=(), exclude_types=()) -> DataFrame:
    """The columns to copy: all but those named (computed, row version) or of a type."""
    dropped = {c.lower() for c in exclude}
    unknown = dropped - {c.lower() for c in df.columns}
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    kept = [
        f.name
        for f in df.schema
        if f.name.lower() not in dropped and f.dataType.simpleString() not in exclude_types
    ]
    return df.select(*kept)


def _text_options(fmt: str) -> dict:
    return {
        "sep": "\t",
        "encoding": "UTF-16LE" if fmt == "unicode" else "UTF-8",
        "escape": '"',
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    }


def _binary(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.BinaryType)]


def export(df: DataFrame, path: str, fmt: str = "unicode") -> None:
    """Write rows to files: native (parquet), unicode (UTF-16), char (UTF-8) text, or lines.

    Lines are UTF-8 text with every record on one line, breaks within texts escaped, so that many
    tasks read one file, whatever its size. The other text formats keep breaks as they are.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    if fmt == "native":
        df.write.parquet(path)
        return
    for name in _binary(df.schema):
        df = df.withColumn(name, F.base64(name))
    if fmt == "lines":
        df.select(*[_one_line(f) for f in df.schema]).write.options(**_text_options(fmt)).csv(path)
        return
    writer = df.write.options(**_text_options(fmt))
    writer.option("maxRecordsPerFile", ROWS_PER_FILE).csv(path)


def _one_line(f: T.StructField):
    """A text with its breaks escaped; other columns as they are."""
    value = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.StringType):
        for escaped, plain in reversed(ESCAPES):  # the escape itself goes first
            value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value.alias(f.name)


def _with_breaks(value):
    for escaped, plain in ESCAPES:
        value = F.replace(value, F.lit(escaped), F.lit(plain))
    return value


def load(
    spark: SparkSession, path: str, schema: T.StructType, fmt="unicode",
    max_errors: int | None = 0, rejects: str | None = None,
) -> DataFrame:
    """Read files back; more rows that do not parse than tolerated fail the load.

    None tolerates any number. ``rejected`` returns the rows that are left out; with a folder for
    ``rejects`` they are also written there as text, before the load may fail.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    if fmt == "native":
        return spark.read.schema(schema).parquet(path)
    binary = _binary(schema)
    rows, text = _parsed(spark, path, schema, fmt)
    if rejects is not None:
        bad = rows.filter(_is_bad(schema)).select(F.col(BAD_ROW).alias("raw"))
        bad.write.text(rejects)
    if max_errors is not None:
        errors = rows.agg(F.count_if(_is_bad(schema))).first()[0]
        if errors > max_errors:
            raise TooManyBadRows(f"{errors} rows did not parse, {max_errors} are tolerated")
    good = rows.filter(~_is_bad(schema))
    for f in text:
        if isinstance(f.dataType, T.StringType):
            value = F.col(f.name)
            text_ = _with_breaks(value) if fmt == "lines" and f.name not in binary else value
            good = good.withColumn(f.name, F.when(value == EMPTY, F.lit("")).otherwise(text_))
    for name in binary:
        good = good.withColumn(name, F.unbase64(name))
    return good.select(*schema.names)


def _is_bad(schema: T.StructType):
    """True for rows that don't parse. A reader converts, and so checks, only the columns
    that are asked for, so the test asks for all of them."""
    every = F.hash(*schema.names).cast("string")
    return F.coalesce(F.length(F.concat(BAD_ROW, every)) >= 0, F.lit(False))


def rejected(spark: SparkSession, path: str, schema: T.StructType, fmt="unicode") -> DataFrame:
    """The rows a load leaves out, as the text that did not parse."""
    if fmt == "native":
        return spark.createDataFrame([], "raw string")
    rows, _ = _parsed(spark, path, schema, fmt)
    return rows.filter(_is_bad(schema)).select(F.col(BAD_ROW).alias("raw"))


def _parsed(spark, path, schema, fmt) -> tuple[DataFrame, T.StructType]:
    """All rows with the text of those that do not parse, and the schema they are read by."""
    binary = _binary(schema)
    text = T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name in binary else f for f in schema]
    )
    rows = (
        spark.read.schema(T.StructType([*text, T.StructField(BAD_ROW, T.StringType())]))
        .options(**_text_options(fmt))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_ROW)
        .option("columnPruning", "false")  # every column is parsed, whatever is read later
        .option("multiLine", str(fmt != "lines").lower())
        .option("emptyValue", EMPTY)
        .csv(path)
    )
    return rows, text
