"""Helpers of the text operators: tables, words, and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# A word is a run of anything but these six characters, in Java and RE2 syntax alike.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def parallelism(spark: SparkSession) -> int:
    """Tasks worth having at once: the cores, or the shuffle partitions if those are more."""
    return max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )


def refuse_names(keep, *made: str) -> None:
    """A column to keep must not be named like one the operator adds."""
    clash = {n.lower() for n in keep} & {n.lower() for n in made}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are added here; rename them before")


SLICE_CHARS = 2_000_000


def text_slices(batches, column: str = "text", chars: int = SLICE_CHARS):
    """Parts of Arrow batches with about ``chars`` bytes of text each, so that what a task
    holds at once doesn't depend on how many rows Spark puts into a batch."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = held = 0
        for i, size in enumerate(sizes):
            if i > first and held + size > chars:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)
