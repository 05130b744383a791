"""Connected components of an edge table by alternating star contractions.

Each round links every node to the smallest node it can see (first from above, then from
below), so paths halve and the number of rounds grows with the logarithm of the longest one.
Rounds are written to the shared folder; edges and labels never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.session import write_scratch


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a < b, each node tied to the smallest of its neighbours or itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))  # neighbours below
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:  # neighbours above go to the smallest
        out = joined.where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        out = joined.select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, comp) of every node with an edge; comp is the component's smallest node."""
    now = write_scratch(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label
    )
    seen = _fingerprint(now)
    while seen[0]:
        now = write_scratch(_star(_star(now, large=True), large=False), label)
        after = _fingerprint(now)
        if after == seen:
            break
        seen = after
    # every edge now leads from a component's smallest node to one of the others
    return now.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    )
