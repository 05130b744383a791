"""Key lookups between a batch and its target, enrichment and cascade purge.

Keys match as SQL ``=`` does: a NULL key matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_lookup(left, right, keys, how="left_semi") -> DataFrame:
    """Semi or anti join on keys that survives hot keys on either side.

    The right side shrinks to its distinct keys before the shuffle. Both sides of the join
    are plain exchanges, so AQE splits a reducer that a hot or NULL key of the left side
    fills.
    """
    keys = list(keys)
    return left.join(right.select(*keys).dropna().distinct(), keys, how).select(*left.columns)


def _rangeable(dtype) -> bool:
    return isinstance(dtype, (T.IntegralType, T.DateType, T.TimestampNTZType, T.StringType))


def within_keys_of(target, batch, keys) -> DataFrame:
    """The target cut to the range of the batch's first key, which its scan can skip by."""
    first = list(keys)[0]
    dtype = batch.schema[first].dataType
    if not _rangeable(dtype):
        return target
    low, high = batch.agg(F.min(first), F.max(first)).first()
    if low is None:
        return target.limit(0)  # a NULL key matches nothing
    edges = [F.lit(str(v)).cast(dtype) for v in (low, high)]
    return target.filter(F.col(first).between(*edges))


def new_rows_of_batch(batch, target, keys) -> DataFrame:
    """``new_rows`` for a batch much smaller than its target.

    The target is narrowed to the batch's key range, which its scan can skip by, and then to
    the batch's own keys, before its distinct keys are made.
    """
    keys = list(keys)
    there = key_lookup(within_keys_of(target, batch, keys).select(*keys), batch, keys)
    return key_lookup(batch, there, keys, "left_anti")


def existing_rows(target, source, keys) -> DataFrame:
    """Count of target rows whose key is in the batch."""
    matched = key_lookup(target.select(*keys), source, keys, "left_semi")
    return matched.agg(F.count(F.lit(1)).alias("existing_rows"))


def new_rows(source, target, keys) -> DataFrame:
    """Source rows whose key the target does not have yet."""
    return key_lookup(source, target, keys, "left_anti")


def enrich(facts, lookups, keep=None) -> DataFrame:
    """Left-join lookup tables to facts and fill what is missing.

    ``lookups`` is a list of (table, fact column, table key, {new name: (column, text
    when missing)}). Spark broadcasts a lookup only if its size is under the session's
    threshold; otherwise the join shuffles and AQE splits hot keys.
    """
    out = facts
    for number, (table, fact_key, table_key, fields) in enumerate(lookups):
        marker = f"_key{number}"
        side = table.select(
            F.col(table_key).alias(marker), *[F.col(c).alias(n) for n, (c, _) in fields.items()]
        )
        out = out.join(side, F.col(fact_key) == F.col(marker), "left").drop(marker)
        for name, (_, text) in fields.items():
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(text)))
    return out if keep is None else out.select(*keep)


def purge_deleted(parent, children, *, key, deleted, child_key=None):
    """Rows of parent and child tables left once soft-deleted parents are purged."""
    gone = F.coalesce(F.col(deleted), F.lit(False))
    column = child_key or key
    dropped = parent.filter(gone).select(F.col(key).alias(column))
    kept = {name: key_lookup(t, dropped, [column], "left_anti") for name, t in children.items()}
    return parent.filter(~gone), kept
