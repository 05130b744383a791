"""Checks of data before and after a move."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.operators.joins import existing_rows, key_lookup, new_rows
from frostline.operators.ranges import read_partition, residual, with_partition_no
from frostline.spec import PartitionSpec

# Sums of this many hash bits stay inside a long for 2^43 rows.
SUM_BITS = 20


class DuplicateRows(Exception):
    """The target already holds rows of the batch."""


def content_marks(columns) -> list:
    """Order-free fingerprint of rows: count, 64-bit xor and a sum of hash bits.

    The sum tells apart what the xor cancels (rows in pairs).
    """
    digest = F.xxhash64(*columns)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(digest), F.lit(0)).cast("bigint").alias("mark_xor"),
        F.coalesce(F.sum(digest.bitwiseAND(F.lit((1 << SUM_BITS) - 1))), F.lit(0))
        .cast("bigint")
        .alias("mark_sum"),
    ]


def reconcile(expected: int, existing: int, copied: int) -> tuple[str, bool]:
    """Outcome of a load from its three counts: (full | incremental | nothing_new, ok)."""
    if existing == 0:
        return "full", copied == expected
    wanted = expected - existing
    if wanted > 0:
        return "incremental", copied == wanted
    return "nothing_new", copied == 0


def reconcile_by(source: DataFrame, target: DataFrame, spec: PartitionSpec) -> DataFrame:
    """Rows of both sides per partition; same counts with other rows do not match."""
    columns = sorted(source.columns)

    def side(df, rows, prefix):
        return (
            with_partition_no(df.select(*columns), spec, "partition_number")
            .groupBy("partition_number")
            .agg(*[m.alias(f"{prefix}{i}") for i, m in enumerate(content_marks(columns))])
            .withColumnRenamed(f"{prefix}0", rows)
        )

    # One row per partition on either side.
    both = side(source, "source_rows", "_s").join(
        side(target, "target_rows", "_t"), "partition_number", "full_outer"
    )
    same = reduce(lambda a, b: a & b, [F.col(f"_s{i}") == F.col(f"_t{i}") for i in (1, 2)])
    zero = F.lit(0).cast("bigint")
    return both.select(
        "partition_number",
        F.coalesce("source_rows", zero).alias("source_rows"),
        F.coalesce("target_rows", zero).alias("target_rows"),
        F.coalesce(same & (F.col("source_rows") == F.col("target_rows")), F.lit(False)).alias(
            "matches"
        ),
    )


def guard_duplicates(source: DataFrame, target: DataFrame, keys, mode: str) -> DataFrame:
    """Rows to load: all of them if the target has none ('fail'), else the new ones ('skip')."""
    if mode == "skip":
        return new_rows(source, target, keys)
    if mode != "fail":
        raise ValueError("mode is 'fail' or 'skip'")
    if not key_lookup(target.select(*keys), source, keys, "left_semi").isEmpty():
        raise DuplicateRows("the target already holds rows of this batch")
    return source


class RepeatedKeys(Exception):
    """Keys that should be unique are held by several rows of the batch."""


def require_unique(df: DataFrame, keys) -> None:
    """Fails if any key without NULLs is held by more than one row."""
    per_key = df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if not per_key.filter(F.col("_n") > 1).isEmpty():
        raise RepeatedKeys(f"{list(keys)} are not unique; use on_duplicate='append'")


def same_rows(df: DataFrame, target: DataFrame, keys, columns, how="left_semi") -> DataFrame:
    """Rows that the target holds with the very same values in ``columns`` (or lacks: anti).

    The target is narrowed to the batch's keys first; those join as SQL ``=``, all other
    columns null-safe.
    """
    known = key_lookup(target.select(*columns), df, keys, "left_semi")
    known = known.select(*[F.col(c).alias(f"_t_{c}") for c in columns])
    same = [F.col(k) == F.col(f"_t_{k}") for k in keys]
    same += [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in columns if c not in keys]
    return df.join(known, reduce(lambda a, b: a & b, same), how)


def conflicts(df: DataFrame, target: DataFrame, keys, columns) -> DataFrame:
    """Rows whose key the target holds, but not with the same content."""
    unlike = same_rows(df, target, keys, columns, "left_anti")
    return key_lookup(unlike, target, keys, "left_semi")


def _misfits(column: str, have: T.DataType, want: T.DataType) -> list:
    """(issue, condition) pairs for values that would not fit the target type."""
    value = F.col(column)
    length = getattr(want, "length", None)
    if isinstance(want, (T.VarcharType, T.CharType)) and length:
        return [("length", F.length(value.cast("string")) > length)]
    if isinstance(want, T.StringType) or have == want:
        return []
    fitted = value.try_cast(want)
    lost = value.isNotNull() & fitted.isNull()
    if isinstance(want, T.DecimalType):
        source_text = isinstance(have, T.StringType)
        wide = value.try_cast("double") if source_text else value
        overflow = lost & wide.isNotNull() if source_text else lost
        # as many digits behind the point as the target's digits before it leave room for
        digits = 38 - (want.precision - want.scale)
        exact = value.try_cast(T.DecimalType(38, digits)) if source_text else value
        if isinstance(have, (T.DoubleType, T.FloatType)):
            changed = fitted.cast("double") != value.cast("double")
        elif isinstance(have, T.DecimalType) and have.scale <= want.scale:
            changed = F.lit(False)  # only the range can fail
        else:
            changed = exact != F.round(exact, want.scale)
        rounded = fitted.isNotNull() & changed
        found = [("precision", overflow), ("scale", rounded)]
        return found + ([("type", lost & wide.isNull())] if source_text else [])
    if isinstance(want, T.IntegralType) and isinstance(have, T.FractionalType):
        cut = fitted.isNotNull() & (fitted.cast("double") != value.cast("double"))
        return [("range", lost), ("scale", cut)]
    return [("type" if isinstance(have, T.StringType) else "range", lost)]


def _fit_conditions(source: T.StructType, target: T.StructType) -> list:
    """(column, issue, condition) for everything that may not fit the target."""
    wanted = {f.name.lower(): f.dataType for f in target}
    found = []
    for f in source:
        if f.name.lower() not in wanted:
            found.append((f.name, "missing", F.lit(True)))
            continue
        for issue, bad in _misfits(f.name, f.dataType, wanted[f.name.lower()]):
            found.append((f.name, issue, bad))
    return found


def fit_audit(df: DataFrame, target: T.StructType) -> DataFrame:
    """Rows that would not fit the target's columns, per column and issue, in one pass.

    A source column the target lacks counts all of its rows.
    """
    empty = "array<struct<column_name:string,issue:string,bad_rows:bigint>>"
    figures = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(issue).alias("issue"),
            F.count_if(bad).alias("bad_rows"),
        )
        for name, issue, bad in _fit_conditions(df.schema, target)
    ]
    found = F.array(*figures) if figures else F.array().cast(empty)
    return df.agg(F.count(F.lit(1)).alias("_n"), found.alias("_f")).select(F.inline("_f"))


def null_keys(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("null_rows"))


def key_violations(df: DataFrame, keys, target: DataFrame | None = None) -> DataFrame:
    """Keys held by more than one row of the batch, or of batch and target together.

    With a target, only keys the batch has are looked at.
    """
    keys = list(keys)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("batch_rows"))
    if target is None:
        return per_key.filter(F.col("batch_rows") > 1)
    there = target.groupBy(*keys).agg(F.count(F.lit(1)).alias("target_rows"))
    both = per_key.join(there, keys, "left").withColumn(
        "target_rows", F.coalesce("target_rows", F.lit(0).cast("bigint"))
    )
    return both.filter(F.col("batch_rows") + F.col("target_rows") > 1)


def duplicate_groups(df: DataFrame, keys, *, deleted: str) -> DataFrame:
    """Key groups with more than one row: all rows, active ones, soft-deleted ones."""
    gone = F.coalesce(F.col(deleted), F.lit(False))
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_records"),
            F.count_if(~gone).alias("active_records"),
            F.count_if(gone).alias("deleted_records"),
        )
        .filter(F.col("total_records") > 1)
    )


def _rule(rule) -> Column:
    return F.expr(rule) if isinstance(rule, str) else rule


def rule_violations(df: DataFrame, rules: dict) -> DataFrame:
    """Rows breaking each rule (name → Column or SQL text); NULL passes, as in CHECK."""
    figures = [
        F.struct(F.lit(name).alias("rule"), F.count_if(~_rule(rule)).alias("violations"))
        for name, rule in rules.items()
    ]
    return df.agg(F.array(*figures).alias("_f")).select(F.inline("_f"))


def schema_issues(source: T.StructType, target: T.StructType) -> list[tuple[str, str]]:
    """Why a partition could not be switched: (code, column); the first difference only."""
    if len(source) != len(target):
        return [("ColumnCountMismatch", "")]
    for mine, theirs in zip(source, target):
        if mine.name.lower() != theirs.name.lower():
            return [("ColumnNameMismatch", mine.name)]
        if mine.dataType != theirs.dataType:
            return [("ColumnTypeMismatch", mine.name)]
        if mine.nullable != theirs.nullable:
            return [("ColumnNullabilityMismatch", mine.name)]
    return []


def inspect_move(
    source, target, spec: PartitionSpec, number: int, keys, rules=None, target_schema=None
) -> DataFrame:
    """Everything that speaks against moving one partition, as (code, severity, rows).

    ``may_proceed`` is true on every row when there is no blocker and no open fix.
    Only that partition is read on either side, and its rows are checked in one pass;
    key checks, which group, are passes of their own.
    """
    part, there = (read_partition(df, spec, number) for df in (source, target))
    wanted = target_schema or target.schema

    def finding(code, severity, rows):
        return F.struct(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            F.coalesce(rows, F.lit(0)).cast("bigint").alias("rows"),
        )

    def total(conditions):
        counts = [F.count_if(c) for c in conditions]
        return reduce(lambda a, b: a + b, counts) if counts else F.lit(0)

    misfits = [bad for _, _, bad in _fit_conditions(part.schema, wanted)]
    broken = [~_rule(r) for r in (rules or {}).values()]
    of_rows = [
        finding("NullPartitionKey", "blocker", F.count_if(F.col(spec.column).isNull())),
        finding("ValueDoesNotFit", "blocker", total(misfits)),
        finding("RuleViolation", "blocker", total(broken)),
        *[finding(code, "blocker", F.lit(1)) for code, _ in schema_issues(source.schema, wanted)],
    ]
    passes = [
        part.agg(F.count(F.lit(1)).alias("_n"), F.array(*of_rows).alias("_f")).select(
            F.inline("_f")
        ),
        key_violations(part, keys)
        .agg(finding("DuplicateKey", "blocker", F.sum("batch_rows")).alias("_f"))
        .select("_f.*"),
        residual(target, spec, number).select(
            F.inline(F.array(finding("TargetPartitionNotEmpty", "fix", F.col("residual_rows"))))
        ),
        existing_rows(there, part, keys).select(
            F.inline(F.array(finding("KeyInTarget", "warning", F.col("existing_rows"))))
        ),
    ]
    stops = F.count_if(F.col("severity").isin("blocker", "fix"))
    report = reduce(DataFrame.unionByName, passes).filter(F.col("rows") > 0)
    # A handful of findings: one window over them all.
    return report.withColumn("may_proceed", stops.over(Window.partitionBy()) == 0)
