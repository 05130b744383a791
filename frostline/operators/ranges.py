"""Range partitioning of tables: assignment, per-partition views, change impact.

The partition number is a computed column. It never shuffles, joins or calls
Python, and counting by it collapses to at most one row per partition and task
before the only shuffle.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.functions.names import free_names
from frostline.functions.values import sort_key
from frostline.spec import (
    MAX_PARTITIONS,
    PartitionSpec,
    Retention,
    ValueKind,
    boundary_lit,
    invariant_text,
)

# Boundaries one comparison tree may hold. The JVM leaves a method over 8000 bytes
# uncompiled, which a larger tree would reach.
TREE_LIMIT = 64


def _tree(value: str, boundaries, low: int, high: int, right: bool) -> str:
    """SQL for the count of boundaries at or below (RIGHT) / below (LEFT) the value.

    Halving keeps it at log2(k) comparisons a row. ``boundaries`` are SQL texts.
    """
    if low == high:
        return str(low)
    middle = (low + high) // 2
    side = ">=" if right else ">"
    return (
        f"CASE WHEN {value} {side} {boundaries[middle]} "
        f"THEN {_tree(value, boundaries, middle + 1, high, right)} "
        f"ELSE {_tree(value, boundaries, low, middle, right)} END"
    )


def quoted(text: str) -> str:
    """Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_literal(spec: PartitionSpec, value) -> str:
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
    return f"CAST({quoted(text)} AS {spec.kind.spark_type})"


def partition_column(spec: PartitionSpec) -> Column:
    """Partition number as one expression, for up to TREE_LIMIT boundaries."""
    count = len(spec.boundaries)
    if count > TREE_LIMIT:
        raise ValueError("too many boundaries for one expression; use with_partition_no")
    literals = [_sql_literal(spec, b) for b in spec.boundaries]
    # A NULL value fails every comparison, so it ends in partition 1.
    tree = _tree(f"`{spec.column}`", literals, 0, count, spec.range_right)
    return F.expr(f"CAST(1 + {tree} AS INT)")


def with_partition_no(df: DataFrame, spec: PartitionSpec, name: str = "_pno") -> DataFrame:
    """Add the partition number: 1 + count(b <= v) for RIGHT, 1 + count(b < v) for LEFT.

    Many boundaries become one constant array, searched by halving steps: log2(k)
    short projections inside one generated loop, whatever the size of the list.
    """
    count = len(spec.boundaries)
    if count <= TREE_LIMIT:
        return df.withColumn(name, partition_column(spec))
    array = ", ".join(_sql_literal(spec, b) for b in spec.boundaries)
    side = "<=" if spec.range_right else "<"
    bounds, at = free_names([*df.columns, name], "_bounds", "_at")
    out = df.withColumns({bounds: F.expr(f"array({array})"), at: F.lit(0)})
    for bit in reversed(range(count.bit_length())):
        step = 1 << bit
        # Past the end ``get`` gives NULL, and a NULL value compares as NULL: no step.
        jump = f"get({bounds}, {at} + {step - 1}) {side} `{spec.column}`"
        out = out.withColumn(at, F.expr(f"{at} + IF({jump}, {step}, 0)"))
    return out.withColumn(name, F.expr(f"CAST({at} + 1 AS INT)")).drop(bounds, at)


def partition_predicate(spec: PartitionSpec, number: int, last: int | None = None) -> Column:
    """Bounds of a partition, or of several in a row, as a predicate the scan can push down."""
    lower, upper = spec.bounds(number)[0], spec.bounds(last or number)[1]
    value = F.col(spec.column)
    parts = []
    if lower is not None:
        edge = boundary_lit(spec.kind, lower)
        parts.append(value >= edge if spec.range_right else value > edge)
    if upper is not None:
        edge = boundary_lit(spec.kind, upper)
        parts.append(value < edge if spec.range_right else value <= edge)
    inside = reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    return inside | value.isNull() if number == 1 and parts else inside


def read_partition(df: DataFrame, spec: PartitionSpec, number: int) -> DataFrame:
    """Rows of one partition of a plain table, by pushed-down bounds."""
    return df.filter(partition_predicate(spec, number))


def partition_rows(df: DataFrame, spec: PartitionSpec) -> DataFrame:
    """Row count per partition that holds rows."""
    return (
        with_partition_no(df.select(spec.column), spec, "partition_number")
        .groupBy("partition_number")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def partition_list(spark: SparkSession, spec: PartitionSpec) -> DataFrame:
    """One row per partition of the function, empty ones included.

    ``boundary_value`` is the boundary whose ordinal equals the partition number,
    that is the upper bound for both sides; the last partition has none.
    """
    ends = [quoted(t) for t in spec.texts()]
    rows = zip(["NULL", *ends], [*ends, "NULL"])
    values = ", ".join(f"({n}, {low}, {high})" for n, (low, high) in enumerate(rows, 1))
    frame = spark.sql(  # an inline table is a local relation of known size
        "SELECT partition_number, CAST(lower_bound AS STRING) AS lower_bound, "
        "CAST(upper_bound AS STRING) AS upper_bound "
        f"FROM VALUES {values} AS t(partition_number, lower_bound, upper_bound)"
    )
    return frame.select(
        "partition_number",
        sort_key(F.col("partition_number")).alias("sort_key"),
        "lower_bound",
        "upper_bound",
        F.coalesce("upper_bound", F.lit("N/A")).alias("boundary_value"),
        F.lit(spec.range_type).alias("range_type"),
    )


def _counted(df: DataFrame, spec: PartitionSpec, chosen=None) -> DataFrame:
    """The partition list with row counts; both sides have at most k + 1 rows.

    ``chosen`` names the partitions wanted: then the scan is bounded by the first and the last.
    """
    listed = partition_list(df.sparkSession, spec)
    if chosen is not None:
        listed = listed.filter(F.col("partition_number").isin(*chosen))
        inside = partition_predicate(spec, min(chosen), max(chosen)) if chosen else F.lit(False)
        df = df.filter(inside)
    counts = F.broadcast(partition_rows(df, spec))
    return (
        listed.join(counts, "partition_number", "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))
    )


def partition_detail(df: DataFrame, spec: PartitionSpec, sizes: DataFrame | None = None):
    """Number, bounds, side and rows of every partition, and its size in MB if given.

    ``sizes`` has ``partition_number`` and ``size_mb`` (see ``sources.storage``).
    """
    detail = _counted(df, spec)
    if sizes is None:
        return detail
    return detail.join(sizes, "partition_number", "left").withColumn(
        "size_mb", F.coalesce("size_mb", F.lit(0.0))
    )


# Proposals. Start and end default to the data's own range.


def _data_range(df: DataFrame, column: str):
    return df.agg(F.min(column), F.max(column)).first()


def _proposal(df: DataFrame, spec: PartitionSpec, new: set) -> DataFrame:
    fresh = [invariant_text(spec.kind, v) for v in spec.boundaries if v in new]
    counted = _counted(df, spec)
    is_new = F.col("lower_bound").isin(*fresh) if fresh else F.lit(False)
    return counted.select(
        "partition_number",
        "lower_bound",
        "upper_bound",
        F.coalesce(is_new, F.lit(False)).alias("is_new"),
        "row_count",
    )


def _check_count(count: int) -> None:
    if count >= MAX_PARTITIONS:
        raise ValueError(f"{count} boundaries make more than {MAX_PARTITIONS} partitions")


def numeric_steps(start: int, end: int, step: int, include_end: bool = True) -> range:
    """start + step, start + 2*step … up to the end."""
    if step <= 0:
        raise ValueError("step must be positive")
    if end <= start:
        raise ValueError("end must exceed start")
    steps = range(start + step, end + 1 if include_end else end, step)
    _check_count(len(steps))
    return steps


def date_steps(start: date, end: date, grain: str, bounds: str = "both") -> list[date]:
    """First-of-month dates, monthly or yearly; yearly keeps the start's month.

    ``both`` starts at the first of the start's month and takes the end in;
    ``inside`` leaves out the start's own month and the end.
    """
    if end <= start:
        raise ValueError("end must be after start")
    if grain not in ("month", "year") or bounds not in ("both", "inside"):
        raise ValueError("grain is 'month' or 'year', bounds 'both' or 'inside'")
    width = 12 if grain == "year" else 1
    month = start.year * 12 + start.month - 1 + (width if bounds == "inside" else 0)
    steps = []
    while True:
        step = type(end)(month // 12, month % 12 + 1, 1)
        if step > end or (bounds == "inside" and step == end):
            break
        steps.append(step)
        month += width
    _check_count(len(steps))
    return steps


def propose_numeric(
    df, column, step, start=None, end=None, existing=(), kind=ValueKind.BIGINT, include_end=True,
    range_right=True,
) -> DataFrame:
    """Numeric boundaries for a table and the rows each resulting partition would get."""
    if start is None or end is None:
        low, high = _data_range(df, column)
        start = low if start is None else start
        end = high if end is None else end
    old = PartitionSpec(column, kind, tuple(sorted(existing)), range_right)
    new = set(numeric_steps(int(start), int(end), step, include_end)) - set(old.boundaries)
    spec = old.with_boundaries(sorted({*old.boundaries, *new}))
    return _proposal(df, spec, new)


def propose_dates(
    df, column, grain, bounds="both", start=None, end=None, existing=(),
    kind=ValueKind.DATETIME2, range_right=True,
) -> DataFrame:
    """Monthly or yearly boundaries for a table and the rows per resulting partition."""
    kind = ValueKind(kind)
    if start is None or end is None:
        low, high = _data_range(df, column)
        start = low if start is None else start
        end = high if end is None else end
    if kind is ValueKind.DATE:
        start, end = (v.date() if isinstance(v, datetime) else v for v in (start, end))
    old = PartitionSpec.of(column, kind, existing, range_right) if existing else PartitionSpec(
        column, kind, (), range_right
    )
    new = set(date_steps(start, end, grain, bounds)) - set(old.boundaries)
    spec = old.with_boundaries(sorted({*old.boundaries, *new}))
    return _proposal(df, spec, new)


def normalise_boundaries(values: DataFrame, column: str) -> DataFrame:
    """Boundary list from a data column: distinct, rising, numbered 0001 and on.

    Values are reduced to the distinct ones first. More of them than a partition
    function may have fails the query rather than being cut.
    """
    distinct = values.select(F.col(column).alias("boundary")).dropna().distinct()
    total = distinct.agg(F.count(F.lit(1))).scalar()
    # The check is a filter of every row, so no choice of columns prunes it away; past it,
    # fewer than MAX_PARTITIONS rows reach the one-partition window.
    fits = F.when(
        total >= MAX_PARTITIONS,
        F.raise_error(F.lit("too many distinct values for a boundary list")).cast("boolean"),
    ).otherwise(F.lit(True))
    numbered = distinct.filter(fits).withColumn(
        "ordinal", F.row_number().over(Window.orderBy("boundary"))
    )
    return numbered.select(sort_key(F.col("ordinal")).alias("sort_key"), "boundary")


# Effect of changing the boundary list.


def split_impact(df: DataFrame, spec: PartitionSpec, new) -> DataFrame:
    """Rows per partition after adding boundaries, beside those before, from one pass."""
    return _change_impact(df, spec, spec.split(new))


def sync_impact(df: DataFrame, spec: PartitionSpec, wanted) -> DataFrame:
    """Effect of adding whatever boundaries of a wanted list are not there yet."""
    missing = spec.missing(wanted)
    return _change_impact(df, spec, spec.split(missing) if missing else spec)


def _change_impact(df: DataFrame, before: PartitionSpec, after: PartitionSpec) -> DataFrame:
    present, old_number, numbers = set(before.boundaries), 1, []
    for value in after.boundaries:
        numbers.append(old_number)
        old_number += value in present
    mapping = F.array(*[F.lit(n) for n in [*numbers, old_number]])
    per_old = Window.partitionBy("old_partition_number")  # at most k + 1 rows in all
    return (
        _counted(df, after)
        .withColumn("old_partition_number", F.get(mapping, F.col("partition_number") - 1))
        .select(
            "partition_number",
            "old_partition_number",
            "lower_bound",
            "upper_bound",
            (F.count(F.lit(1)).over(per_old) > 1).alias("is_split"),
            "row_count",
            F.sum("row_count").over(per_old).alias("old_row_count"),
        )
    )


def merge_impact(df: DataFrame, spec: PartitionSpec, key=None) -> DataFrame:
    """Rows on both sides of each boundary; a merge is blocked when either side is empty.

    Boundary i separates partitions i and i + 1.
    """
    by_number = Window.orderBy("partition_number")  # at most k + 1 rows
    left = None if key is None else spec.boundary_index(key) + 1
    return (
        _counted(df, spec, None if key is None else [left, left + 1])
        .withColumn("right_rows", F.lead("row_count").over(by_number))
        .filter(F.col("upper_bound").isNotNull() if key is None else F.col("partition_number") == left)
        .select(
            "sort_key",
            F.col("upper_bound").alias("boundary"),
            F.col("partition_number").alias("left_partition"),
            (F.col("partition_number") + 1).alias("right_partition"),
            F.col("row_count").alias("left_rows"),
            "right_rows",
            (F.col("row_count") + F.col("right_rows")).alias("merged_rows"),
            ((F.col("row_count") == 0) | (F.col("right_rows") == 0)).alias("blocked"),
        )
    )


def safety(df: DataFrame, spec: PartitionSpec, key=None) -> DataFrame:
    """Whether each partition still holds data and so must be staged out first."""
    has_data = F.col("row_count") > 0
    known = key is not None and str(key).isdigit() and 1 <= int(key) <= spec.partition_count
    report = _counted(df, spec, [int(key)] if known else None).select(
        F.col("sort_key").alias("boundary_key"),
        "row_count",
        has_data.alias("has_data"),
        has_data.alias("needs_staging"),
        F.when(has_data, F.lit("partition still holds data; switch it out first")).alias(
            "warning"
        ),
    )
    if key is None:
        return report
    if known:
        return report.filter(F.col("boundary_key") == key)
    return df.sparkSession.range(1).select(
        F.lit(key).alias("boundary_key"),
        F.lit(0).cast("bigint").alias("row_count"),
        F.lit(False).alias("has_data"),
        F.lit(False).alias("needs_staging"),
        F.lit("no such partition; it may have been merged").alias("warning"),
    )


def partitions_to_archive(df: DataFrame, spec: PartitionSpec, condition) -> DataFrame:
    """Partitions whose boundary meets a condition; the unbounded last one never does.

    ``condition`` gets the boundary as a typed column and returns a Column.
    """
    typed = F.col("upper_bound").try_cast(spec.kind.spark_type)
    chosen = _numbers_where(df, spec, F.col("upper_bound").isNotNull() & condition(typed))
    return _counted(df, spec, chosen).select("partition_number", "boundary_value", "row_count")


def _numbers_where(df: DataFrame, spec: PartitionSpec, chosen: Column) -> list[int]:
    """Numbers of the partitions whose bounds meet a condition, from the list alone (at most
    k + 1 rows), so that the table is read for these only."""
    listed = partition_list(df.sparkSession, spec).filter(chosen).select("partition_number")
    return [r["partition_number"] for r in listed.collect()]


def find_partition(df: DataFrame, spec: PartitionSpec, key) -> DataFrame:
    """One partition by number, or by boundary text (RIGHT: the one starting there).

    Only that partition's range is read. No match gives no rows.
    """
    text, texts = str(key).strip(), spec.texts()
    if text.lstrip("-").isdigit():
        number = int(text)
    elif text in texts:
        number = texts.index(text) + (2 if spec.range_right else 1)
    else:
        number = 0
    found = 1 <= number <= spec.partition_count
    lower, upper = spec.bounds(number) if found else (None, None)
    own = lower if spec.range_right else upper
    label = None if own is None else invariant_text(spec.kind, own)
    rows = read_partition(df, spec, number) if found else df.limit(0)
    report = rows.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(number).cast("int").alias("partition_number"),
        F.lit(label).cast("string").alias("boundary_value"),
        "row_count",
    )
    return report if found else report.filter(F.lit(False))


def expired_partitions(df: DataFrame, spec: PartitionSpec, keep: Retention, as_of=None):
    """Partitions outside the retention rule, of those holding rows.

    ``keep_latest`` ranks the non-empty partitions from the newest; ``keep_days``
    expires a partition once its upper bound is that many days before ``as_of``.
    """
    has_rows = F.col("row_count") > 0
    if keep.keep_latest is not None:
        filled = _counted(df, spec).filter(has_rows)
        newest = Window.orderBy(F.desc("partition_number"))  # at most k + 1 rows
        expired = filled.withColumn("_age", F.row_number().over(newest)).filter(
            F.col("_age") > keep.keep_latest
        )
    else:
        if not spec.kind.is_temporal or as_of is None:
            raise ValueError("keep_days needs a date boundary and as_of")
        cutoff = as_of - timedelta(days=keep.keep_days)
        edge = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
        old = _numbers_where(df, spec, F.col("upper_bound").cast("timestamp_ntz") <= edge)
        expired = _counted(df, spec, old).filter(has_rows)
    return expired.select("partition_number", "boundary_value", "row_count")


def residual(target: DataFrame, spec: PartitionSpec, number: int) -> DataFrame:
    """Rows already lying in one partition of a target, by a pruned count."""
    return read_partition(target, spec, number).agg(F.count(F.lit(1)).alias("residual_rows"))


def table_inventory(tables: dict, specs: dict | None = None) -> DataFrame:
    """Row counts of tables, largest first, with partition counts where partitioned.

    Only an unpartitioned table that holds rows is fit for predicate archiving.
    """
    specs = specs or {}
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(name in specs).alias("is_partitioned"),
            F.lit(specs[name].partition_count if name in specs else 0).alias("partition_count"),
        )
        for name, df in tables.items()
    ]
    return (
        reduce(DataFrame.unionByName, counts)
        .withColumn("archivable", ~F.col("is_partitioned") & (F.col("row_count") > 0))
        .orderBy(F.desc("row_count"), "table_name")
    )


def unpartitioned_tables(tables: dict, specs: dict | None = None) -> DataFrame:
    """The inventory without the partitioned tables."""
    plain = {name: df for name, df in tables.items() if name not in (specs or {})}
    return table_inventory(plain).select("table_name", "row_count", "archivable")
