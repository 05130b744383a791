"""Order-dependent work that never sorts a whole group or table in one task.

A running state over a long group is cut into segments of its order that hold equal numbers of
rows: each segment is worked out on its own, and the segments' summaries (one row each) carry the
state across, as a row that leads each segment in.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.functions.names import free_names
from frostline.operators.ranges import with_partition_no
from frostline.session import write_scratch
from frostline.spec import PartitionSpec, ValueKind, boundary_lit

# monotonically_increasing_id keeps the row's place in its partition in these bits.
PLACE_BITS = 33
# Most segments an order is cut into; their bounds are a constant of the plan.
MOST_SEGMENTS = 10_000


def _kind(dtype) -> ValueKind | None:
    """How a column's values are written as bounds; None if it can't be cut by quantiles."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return ValueKind.DATETIME2
    if isinstance(dtype, T.DateType):
        return ValueKind.DATE
    return ValueKind.BIGINT if isinstance(dtype, T.IntegralType) else None


def _quantiles(df: DataFrame, column: str, slices: int) -> tuple[list, bool]:
    """Bounds, with repeats, between slices of about equal rows, and whether the nulls alone would
    fill one. Reads one column."""
    kind = _kind(df.schema[column].dataType)
    shares = [i / slices for i in range(1, slices)]
    typed = F.col(column).cast(kind.spark_type)
    bounds, nulls, rows = df.agg(
        F.percentile_approx(typed, shares, 20 * slices), F.count_if(typed.isNull()), F.count("*")
    ).first()
    return bounds or [], nulls * slices > rows


def with_segments(df: DataFrame, order, name: str, slices: int | None = None) -> DataFrame:
    """Number the segments of an order: ranges of its columns with about equal rows, whichever
    groups these belong to, so that a group's part of a segment is never more than that.

    The bounds are counted quantiles of the first column, one value per slice (as many as
    shuffle partitions). A value that fills whole slices by itself, or many nulls, are cut further
    by the second column. Nulls come first. The rows themselves are not shuffled.
    """
    order = list(order)
    kind = _kind(df.schema[order[0]].dataType)
    if kind is None:
        raise ValueError(f"give a segment for a column of type {df.schema[order[0]].dataType}")
    if slices is None:
        slices = min(MOST_SEGMENTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found, many_nulls = _quantiles(df, order[0], max(2, slices))
    found = Counter(found)
    bounds = sorted(found)
    out = with_partition_no(df, PartitionSpec(order[0], kind, tuple(bounds)), name)
    # a value that starts segment i + 2 and fills it, but for the greater ones behind it
    full = [(i + 2, b) for i, b in enumerate(bounds) if found[b] > 1]
    second = _kind(df.schema[order[1]].dataType) if len(order) > 1 else None
    if second is None or not (full or many_nulls):
        return out
    alike = F.coalesce(F.col(order[0]).isin(*[boundary_lit(kind, b) for _, b in full]), F.lit(False))
    if many_nulls:
        alike |= F.col(order[0]).isNull()
    inner = sorted(set(_quantiles(df.filter(alike), order[1], max(2, slices))[0]))
    (at,) = free_names([*df.columns, name], "_inner")
    out = with_partition_no(out, PartitionSpec(order[1], second, tuple(inner)), at)
    behind = F.col(name).isin(*[i for i, _ in full], *[1] * many_nulls)
    place = F.when(alike, F.col(at)).when(behind, len(inner) + 2).otherwise(0)
    number = F.col(name).cast("bigint") * (len(inner) + 3) + place
    return out.withColumn(name, number).drop(at)


def adjacent_violations(df: DataFrame, value: str, by, order, segment=None) -> DataFrame:
    """Rows whose value does not exceed the one just before it in the group.

    ``order`` names columns that fix the order within a group; a ``segment`` that rises with
    them replaces the counted ones.
    """
    by, order = list(by), list(order)
    seg, real = free_names(df.columns, "_seg", "_real")
    parts = [*by, seg]
    cut = with_segments(df, order, seg) if segment is None else df.withColumn(seg, segment)
    rows = cut.withColumn(real, F.lit(1))
    # The last value of a segment joins the next one as an extra leading row, so the
    # table itself is shuffled once and NULL groups are treated like any other.
    last = rows.groupBy(*parts).agg(F.max_by(value, F.struct(*order)).alias(value))
    across = Window.partitionBy(*by).orderBy(seg)
    lead_in = last.select(*parts, F.lag(value).over(across).alias(value), F.lit(0).alias(real))
    inside = Window.partitionBy(*parts).orderBy(real, *order)
    return (
        rows.unionByName(lead_in, allowMissingColumns=True)
        .withColumn("previous", F.lag(value).over(inside))
        .filter((F.col(real) == 1) & (F.col("previous") >= F.col(value)))
        .select(*df.columns, "previous")
    )


def _narrow_to_head(df: DataFrame, column: str, limit: int, floor: int = 1_000_000):
    """Cut to rows that can still be among the first ``limit``, by the first column.

    Each step keeps everything up to an estimated quantile and is checked by a count,
    so no row of the head is ever lost; the bound reaches the scan as a filter.
    """
    dtype = df.schema[column].dataType
    if not isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df
    head, rows = df, df.count()
    while rows > max(4 * limit, floor):
        share = min(1.0, 1.2 * limit / rows + 0.002)
        cut = head.agg(F.percentile_approx(column, share, 10_000)).first()[0]
        if cut is None:
            break
        edge = F.lit(str(cut)).cast(dtype)
        closer = df.filter(F.col(column).isNull() | (F.col(column) <= edge))
        kept = closer.count()
        if kept < limit or kept >= rows:
            break
        head, rows = closer, kept
    return head


def global_rank(df: DataFrame, order, limit=None, unique=True, slices=None, name="row_rank"):
    """Rank 1, 2, 3 … over the whole table in key order, by one range shuffle.

    Rows are spread by ranges of the key, sorted there and written once with their
    place; the row count per range (one row each) then gives every range its offset.
    ``order`` holds names, or columns such as ``F.desc("ts")``. With a limit, and a name in
    front, only rows that can be among the first ones are ranked.

    With ``unique=False`` rows may tie: a random tie-break, written before the shuffle,
    spreads even a third of the table under one key over many ranges.
    """
    order = list(order)
    spark = df.sparkSession
    tie, at, in_slice, held, before = free_names(
        [*df.columns, name], "_tie", "_at", "_slice", "_rows", "_before"
    )
    narrow = limit is not None and isinstance(order[0], str)
    rows = _narrow_to_head(df, order[0], limit) if narrow else df
    sort = list(order)
    if not unique:
        rows = write_scratch(rows.withColumn(tie, F.rand(7)), "ties")
        sort.append(tie)
    if slices is None:
        cores = spark.sparkContext.defaultParallelism
        slices = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = write_scratch(
        rows.repartitionByRange(slices, *sort)
        .sortWithinPartitions(*sort)
        .withColumn(at, F.monotonically_increasing_id()),
        "ranked",
    )
    slice_no = F.shiftright(at, PLACE_BITS)
    running = Window.orderBy(in_slice).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row per range
        placed.groupBy(slice_no.alias(in_slice))
        .agg(F.count(F.lit(1)).alias(held))
        .select(in_slice, F.coalesce(F.sum(held).over(running), F.lit(0)).alias(before))
    )
    place = F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    ranked = (
        placed.withColumn(in_slice, slice_no)
        .join(F.broadcast(offsets), in_slice)
        .withColumn(name, F.col(before) + place + 1)
    )
    if limit is not None:
        ranked = ranked.filter(F.col(name) <= limit)
    return ranked.select(*df.columns, name)


# The histogram of a round has so many steps; refining ends once so few rows are left, which are
# merged in one task.
STEPS = 200
FEW = 100_000


def smallest(df: DataFrame, order, limit: int) -> tuple[DataFrame, int]:
    """The first ``limit`` rows by the columns in ``order``, nulls first, and the row count.

    The columns must order the rows totally. Only the limit's own key is looked for: each round
    reads the first column alone, counts the rows below and between two quantiles of the round
    before, and closes in on the step that holds the key, until few rows are left between. Only
    these are ordered by all columns. The result is a filter on ``df``, whose bound on the first
    column reaches the scan, so no row is sorted or written.
    """
    order = list(order)
    first, dtype = order[0], df.schema[order[0]].dataType
    value = F.col(first)
    histogram = isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    below, inside, between, nulls, n = 0, F.lit(True), None, 0, None
    rows, less, held = df.select(first), F.lit(False), None
    while True:
        window = inside if between is None else between
        facts = [F.count_if(less), F.count_if(window), F.count_if(value.isNull())]
        if histogram:
            ladder = [i / STEPS for i in range(STEPS + 1)]
            facts.append(F.percentile_approx(F.when(window, value), ladder, 20 * STEPS))
        found = rows.agg(*facts).first()
        if n is None:
            n, nulls = found[1], found[2]
            if n <= limit:
                return df, n
            held = n
        elif found[0] < limit <= found[0] + found[1] and found[1] <= held // 2:
            below, inside, held = found[0], between, found[1]
        else:
            break  # an estimate was off, or many rows share the key: the last window is right
        if not histogram or limit <= nulls or held <= FEW:
            break
        known = held - (nulls if between is None else 0)
        at = (limit - below - (nulls if between is None else 0)) * STEPS // known
        low, high = (F.lit(found[3][max(0, min(STEPS, i))]).cast(dtype) for i in (at - 1, at + 2))
        less, between = value.isNull() | (value < low), value.between(low, high)
        rows = df.select(first).filter(value.isNull() | (value <= high))
    if limit <= nulls:
        inside, held = value.isNull(), nulls
    rank = limit - below
    last = df.select(*order).filter(inside)
    if held <= FEW:
        cut = last.orderBy(*[F.asc_nulls_first(c) for c in order]).offset(rank - 1).limit(1).first()
    else:
        (name,) = free_names(order, "rank")
        cut = global_rank(last, order, limit=rank, name=name).filter(F.col(name) == rank).first()
    edge = F.struct(*[F.lit(cut[c]).cast(df.schema[c].dataType).alias(c) for c in order])
    upto = F.struct(*order) <= edge
    if cut[first] is not None:
        upto = (value.isNull() | (value <= F.lit(cut[first]).cast(dtype))) & upto
    return df.filter(upto), n


def assign_batches(df, order, batch_size, max_rows=None, unique=True, slices=None) -> DataFrame:
    """Batch numbers of ``batch_size`` rows in key order, up to ``max_rows`` rows."""
    if batch_size <= 0 or (max_rows is not None and max_rows < batch_size):
        raise ValueError("batch_size must be positive and not above max_rows")
    ranked = global_rank(df, order, max_rows, unique, slices)
    batch = F.floor((F.col("row_rank") - 1) / F.lit(batch_size)) + 1
    return ranked.withColumn("batch_no", batch.cast("bigint"))
