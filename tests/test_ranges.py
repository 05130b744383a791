import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frostline.operators import ranges as rg
from frostline.spec import PartitionSpec, Retention, ValueKind

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def naive(value, boundaries, right):
    if value is None:
        return 1
    return 1 + sum(b <= value if right else b < value for b in boundaries)


@pytest.mark.parametrize("right", [True, False])
@pytest.mark.parametrize("count", [0, 1, 2, 7, 64, 65, 128, 200, 1000])
def test_numbers_match_a_plain_count(spark, count, right):
    rng = random.Random(count * 2 + right)
    bounds = sorted(rng.sample(range(-5000, 5000), count))
    values = [rng.randint(-6000, 6000) for _ in range(400)] + bounds[:200] + [None]
    df = spark.createDataFrame([(v,) for v in values], "k int")
    spec = PartitionSpec("k", ValueKind.INT, tuple(bounds), right)
    got = rg.with_partition_no(df, spec, "n").collect()
    assert all(r.n == naive(r.k, bounds, right) for r in got)
    assert len(got) == len(values)


@pytest.mark.parametrize("right", [True, False])
@pytest.mark.parametrize("count", [5, 90])
def test_other_kinds(spark, count, right):
    rng = random.Random(3)
    start = datetime(2020, 1, 1)
    times = sorted({start + timedelta(hours=rng.randint(0, 40_000)) for _ in range(count)})
    texts = sorted({f"it's \\ {rng.randint(0, 10_000):05d}" for _ in range(count)})
    rows = [(t, x) for t, x in zip(times, texts)] + [(None, None), (start, "a")]
    df = spark.createDataFrame(rows, "t timestamp_ntz, x string")
    by_time = PartitionSpec("t", ValueKind.DATETIME2, tuple(times), right)
    by_text = PartitionSpec("x", ValueKind.STRING, tuple(texts), right)
    both = rg.with_partition_no(rg.with_partition_no(df, by_time, "a"), by_text, "b").collect()
    for r in both:
        assert r.a == naive(r.t, times, right)
        assert r.b == naive(r.x, texts, right)


def test_known_rows(spark):
    rows = [(1, datetime(2024, 12, 31)), (2, datetime(2025, 2, 1)), (3, datetime(2025, 8, 15))]
    df = spark.createDataFrame(rows, "id int, d timestamp_ntz")
    spec = PartitionSpec("d", ValueKind.DATETIME, ("2025-01-01", "2025-07-01"))
    got = {r.id: r.n for r in rg.with_partition_no(df, spec, "n").collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_partitions_cover_the_table_once(spark):
    df = spark.createDataFrame([(v,) for v in [None, *range(50)]], "k int")
    for right in (True, False):
        spec = PartitionSpec("k", ValueKind.INT, (10, 20, 30), right)
        parts = [rg.read_partition(df, spec, n).collect() for n in range(1, 5)]
        assert sum(len(p) for p in parts) == 51
        for n, part in enumerate(parts, 1):
            assert all(naive(r.k, spec.boundaries, right) == n for r in part)


def test_assignment_does_not_shuffle(spark, plan):
    orders = spark.read.parquet(ORDERS)
    years = tuple(f"{y}-01-01" for y in range(1996, 2002))
    spec = PartitionSpec("o_orderdate", ValueKind.DATETIME2, years)
    text = plan(rg.with_partition_no(orders, spec))
    assert "Exchange" not in text and "BatchEvalPython" not in text
    many = PartitionSpec("o_orderkey", ValueKind.BIGINT, tuple(range(0, 9000, 3)))
    text = plan(rg.with_partition_no(orders, many))
    assert "Exchange" not in text and "Join" not in text


def test_partition_read_is_pushed_down(spark, plan):
    orders = spark.read.parquet(ORDERS)
    spec = PartitionSpec("o_orderdate", ValueKind.DATETIME2, ("1997-01-01", "1998-01-01"))
    text = plan(rg.read_partition(orders, spec, 2).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "o_totalprice" not in text


def test_counts_shuffle_one_row_per_partition(spark, plan):
    orders = spark.read.parquet(ORDERS)
    spec = PartitionSpec("o_orderdate", ValueKind.DATETIME2, ("1997-01-01",))
    text = plan(rg.partition_rows(orders, spec))
    assert text.count("Exchange") and "partial_count" in text
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in text


def test_merge_guard(spark):
    df = spark.createDataFrame([(datetime(2024, 5, 1),)] * 5, "d timestamp_ntz")
    spec = PartitionSpec("d", ValueKind.DATE, ("2024-01-01",))
    row = rg.merge_impact(df, spec, "0001").first()
    assert (row.left_rows, row.right_rows, row.merged_rows, row.blocked) == (0, 5, 5, True)


def test_reports_on_some_partitions_read_those_only(spark, plan):
    """A merge at one boundary reads both sides, retention what can expire."""
    orders = spark.read.parquet(ORDERS)
    years = tuple(f"{y}-01-01" for y in range(1996, 2002))
    spec = PartitionSpec("o_orderdate", ValueKind.DATETIME2, years)
    cut = lambda b: b < F.lit("1998-06-01").cast("timestamp_ntz")
    keep = Retention(keep_days=1)
    reports = [
        ("1998-01-01", rg.merge_impact(orders, spec, "0002")),  # partitions 2 and 3
        ("1997-01-01", rg.safety(orders, spec, "0002")),
        ("1998-01-01", rg.partitions_to_archive(orders, spec, cut)),
        ("2000-01-01", rg.expired_partitions(orders, spec, keep, datetime(2000, 1, 2))),
    ]
    for upper, report in reports:
        pushed = [x for x in plan(report).splitlines() if "PushedFilters" in x]
        assert pushed and all(f"LessThan(o_orderdate,{upper}" in x for x in pushed), pushed


def test_no_partition_chosen_gives_no_rows(spark):
    df = spark.createDataFrame([(datetime(2024, 5, 1),), (None,)], "d timestamp_ntz")
    spec = PartitionSpec("d", ValueKind.DATE, ("2024-01-01",))
    never = rg.partitions_to_archive(df, spec, lambda b: F.lit(False))
    assert never.collect() == []
    first = rg.partitions_to_archive(df, spec, lambda b: F.lit(True)).collect()
    assert [(r.partition_number, r.row_count) for r in first] == [(1, 1)]  # NULLs lie in 1


def test_numeric_steps():
    assert list(rg.numeric_steps(0, 30, 10)) == [10, 20, 30]
    assert list(rg.numeric_steps(0, 30, 10, include_end=False)) == [10, 20]
    for bad in ((0, 0, 1), (0, 5, 0)):
        with pytest.raises(ValueError):
            rg.numeric_steps(*bad)


def test_date_steps():
    a, b = datetime(2024, 3, 15), datetime(2024, 6, 1)
    months = lambda bounds: [d.month for d in rg.date_steps(a, b, "month", bounds)]
    assert months("both") == [3, 4, 5, 6]
    assert months("inside") == [4, 5]
    years = rg.date_steps(a, datetime(2027, 1, 1), "year", "both")
    assert [(d.year, d.month, d.day) for d in years] == [(2024, 3, 1), (2025, 3, 1), (2026, 3, 1)]


def test_too_many_boundaries_fail_instead_of_being_cut(spark):
    with pytest.raises(ValueError):
        rg.numeric_steps(0, 1_000_000, 1)
    values = spark.range(16_000).select(F.col("id").alias("v"))
    with pytest.raises(Exception, match="too many distinct values"):
        rg.normalise_boundaries(values, "v").collect()
    with pytest.raises(Exception, match="too many distinct values"):
        rg.normalise_boundaries(values, "v").select("boundary").count()


def test_sync_with_nothing_missing(spark):
    df = spark.createDataFrame([(5,), (15,)], "k int")
    spec = PartitionSpec("k", ValueKind.INT, (10,))
    rows = rg.sync_impact(df, spec, [10]).collect()
    assert [(r.partition_number, r.is_split, r.row_count) for r in rows] == [
        (1, False, 1), (2, False, 1),
    ]


def test_unknown_partition_has_no_rows(spark):
    df = spark.createDataFrame([(5,)], "k int")
    spec = PartitionSpec("k", ValueKind.INT, (10,))
    assert rg.find_partition(df, spec, "9").count() == 0
    assert rg.find_partition(df, spec, "1").first().row_count == 1


def test_safety_of_an_unknown_key(spark):
    df = spark.createDataFrame([(5,)], "k int")
    spec = PartitionSpec("k", ValueKind.INT, (10,))
    row = rg.safety(df, spec, "0009").first()
    assert (row.row_count, row.has_data) == (0, False) and "no such partition" in row.warning
    assert rg.safety(df, spec, "0001").first().needs_staging
