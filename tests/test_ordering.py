import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frostline.operators import ordering
from frostline.operators.runlog import failure_streak


def test_rank_is_dense_and_ordered(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10_000), 3000)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k int, v int").repartition(5)
    got = {r.k: r.row_rank for r in ordering.global_rank(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_rank_with_one_dominant_key(spark):
    values = ["hot"] * 4000 + ["a"] * 500 + [None] * 10 + ["z"] * 300
    df = spark.createDataFrame([(v,) for v in values], "k string").repartition(6)
    ranked = ordering.global_rank(df, ["k"], unique=False).collect()
    assert sorted(r.row_rank for r in ranked) == list(range(1, len(values) + 1))
    in_order = [r.k for r in sorted(ranked, key=lambda r: r.row_rank)]
    assert in_order == [None] * 10 + ["a"] * 500 + ["hot"] * 4000 + ["z"] * 300


def test_head_is_exact_when_narrowed(spark):
    df = spark.range(200_000).select((F.col("id") * 7 % 200_003).alias("k"), "id")
    head = ordering._narrow_to_head(df, "k", 500, floor=1000)
    assert 500 <= head.count() < 20_000
    want = sorted(r.k for r in df.collect())[:500]
    assert sorted(r.k for r in head.collect())[:500] == want


def test_head_with_ties_and_nulls_keeps_everything(spark):
    df = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id")).alias("k")
    )
    head = ordering._narrow_to_head(df, "k", 20_000, floor=1000)
    assert head.filter("k IS NULL").count() == df.filter("k IS NULL").count()


def test_batches(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    got = {r.k: r.batch_no for r in ordering.assign_batches(df, ["k"], 10, 20).collect()}
    assert got == {k: k // 10 + 1 for k in range(20)}
    with pytest.raises(ValueError):
        ordering.assign_batches(df, ["k"], 10, 5)


def history(seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for job in ("busy", "calm", None):
        for i in range(400 if job == "busy" else 60):
            at = start + timedelta(minutes=rng.randint(0, 60 * 24 * 6))
            rows.append((job, at, len(rows), rng.choice("FFFFSKR"), rng.randint(0, 50)))
    return rows


def grouped(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("seed", [1, 2])
def test_adjacent_violations_across_segments(spark, seed):
    rows = history(seed)
    df = spark.createDataFrame(rows, "job string, ts timestamp_ntz, id int, st string, v int")
    want = [
        (b[2], a[4]) for g in grouped(rows).values() for a, b in zip(g, g[1:]) if a[4] >= b[4]
    ]
    got = ordering.adjacent_violations(df, "v", ["job"], ["ts", "id"])
    assert sorted((r.id, r.previous) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_streak_across_segments(spark, seed):
    rows = history(seed)
    df = spark.createDataFrame(rows, "job string, ts timestamp_ntz, id int, st string, v int")
    want = {}
    for g in grouped(rows).values():
        streak = 0
        for r in g:
            streak = streak + 1 if r[3] == "F" else 0 if r[3] in "SK" else streak
            want[r[2]] = (streak, r[3] == "F" and streak >= 4)
    got = failure_streak(
        df, 4, job="job", ts="ts", tie="id", status="st", failed="F", resets=("S", "K")
    )
    assert {r.id: (r.streak, r.disabled) for r in got.collect()} == want


@pytest.mark.parametrize("hot", ["day", "moment", "nulls"])
def test_one_hot_day_or_moment_spreads_over_many_segments(spark, hot):
    """90 % of a log in one job and day, or at the very same time: segments stay even, and a
    streak over them all is counted on."""
    day = datetime(2024, 3, 1)
    step = timedelta(seconds=0 if hot == "moment" else 1)
    rows = [("a", day + step * i, i, "F", i) for i in range(9_000)]
    rows += [("b", day + timedelta(hours=i - 500), 10_000 + i, "F", i) for i in range(1_000)]
    if hot == "nulls":
        rows += [(None, None, 20_000 + i, "F", i) for i in range(5_000)]
    df = spark.createDataFrame(rows, "job string, ts timestamp_ntz, id int, st string, v int")
    cut = ordering.with_segments(df, ["ts", "id"], "seg", 20)
    sizes = [r["count"] for r in cut.groupBy("seg").count().collect()]
    assert max(sizes) <= 1.3 * len(rows) / 20 and len(sizes) >= 18
    edges = cut.filter("ts IS NOT NULL").groupBy("seg").agg(F.min(F.struct("ts", "id")), F.max(F.struct("ts", "id")))
    edges = [tuple(r)[1:] for r in edges.orderBy("seg").collect()]
    assert all(b < c for (_, b), (c, _) in zip(edges, edges[1:]))
    got = failure_streak(
        df, 4, job="job", ts="ts", tie="id", status="st", failed="F", resets=("S",)
    )
    top = {r.job: r.top for r in got.groupBy("job").agg(F.max("streak").alias("top")).collect()}
    assert top == {"a": 9_000, "b": 1_000, **({None: 5_000} if hot == "nulls" else {})}


def test_segments_of_other_orders(spark):
    empty = spark.createDataFrame([], "d date, n long, x double")
    assert ordering.with_segments(empty, ["d"], "seg").collect() == []
    numbers = spark.range(1000).select("id", F.expr("date '2024-01-01'").alias("d"))
    for order in (["id"], ["d", "id"]):
        cut = ordering.with_segments(numbers, order, "seg", 10).groupBy("seg").count().collect()
        assert len(cut) >= 10 and max(r["count"] for r in cut) <= 120
    with pytest.raises(ValueError):
        ordering.with_segments(empty, ["x"], "seg")
