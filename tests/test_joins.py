import random

import pytest
from pyspark.sql import functions as F

from frostline.operators import joins


def tables(spark):
    rng = random.Random(5)
    left = [(7 if i % 3 == 0 else rng.randint(0, 60), i % 4, i) for i in range(6000)]
    left += [(None, 1, -i) for i in range(1, 400)] + [(3, None, -9999)]
    right = [(rng.choice([7, 8, 9, *range(20, 50)]), rng.randint(0, 2)) for _ in range(3000)]
    right += [(None, 1)] * 50
    a = spark.createDataFrame(left, "a int, b int, id int").repartition(8, "id")
    return a, spark.createDataFrame(right, "a int, b int"), left, set(right)


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_lookup_equals_brute_force(spark, how):
    a, b, left, keys = tables(spark)
    match = lambda r: None not in r[:2] and r[:2] in keys
    want = sorted(r[2] for r in left if match(r) == (how == "left_semi"))
    got = joins.key_lookup(a, b, ["a", "b"], how)
    assert sorted(r.id for r in got.collect()) == want
    assert got.columns == a.columns


def test_lookup_is_one_join_of_two_plain_exchanges(spark, plan):
    """So AQE can split a hot key; the left side is read and exchanged once."""
    a, b, _, _ = tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(joins.key_lookup(a, b, ["a", "b"], "left_anti"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = text.split("(1)")[0]
    assert tree.count("SortMergeJoin") == 1 and "Broadcast" not in tree
    assert text.count("ENSURE_REQUIREMENTS") == 2


def test_small_batch_path_equals_the_large_one(spark):
    a, b, left, keys = tables(spark)
    small = joins.new_rows_of_batch(a, b, ["a", "b"])
    large = joins.new_rows(a, b, ["a", "b"])
    assert sorted(r.id for r in small.collect()) == sorted(r.id for r in large.collect())


def test_existing_rows_counts_repeats(spark):
    target = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    source = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert joins.existing_rows(target, source, ["k"]).first()[0] == 2
    empty = source.filter(F.lit(False))
    assert joins.existing_rows(target, empty, ["k"]).first()[0] == 0


def test_enrich_fills_missing(spark):
    facts = spark.createDataFrame([(1, "x"), (2, "x"), (None, "x")], "k int, v string")
    names = spark.createDataFrame([(1, "one")], "id int, label string")
    got = joins.enrich(facts, [(names, "k", "id", {"label": ("label", "unknown")})])
    assert sorted(r.label for r in got.collect()) == ["one", "unknown", "unknown"]
