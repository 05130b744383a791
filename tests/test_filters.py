from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from frostline.operators import filters as fl
from frostline.operators.filters import Condition

NOW = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, datetime(2024, 1, 1), date(2024, 1, 1), "50%_off", 5.0, True),
        (2, datetime(2024, 1, 21), date(2024, 1, 21), "50xyoff", 15.0, False),
        (3, None, None, None, None, None),
    ]
    return spark.createDataFrame(
        data, "id int, t timestamp_ntz, d date, s string, x double, flag boolean"
    )


def ids(df, *conditions):
    where = fl.compile_filter(conditions, df.schema, NOW)
    return sorted(r.id for r in df.filter(where).collect())


def test_relative_days_takes_the_edge(rows):
    assert ids(rows, Condition("t", "RelativeDays", "10")) == [1, 2]
    assert ids(rows, Condition("t", "RelativeDays", "RELATIVE:11")) == [1]
    assert ids(rows, Condition("d", "RelativeDays", "10")) == [1, 2]


@pytest.mark.parametrize(
    "operator, value, end, want",
    [
        ("LessThan", "2024-01-21", None, [1]),
        ("LessThan", "2024-01-21 12:00:00", None, [1, 2]),
        ("GreaterThan", "2024-01-01", None, [2]),
        ("GreaterThan", "2024-01-01 12:00:00", None, [2]),
        ("DateRange", "2024-01-01 12:00:00", "2024-01-21 00:00:00", [2]),
        ("DateRange", "2024-01-01", "2024-01-20 23:59:59", [1]),
    ],
)
def test_dates_compare_like_times(rows, operator, value, end, want):
    for column in ("d", "t"):  # the times are all midnight
        assert ids(rows, Condition(column, operator, value, end)) == want


def test_date_filter_reaches_the_scan(spark, plan, tmp_path):
    path = str(tmp_path / "d")
    spark.sql("SELECT DATE'2024-01-01' AS d").write.parquet(path)
    df = spark.read.parquet(path)
    where = fl.compile_filter([Condition("d", "RelativeDays", "3")], df.schema, NOW)
    assert "LessThanOrEqual(d,2024-01-28)" in plan(df.filter(where))


def test_text_matches_literally(rows):
    assert ids(rows, Condition("s", "Contains", "%_")) == [1]
    assert ids(rows, Condition("s", "StartsWith", "50_")) == []
    assert ids(rows, Condition("s", "EndsWith", "off")) == [1, 2]


def test_other_types_know_equality_only(rows):
    assert ids(rows, Condition("flag", "Equals", "true")) == [1]
    assert fl.compile_condition(Condition("flag", "Contains", "t"), rows.schema) is None


def test_null_matches_nothing(rows):
    assert ids(rows, Condition("x", "NotEquals", "5")) == [2]


def test_incomplete_conditions_are_dropped(rows):
    schema = rows.schema
    for bad in (
        Condition("", "Equals", "1"),
        Condition("x", "", "1"),
        Condition("x", "Equals", None),
        Condition("x", "Between", "1", None),
        Condition("x", "Equals", "abc"),
        Condition("t", "DateRange", "2024-01-01", " "),
        Condition("t", "RelativeDays", "soon"),
        Condition("x", "Contains", "1"),
    ):
        assert fl.compile_condition(bad, schema, NOW) is None
    assert fl.compile_filter([], schema) is None


def test_json_round_trip():
    conditions = [Condition("a", "Between", "1", "2"), Condition("t", "RelativeDays", "RELATIVE:3")]
    assert fl.conditions_from_json(fl.filter_to_json(conditions)) == conditions
    with pytest.raises(ValueError):
        fl.conditions_from_json('{"Version": "2.0", "Filters": []}')


@pytest.mark.parametrize("text", ["< 1; DROP", "< 1 -- x", "< 1 /* x", "< 1 */", " "])
def test_raw_filter_rejects(text):
    with pytest.raises(ValueError):
        fl.raw_filter("x", text)


def test_raw_filter_forms(rows):
    def found(column, text):
        return sorted(r.id for r in rows.filter(fl.raw_filter(column, text, NOW)).collect())

    assert found("x", "< 10") == [1]
    assert found("x", "[x] < 10") == [1]
    assert found("x", "X < 10 OR x > 12") == [1, 2]
    assert found("t", "<= DATEADD(DAY, -10, GETDATE())") == [1, 2]
    assert found("s", "= '50%_off'") == [1]
    assert found("s", "<> '[x]'") == [1, 2]  # brackets inside text stay


def test_filters_reach_the_scan(spark, plan):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    where = fl.compile_filter(
        [Condition("o_orderdate", "RelativeDays", "10"), Condition("o_custkey", "Equals", "5")],
        orders.schema,
        datetime(2001, 8, 2),
    )
    text = plan(orders.filter(where))
    assert "LessThanOrEqual(o_orderdate,2001-07-23" in text
    assert "EqualTo(o_custkey,5)" in text


def test_recode(spark):
    df = spark.createDataFrame([(3,), (1,), (None,), (9,)], "m int")
    assert [r.m for r in fl.recode(df, "m", {3: 0}).collect()] == [0, 1, None, 9]
    fixed = fl.recode(df, "m", {}, default=7, valid=(1, 3))
    assert [r.m for r in fixed.collect()] == [3, 1, 7, 7]


def test_estimate_pushes_the_filter_down(spark, plan):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    found = fl.estimate(orders, F.col("o_orderkey") < 100)
    assert "LessThan(o_orderkey,100)" in plan(found)
    assert tuple(found.first()) == (orders.filter("o_orderkey < 100").count(), orders.count())
