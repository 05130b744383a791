import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.operators import checks
from frostline.spec import PartitionSpec, ValueKind


@pytest.mark.parametrize(
    "counts, outcome",
    [
        ((10, 0, 10), ("full", True)),
        ((10, 0, 9), ("full", False)),
        ((10, 4, 6), ("incremental", True)),
        ((10, 4, 5), ("incremental", False)),
        ((10, 10, 0), ("nothing_new", True)),
        ((10, 12, 1), ("nothing_new", False)),
    ],
)
def test_reconcile(counts, outcome):
    assert checks.reconcile(*counts) == outcome


def test_pairs_of_changed_rows_do_not_cancel(spark):
    spec = PartitionSpec("k", ValueKind.INT, (10,))
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (1, "y")], "k int, v string")
    assert not checks.reconcile_by(a, b, spec).first().matches
    assert checks.reconcile_by(a, a, spec).first().matches


def test_reconcile_lists_partitions_of_both_sides(spark):
    spec = PartitionSpec("k", ValueKind.INT, (10,))
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([(11,)], "k int")
    got = {r.partition_number: (r.source_rows, r.target_rows, r.matches)
           for r in checks.reconcile_by(a, b, spec).collect()}
    assert got == {1: (1, 0, False), 2: (0, 1, False)}


def test_fit_audit_kinds(spark):
    df = spark.createDataFrame(
        [("12", "123.456", 300, 2.5), ("x", "1.2", 5, 3.0), (None, None, None, None)],
        "i string, d string, b int, f double",
    )
    target = T.StructType(
        [
            T.StructField("i", T.IntegerType()),
            T.StructField("d", T.DecimalType(4, 1)),
            T.StructField("b", T.ByteType()),
            T.StructField("f", T.IntegerType()),
        ]
    )
    got = {(r.column_name, r.issue): r.bad_rows for r in checks.fit_audit(df, target).collect()}
    assert got == {
        ("i", "type"): 1,
        ("d", "precision"): 0,
        ("d", "scale"): 1,
        ("d", "type"): 0,
        ("b", "range"): 1,
        ("f", "range"): 0,
        ("f", "scale"): 1,
    }


def test_fit_audit_with_nothing_to_check(spark):
    df = spark.createDataFrame([("a",)], "s string")
    assert checks.fit_audit(df, df.schema).count() == 0


def test_schema_issues():
    def of(*fields):
        return T.StructType([T.StructField(n, t, null) for n, t, null in fields])

    base = of(("a", T.IntegerType(), True), ("b", T.StringType(), True))
    assert checks.schema_issues(base, base) == []
    cases = {
        "ColumnCountMismatch": of(("a", T.IntegerType(), True)),
        "ColumnNameMismatch": of(("b", T.StringType(), True), ("a", T.IntegerType(), True)),
        "ColumnTypeMismatch": of(("a", T.LongType(), True), ("b", T.StringType(), True)),
        "ColumnNullabilityMismatch": of(("a", T.IntegerType(), False), ("b", T.StringType(), True)),
    }
    for code, other in cases.items():
        assert checks.schema_issues(base, other)[0][0] == code


def test_guard_modes(spark):
    source = spark.createDataFrame([(1,), (2,)], "k int")
    target = spark.createDataFrame([(2,)], "k int")
    assert [r.k for r in checks.guard_duplicates(source, target, ["k"], "skip").collect()] == [1]
    with pytest.raises(checks.DuplicateRows):
        checks.guard_duplicates(source, target, ["k"], "fail")
    clean = checks.guard_duplicates(source, target.filter(F.lit(False)), ["k"], "fail")
    assert clean.count() == 2


def test_clean_move_may_proceed(spark):
    spec = PartitionSpec("k", ValueKind.INT, (10,))
    source = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    target = spark.createDataFrame([(20, 5)], "k int, v int")
    assert checks.inspect_move(source, target, spec, 1, ["k"]).count() == 0
    other = spark.createDataFrame([], "k int, v string")
    found = checks.inspect_move(source, other, spec, 1, ["k"]).collect()
    assert [(r.code, r.may_proceed) for r in found] == [("ColumnTypeMismatch", False)]
