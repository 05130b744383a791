from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.sources import files, jdbc

SCHEMA = "i int, s string, d decimal(8,2), t timestamp_ntz, b binary, f boolean, day date"
ROWS = [
    (1, "plain", Decimal("1.50"), datetime(2024, 1, 2, 3, 4, 5, 678901), b"\x00\xff", True,
     date(2024, 1, 1)),
    (2, 'quote " tab \t line\nbreak \\ ਁĀ 漢', Decimal("-2.00"), None, b"", False, None),
    (3, "", None, datetime(1999, 1, 1), None, None, date(1999, 12, 31)),
    (4, None, None, None, None, None, None),
]


@pytest.mark.parametrize("fmt", files.FORMATS)
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "out")
    files.export(df, path, fmt)
    back = files.load(spark, path, df.schema, fmt)
    got = sorted((tuple(r) for r in back.collect()), key=lambda r: r[0])
    want = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in ROWS]
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got]
    assert got == want


def test_bad_rows(spark, tmp_path):
    text = "1\ta\n" + "x\tb\n" * 3 + "2\tc\n"
    (tmp_path / "in.csv").write_text(text)
    schema = spark.createDataFrame([], "i int, s string").schema
    good = files.load(spark, str(tmp_path / "in.csv"), schema, "char", max_errors=3)
    assert sorted(r.i for r in good.collect()) == [1, 2]
    with pytest.raises(files.TooManyBadRows):
        files.load(spark, str(tmp_path / "in.csv"), schema, "char", max_errors=2)


def test_scan_leaves_out_columns(spark):
    df = spark.createDataFrame([(1, b"x", "y")], "a int, v binary, c string")
    assert files.scan(df, exclude=("A",)).columns == ["v", "c"]
    assert files.scan(df, exclude_types=("binary",)).columns == ["a", "c"]
    with pytest.raises(ValueError):
        files.scan(df, exclude=("nope",))


def test_jdbc_options():
    options = jdbc.read_options("jdbc:x", "SELECT 1", "id", 0, 100, 8, fetchsize="1000")
    assert options["dbtable"] == "(SELECT 1) src"
    assert (options["partitionColumn"], options["numPartitions"]) == ("id", "8")
    assert options["fetchsize"] == "1000"
    assert "partitionColumn" not in jdbc.read_options("jdbc:x", "SELECT 1")
    with pytest.raises(ValueError):
        jdbc.read_options("jdbc:x", "SELECT 1", "id")
    assert jdbc.write_options("jdbc:x", "t")["batchsize"] == "10000"
    with pytest.raises(ValueError):
        jdbc.write_options("jdbc:x", "t", 0)


def test_bad_rows_count_whatever_is_read(spark, tmp_path):
    """A bad value in a column nobody reads later still fails the load."""
    (tmp_path / "in.csv").write_text("1\tone\n2\ttwo\n3\t4\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    with pytest.raises(files.TooManyBadRows):
        files.load(spark, str(tmp_path / "in.csv"), schema, "char")
    good = files.load(spark, str(tmp_path / "in.csv"), schema, "char", max_errors=None)
    assert good.select("a").count() == 1
    assert files.rejected(spark, str(tmp_path / "in.csv"), schema, "char").count() == 2


def test_one_file_of_lines_loads_in_many_tasks(spark, tmp_path):
    """Breaks, escapes and quotes come back; a large file is split, its records never are."""
    texts = ["a\nb", "a\r\nb\\", "\\n", "\\s\\", "tab\t\"q\"\n", "", None, "\n"]
    df = spark.range(4000).select(
        F.col("id").alias("i"),
        F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") % 8 + 1).cast("int")).alias("s"),
        F.repeat(F.lit("x\n"), 50).alias("long"),
    )
    path = str(tmp_path / "out")
    files.export(df.coalesce(1), path, "lines")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        back = files.load(spark, path, df.schema, "lines")
        assert back.select(F.spark_partition_id()).distinct().count() > 3
        assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rejects_are_kept_though_the_load_fails(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1\ta\nx\tb\n2\tc\n")
    schema = spark.createDataFrame([], "i int, s string").schema
    for fmt in ("char", "lines"):
        rejects = str(tmp_path / f"rejects-{fmt}")
        with pytest.raises(files.TooManyBadRows):
            files.load(spark, str(tmp_path / "in.csv"), schema, fmt, 0, rejects)
        assert [r.value for r in spark.read.text(rejects).collect()] == ["x\tb"]
        again = files.load(spark, str(tmp_path / "in.csv"), schema, fmt, 1, f"{rejects}-2")
        assert sorted(r.i for r in again.collect()) == [1, 2]
