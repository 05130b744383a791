from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frostline.plans.archive import archive_move
from frostline.plans.profiles import ProfileMissing, merged_profile, refresh_profile
from frostline.sources.store import Store
from frostline.spec import ArchiveJob

COLUMNS = ["k", "d", "t", "x", "s", "none"]


def rows(spark, a, b):
    return spark.range(a, b).select(
        F.col("id").alias("k"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("d"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"),
        (F.col("id") / 2).alias("x"),
        F.when(F.col("id") % 4 > 0, (F.col("id") % 50).cast("string")).alias("s"),
        F.lit(None).cast("int").alias("none"),
    )


def test_parts_are_read_once_and_merged(spark, tmp_path):
    """Appends and a move: only new parts and those that lost rows are read again."""
    table = Store(spark, str(tmp_path / "t"))
    table.append(rows(spark, 0, 4000))
    with pytest.raises(ProfileMissing):
        merged_profile(spark, table, COLUMNS)
    assert refresh_profile(spark, table, COLUMNS) == 1
    table.append(rows(spark, 4000, 6000))
    with pytest.raises(ProfileMissing):
        merged_profile(spark, table, COLUMNS)
    assert refresh_profile(spark, table, COLUMNS) == 1
    assert refresh_profile(spark, table, COLUMNS[:2]) == 0

    found = {r.column_name: r for r in merged_profile(spark, table, COLUMNS, (0.0, 0.5, 1.0)).collect()}
    k, d, t, x, s, none = (found[c] for c in COLUMNS)
    assert (k.min_value, k.max_value, k.total_rows, k.null_rows) == ("0", "5999", 6000, 0)
    assert abs(k.distinct_rows - 6000) < 300
    assert (k.quantiles[0], k.quantiles[2]) == ("0", "5999") and abs(int(k.quantiles[1]) - 3000) < 180
    assert (d.min_value, d.max_value, d.distinct_rows) == ("2024-01-01", "2024-04-09", 100)
    assert date.fromisoformat(d.quantiles[1]) - date(2024, 2, 19) < timedelta(days=4)
    start = datetime(1970, 1, 1)
    assert (t.min_value, t.max_value) == (str(start), str(start + timedelta(seconds=5999)))
    assert (x.min_value, x.max_value) == ("0.0", "2999.5")
    assert (s.min_value, s.max_value, s.null_rows, s.quantiles) == ("0", "9", 1500, None)
    assert (none.min_value, none.total_rows, none.null_rows) == (None, 6000, 6000)
    assert (none.distinct_rows, none.quantiles) == (0, None)

    job = ArchiveJob("j", table.path, str(tmp_path / "old"), filter_column="t",
                     where="< '1970-01-01 00:16:40'", keys=("k",))
    archive_move(spark, job)  # 1000 rows of the first part
    assert refresh_profile(spark, table, COLUMNS) == 1
    row = merged_profile(spark, table, ["k"]).first()
    assert (row.min_value, row.max_value, row.total_rows) == ("1000", "5999", 5000)


def test_no_row_of_the_table_is_read(spark, tmp_path, plan):
    table = Store(spark, str(tmp_path / "t"))
    table.append(rows(spark, 0, 100))
    refresh_profile(spark, table, ["k"])
    text = plan(merged_profile(spark, table, ["k"]))
    assert "_profile/data" in text and "/t/data" not in text


def test_empty_and_unfit(spark, tmp_path):
    table = Store(spark, str(tmp_path / "t"))
    table.create(rows(spark, 0, 0).withColumn("b", F.array("k")).schema)
    assert refresh_profile(spark, table, ["k"]) == 0
    assert merged_profile(spark, table, ["k"]).collect() == []
    with pytest.raises(ValueError):
        refresh_profile(spark, table, ["b"])
