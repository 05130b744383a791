from datetime import datetime

import pytest
from pyspark.sql import functions as F

from frostline.functions.metrics import audit_text
from frostline.functions.status import display_text, job_status_name, stage_name
from frostline.functions.values import parse_boundary, sort_key
from frostline.operators import runlog as rl
from frostline.spec import ValueKind


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"AuditMarkdown": "a"}', "a"),
        (' {"AuditMarkdown": "a", "x": 1} ', "a"),
        ('"{\\"AuditMarkdown\\": \\"b\\"}"', "b"),
        ('{"AuditMarkdown": 5}', None),
        ('{"AuditMarkdown": null}', None),
        ('{"AuditMarkdown": {"a": 1}}', None),
        ('{"AuditMarkdown": " "}', None),
        ('{"Other": "a"}', None),
        ('[1]', None),
        ("null", None),
        ("NULL", None),
        ("", None),
        ("not json", None),
        ('"plain"', None),
        (None, None),
    ],
)
def test_audit_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "r string")
    assert df.select(audit_text(F.col("r")).alias("a")).first().a == want


def test_status_texts(spark):
    row = spark.sql("SELECT 4 AS a, 9 AS b").select(
        stage_name(F.col("a")), display_text(F.col("a")), stage_name(F.col("b")),
        job_status_name(F.col("a")),
    ).first()
    assert tuple(row) == ("Succeeded", "已成功", "9", "Skipped")


def test_parse_rejects_bad_text(spark):
    df = spark.createDataFrame([("",), (" 7 ",), ("1.5",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_boundary(F.col("t"), ValueKind.INT)).collect()]
    assert got == [None, 7, None, None, None]


def test_sort_keys(spark):
    df = spark.createDataFrame([(1,), (12345,)], "n int")
    assert [r[0] for r in df.select(sort_key(F.col("n"))).collect()] == ["0001", "12345"]


def test_defaults_of_lists(spark):
    df = spark.range(300).select(
        "id", F.lit("t").alias("task"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts")
    )
    assert rl.recent(df, ts="ts", tie="id").count() == df.count()
    with pytest.raises(ValueError):
        rl.recent(df, 0, ts="ts", tie="id")
    logs = rl.logs_since(df, "t", None, 200, task_column="task", ts="ts", entry="id")
    assert logs.count() == 200 and logs.first().id == 0


def test_empty_inputs(spark):
    runs = spark.createDataFrame([], "job string, status string, rows bigint")
    assert rl.batch_summary(
        runs.withColumn("ok", F.lit(True)), succeeded="ok", rows="rows"
    ).first().asDict() == {"tasks": 0, "success": 0, "failed": 0, "rows": 0}
    jobs = runs.withColumn("on", F.lit(True)).withColumn(
        "at", F.lit(None).cast("timestamp_ntz")
    )
    row = rl.job_dashboard(
        jobs, datetime(2024, 1, 1).date(), enabled="on", status="status", last_run="at",
        total_rows="rows", success="s", failed="f", running="r",
    ).first()
    assert row.total_jobs == 0 and row.today_success_rate == 0 and row.mean_rows == 0


def test_config_stage_falls_back(spark):
    configs = spark.createDataFrame([(1, "Draft"), (2, "Draft")], "cid int, stage string")
    tasks = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), 10, "Failed"), (1, datetime(2024, 1, 2), 11, "Running")],
        "config int, ts timestamp_ntz, id int, st string",
    )
    got = rl.config_stages(
        configs, tasks, key="cid", task_key="config", ts="ts", tie="id", stage="stage",
        task_stage="st",
    )
    assert sorted(map(tuple, got.collect())) == [(1, "Running", 11), (2, "Draft", None)]


def test_deep_page_equals_shallow_page(spark, monkeypatch):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v")).repartition(4)
    order = [F.desc("v"), "id"]
    shallow = [tuple(r) for r in rl.page(df, order, 6, 40).collect()]
    monkeypatch.setattr(rl, "DEEP", 10)
    deep = [tuple(r) for r in rl.page(df, order, 6, 40).collect()]
    assert deep == shallow and len(deep) == 40
