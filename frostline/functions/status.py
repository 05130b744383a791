"""Task and job status codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task status codes with their stage names and display texts.
TASK_STATUS = {
    0: ("PendingValidation", "待校验"),
    1: ("Validating", "校验中"),
    2: ("Queued", "已排队"),
    3: ("Running", "执行中"),
    4: ("Succeeded", "已成功"),
    5: ("Failed", "已失败"),
    6: ("Cancelled", "已取消"),
}
# Task codes that count as active, and those whose heartbeat is watched.
ACTIVE_TASK = (0, 1, 2, 3)
MONITORED_TASK = (1, 2, 3)
# Job run status codes.
JOB_STATUS = {0: "NotStarted", 1: "Running", 2: "Success", 3: "Failed", 4: "Skipped"}
# Texts shown when an enrichment finds no match.
UNKNOWN_SOURCE = "未知数据库"
UNKNOWN_TABLE = "未知对象"


def _lookup(code: Column, pairs: dict) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), code.cast("string"))


def stage_name(code: Column) -> Column:
    """Stage name of a task status; codes outside the list show as digits."""
    return _lookup(code, {k: v[0] for k, v in TASK_STATUS.items()})


def display_text(code: Column) -> Column:
    return _lookup(code, {k: v[1] for k, v in TASK_STATUS.items()})


def job_status_name(code: Column) -> Column:
    return _lookup(code, JOB_STATUS)
