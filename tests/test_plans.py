"""No query plans a cross product, a Python step or an unbounded single-task window."""

import pytest

from frostline.workload import QUERIES

SF = "/root/testdata/sf0.001"
# Queries that run whole jobs or streams; what they return is a plain read.
JOBS = ("archive_", "switch", "split_stored", "merge_stored", "convert", "truncate", "resume",
        "stored", "append", "export", "stale_heartbeat", "tail_log")
NAMES = [n for n in sorted(QUERIES) if not n.startswith(JOBS) or n == "archive_candidates"]


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, plan, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas",
                "FlatMapGroups"):
        assert bad not in text
