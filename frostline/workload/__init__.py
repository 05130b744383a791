"""Every operator as a query over the given tables."""

from frostline.workload import filters, jobs, moves, ranges, runlog  # noqa: F401
from frostline.workload.flagship import archive_candidates as flagship
from frostline.workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]
