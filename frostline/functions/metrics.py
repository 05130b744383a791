"""Timing and progress of runs, and the audit text of a job result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def job_time(finished: Column, started: Column, scheduled: Column, created: Column) -> Column:
    """The most telling timestamp of a job."""
    return F.coalesce(finished, started, scheduled, created)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end as a double, never below zero."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.greatest(F.lit(0.0), micros / F.lit(1_000_000.0))


def duration_seconds(duration_ms: Column, started: Column, finished: Column) -> Column:
    """The recorded duration, else the gap between the two times."""
    return F.coalesce(duration_ms / F.lit(1000.0), seconds_between(started, finished))


def throughput(rows: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, rows / seconds).otherwise(F.lit(0.0))


def percent_complete(done: Column, total: Column) -> Column:
    """Share done in percent, at most 100; 0 where the total is unknown or zero."""
    return F.when(total > 0, F.least(F.lit(100.0), done / total * 100)).otherwise(F.lit(0.0))


def seconds_left(done: Column, total: Column, seconds: Column) -> Column:
    """Time left at the current rate; NULL while there is no rate."""
    rate = throughput(done, seconds)
    return F.when(rate > 0, (total - done) / rate)


def _text_field(document: Column, path: str) -> Column:
    """A field of a parsed JSON document, if it is a text."""
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(document, path, "string"))


def audit_text(result: Column) -> Column:
    """AuditMarkdown from a result that is JSON, JSON quoted as a string, or null.

    Text that is no JSON, another kind of value and blank text give NULL.
    """
    document = F.try_parse_json(F.trim(result))
    inner = F.try_parse_json(_text_field(document, "$"))
    plain, quoted = (_text_field(d, "$.AuditMarkdown") for d in (document, inner))
    found = F.coalesce(plain, quoted)
    return F.when(F.trim(found) != "", found)
