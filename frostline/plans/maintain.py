"""Changing how a stored table is partitioned."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from frostline.operators.checks import null_keys, schema_issues
from frostline.sources.store import Snapshot, Store, VerificationFailed, read_parts
from frostline.spec import PartitionSpec


class Refused(Exception):
    """A precondition of the change does not hold."""


def to_partitioned(spark: SparkSession, path: str, spec: PartitionSpec, content=False) -> bool:
    """Rewrite a table by partition; False if it is partitioned by that column already.

    A column declared NOT NULL must hold no NULL.
    """
    store = Store(spark, path)
    base = store.snapshot()
    if base.spec is not None:
        if base.spec.column == spec.column:
            return False
        raise Refused("the table is partitioned by another column")
    base.require_settled()
    rows = base.read(spark)
    if not spec.nullable:
        found = null_keys(rows, spec.column).first()[0]
        if found:
            raise Refused(f"{found} rows have no {spec.column}")
    before = rows.count()
    written = store.write(rows, spec, content)
    if written.rows != before:
        raise VerificationFailed(f"{before} rows became {written.rows}")
    store.verify(written, base.schema)
    store.commit(replace(base, spec=spec, parts=written.parts, removed=()))
    return True


def sync_boundaries(spark: SparkSession, path: str, wanted: PartitionSpec) -> list:
    """Partition a table if it is not yet, then add the boundaries it lacks. Returns those."""
    if to_partitioned(spark, path, wanted):
        return []
    missing = Store(spark, path).snapshot().spec.missing(wanted.boundaries)
    if missing:
        apply_split(spark, path, missing)
    return missing


def apply_split(spark: SparkSession, path: str, new) -> PartitionSpec:
    """Add boundaries. Only partitions they cut are written again; others get a new number."""
    store = Store(spark, path)
    base = store.snapshot()
    if base.spec is None:
        raise Refused("the table is not partitioned")
    base.require_settled()
    after = base.spec.split(new)
    olds = set(base.spec.boundaries)
    number_of, cut, old = {}, set(), 1
    for at, value in enumerate(after.boundaries, start=1):
        number_of.setdefault(old, at)
        if value in olds:
            old += 1
        else:
            cut.add(old)
    number_of.setdefault(old, after.partition_count)
    hurt = tuple(p for p in base.parts if p.pno in cut)
    kept = tuple(replace(p, pno=number_of[p.pno]) for p in base.parts if p.pno not in cut)
    added = ()
    if hurt:
        rows = base.read(spark, cut)
        written = store.write(rows, after)
        if written.rows != rows.count():
            raise VerificationFailed("a split must keep every row")
        store.verify(written, base.schema)
        added = written.parts
    store.commit(replace(base, spec=after, parts=(*kept, *added)))
    return after


def apply_merge(spark: SparkSession, path: str, key, force=False) -> PartitionSpec:
    """Remove a boundary. No data moves; a side with no rows blocks it unless forced."""
    store = Store(spark, path)
    base = store.snapshot()
    if base.spec is None:
        raise Refused("the table is not partitioned")
    left = base.spec.boundary_index(key) + 1
    after = base.spec.merge(key)
    filled = {p.pno for p in base.parts}
    if not force and not {left, left + 1} <= filled:
        raise Refused(f"partition {left} or {left + 1} is empty")
    parts = tuple(replace(p, pno=p.pno - 1) if p.pno > left else p for p in base.parts)
    store.commit(replace(base, spec=after, parts=parts))
    return after


def switch_partition(spark: SparkSession, source: str, target: str, number: int, run: str) -> int:
    """Hand a partition over to a table of the same shape, by two commits and no copy.

    Columns must agree in count, order, name, type and nullability, and the target (or
    its partition of that number) must be empty. Running again with the same run id
    finishes a switch cut short between the commits. Returns the rows switched.
    """
    src, dst = Store(spark, source), Store(spark, target)
    s, t = src.snapshot(), dst.snapshot()
    if run not in t.runs:
        issues = schema_issues(s.schema, t.schema)
        if issues:
            raise Refused(f"{issues[0][0]} {issues[0][1]}".strip())
        if t.spec is not None and (t.spec.column, t.spec.bounds(number)) != (
            s.spec.column, s.spec.bounds(number),
        ):
            raise Refused("the partition has other bounds in the target")
        taken = t.parts if t.spec is None else t.of(number)
        if taken:
            raise Refused("the target is not empty")
        s.require_settled()
        parts = s.of(number)
        rows = s.read(spark, number).count()
        moved = parts if t.spec is not None else tuple(replace(p, pno=None) for p in parts)
        facts = {"rows": rows, "folders": [p.path for p in parts]}
        gone = tuple(r for r in s.removed if r not in t.removed) if moved else ()
        arrived = replace(t.plus(moved), removed=(*t.removed, *gone))
        alone = Snapshot(0, t.schema, t.spec, moved, removed=s.removed)
        landed = alone.read(spark).count() if moved else 0
        if landed != rows:
            raise VerificationFailed(f"{rows} rows to switch, {landed} in the target")
        t = dst.commit(arrived.noting(run, facts))
    folders = set(t.runs[run]["folders"])
    leaving = [p for p in s.parts if p.path in folders]
    if leaving:
        lent = tuple(dict.fromkeys((*s.lent, *folders, *(r.path for r in s.removed))))
        src.commit(replace(s.without(leaving), lent=lent))
    return t.runs[run]["rows"]


def residual_rows(spark: SparkSession, path: str, number: int) -> int:
    """Rows lying in one partition of a stored table; only its files are looked at."""
    rows = Store(spark, path).read(number)
    return rows.agg(F.count(F.lit(1))).first()[0]


def truncate_partition(spark: SparkSession, path: str, number: int, confirm=False) -> int:
    """Empty one partition. Says how many rows there are and does it only if confirmed."""
    rows = residual_rows(spark, path, number)
    if not confirm:
        raise Refused(f"partition {number} holds {rows} rows; confirm to drop them")
    store = Store(spark, path)
    base = store.snapshot()
    base.require_settled()
    store.commit(base.without(base.of(number)))
    return rows


def compact(spark: SparkSession, path: str) -> int:
    """Write the table again without the rows that are gone; returns how many those were.

    Only a table with removals is written. Folders are not deleted here, see ``reclaim``.
    """
    store = Store(spark, path)
    base = store.snapshot()
    base.require_settled()
    if not base.removed:
        return 0
    held = read_parts(spark, base.parts, base.schema).count()
    written = store.write(base.read(spark), base.spec)
    store.verify(written, base.schema)
    store.commit(replace(base, parts=written.parts, removed=()))
    return held - written.rows
