"""Parameters of the jobs: boundary lists, retention rules and archive jobs.

Everything here is a small value the driver holds; table data never passes
through these classes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of partition column and the Spark type each one uses.
class ValueKind(str, Enum):
    INT = "Int"
    BIGINT = "BigInt"
    DATE = "Date"
    DATETIME = "DateTime"
    DATETIME2 = "DateTime2"
    GUID = "Guid"
    STRING = "String"

    @property
    def spark_type(self) -> str:
        return {
            "Int": "int",
            "BigInt": "bigint",
            "Date": "date",
            "DateTime": "timestamp_ntz",
            "DateTime2": "timestamp_ntz",
            "Guid": "string",
            "String": "string",
        }[self.value]

    @property
    def is_temporal(self) -> bool:
        return self in (ValueKind.DATE, ValueKind.DATETIME, ValueKind.DATETIME2)

    @property
    def is_integer(self) -> bool:
        return self in (ValueKind.INT, ValueKind.BIGINT)


# Most partitions a partition function may have in the source system.
MAX_PARTITIONS = 15_000


def parse_value(kind: ValueKind, raw):
    """Boundary text (or native value) to the Python value used for ordering."""
    if raw is None or (isinstance(raw, str) and not raw.strip()):
        raise ValueError("a boundary value must not be blank")
    if kind.is_integer:
        value = int(raw)
        width = 31 if kind is ValueKind.INT else 63
        if not -(2**width) <= value < 2**width:
            raise ValueError(f"{value} is outside the range of {kind.value}")
        return value
    if kind is ValueKind.DATE:
        if isinstance(raw, datetime):
            return raw.date()
        return raw if isinstance(raw, date) else date.fromisoformat(raw.strip()[:10])
    if kind.is_temporal:
        if isinstance(raw, datetime):
            return raw
        if isinstance(raw, date):
            return datetime(raw.year, raw.month, raw.day)
        return datetime.fromisoformat(raw.strip())
    if kind is ValueKind.GUID:
        return str(uuid.UUID(str(raw)))
    return str(raw)


def invariant_text(kind: ValueKind, value) -> str:
    """Culture-free text of a boundary; DateTime2 carries seven digits, the last 0."""
    if kind is ValueKind.DATETIME:
        return value.strftime("%Y-%m-%d %H:%M:%S")
    if kind is ValueKind.DATETIME2:
        return value.strftime("%Y-%m-%d %H:%M:%S.%f") + "0"
    return value.isoformat() if kind is ValueKind.DATE else str(value)


def literal_text(kind: ValueKind, value) -> str:
    """SQL literal of a boundary, quotes doubled."""
    text = invariant_text(kind, value)
    return text if kind.is_integer else "'" + text.replace("'", "''") + "'"


def boundary_lit(kind: ValueKind, value) -> Column:
    """Typed literal; a cast of a constant, so it folds before filter pushdown."""
    if kind.is_integer:
        return F.lit(value).cast(kind.spark_type)
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
    return F.lit(text).cast(kind.spark_type)


def _order(value):
    # Strings compare by UTF-8 bytes, which is what Spark's own ordering does.
    return value.encode("utf-8") if isinstance(value, str) else value


@dataclass(frozen=True)
class PartitionSpec:
    """A partition function: column, boundaries in strictly rising order, side.

    RANGE RIGHT puts a row equal to a boundary into the partition on the right of
    it, RANGE LEFT into the one on the left. NULL goes to partition 1.
    """

    column: str
    kind: ValueKind
    boundaries: tuple = ()
    range_right: bool = True
    nullable: bool = True

    def __post_init__(self):
        kind = ValueKind(self.kind)
        values = tuple(parse_value(kind, v) for v in self.boundaries)
        object.__setattr__(self, "kind", kind)
        object.__setattr__(self, "boundaries", values)
        if len(values) >= MAX_PARTITIONS:
            raise ValueError(f"more than {MAX_PARTITIONS} partitions")
        for left, right in zip(values, values[1:]):
            if _order(left) >= _order(right):
                raise ValueError("boundaries must be strictly increasing")

    @classmethod
    def of(cls, column, kind, values, range_right=True, nullable=True) -> "PartitionSpec":
        """Sort and deduplicate a list of values given in any order."""
        kind = ValueKind(kind)
        parsed = {parse_value(kind, v) for v in values}
        if not parsed:
            raise ValueError("at least one boundary is needed")
        return cls(column, kind, tuple(sorted(parsed, key=_order)), range_right, nullable)

    @property
    def partition_count(self) -> int:
        return len(self.boundaries) + 1

    @property
    def range_type(self) -> str:
        return "RIGHT" if self.range_right else "LEFT"

    def texts(self) -> list[str]:
        return [invariant_text(self.kind, b) for b in self.boundaries]

    def bounds(self, number: int):
        """(lower, upper) boundary of a partition; None where it is open."""
        if not 1 <= number <= self.partition_count:
            raise ValueError(f"no partition {number}")
        lower = self.boundaries[number - 2] if number > 1 else None
        upper = self.boundaries[number - 1] if number <= len(self.boundaries) else None
        return lower, upper

    def boundary_index(self, key) -> int:
        """Position of a boundary named by sort key ('0003') or by its value."""
        text = str(key)
        if isinstance(key, str) and len(text) >= 4 and text.isdigit():
            index = int(text) - 1
            if 0 <= index < len(self.boundaries):
                return index
            raise ValueError(f"no boundary {key}")
        value = parse_value(self.kind, key)
        if value not in self.boundaries:
            raise ValueError(f"no boundary {key}")
        return self.boundaries.index(value)

    def with_boundaries(self, values) -> "PartitionSpec":
        return replace(self, boundaries=tuple(values))

    # Rules for changing the list. Each returns a new spec or raises ValueError.

    def append(self, raw) -> "PartitionSpec":
        """Grow at the open end: above the maximum (RIGHT) or below the minimum (LEFT)."""
        value = parse_value(self.kind, raw)
        if not self.boundaries:
            return self.with_boundaries([value])
        if self.range_right:
            if _order(value) <= _order(self.boundaries[-1]):
                raise ValueError("a RANGE RIGHT boundary must exceed the current maximum")
            return self.with_boundaries([*self.boundaries, value])
        if _order(value) >= _order(self.boundaries[0]):
            raise ValueError("a RANGE LEFT boundary must be below the current minimum")
        return self.with_boundaries([value, *self.boundaries])

    def split(self, raws) -> "PartitionSpec":
        """Insert new boundaries anywhere; they must run in one direction and be new."""
        values = [parse_value(self.kind, r) for r in raws]
        if not values:
            raise ValueError("at least one new boundary is needed")
        keys = [_order(v) for v in values]
        if len(set(keys)) != len(keys) or keys not in (sorted(keys), sorted(keys, reverse=True)):
            raise ValueError("new boundaries must rise or fall strictly")
        if set(values) & set(self.boundaries):
            raise ValueError("a boundary with this value exists")
        return self.with_boundaries(sorted([*self.boundaries, *values], key=_order))

    def split_at(self, key, raw) -> "PartitionSpec":
        """Split the partition next to boundary ``key``: below it (RIGHT) or above it (LEFT)."""
        index = self.boundary_index(key)
        value = parse_value(self.kind, raw)
        low = index - 1 if self.range_right else index
        lower = self.boundaries[low] if low >= 0 else None
        upper = self.boundaries[low + 1] if low + 1 < len(self.boundaries) else None
        if lower is not None and _order(value) <= _order(lower):
            raise ValueError("the new boundary is at or below the range being split")
        if upper is not None and _order(value) >= _order(upper):
            raise ValueError("the new boundary is at or above the range being split")
        return self.split([value])

    def missing(self, wanted) -> list:
        """Wanted boundaries that are not there yet, in order."""
        parsed = {parse_value(self.kind, w) for w in wanted}
        return sorted(parsed - set(self.boundaries), key=_order)

    def merge(self, key) -> "PartitionSpec":
        index = self.boundary_index(key)
        return self.with_boundaries(b for i, b in enumerate(self.boundaries) if i != index)

    def to_dict(self) -> dict:
        return {
            "column": self.column,
            "kind": self.kind.value,
            "boundaries": [
                v if self.kind.is_integer else (v.isoformat() if hasattr(v, "isoformat") else v)
                for v in self.boundaries
            ],
            "range_right": self.range_right,
            "nullable": self.nullable,
        }

    @classmethod
    def from_dict(cls, data: dict) -> "PartitionSpec":
        return cls(
            data["column"],
            data["kind"],
            tuple(data["boundaries"]),
            data["range_right"],
            data["nullable"],
        )


@dataclass(frozen=True)
class Retention:
    """Keep the newest ``keep_latest`` partitions, or those newer than ``keep_days``."""

    keep_latest: int | None = None
    keep_days: int | None = None

    def __post_init__(self):
        given = [v for v in (self.keep_latest, self.keep_days) if v is not None]
        if len(given) != 1 or given[0] <= 0:
            raise ValueError("give one positive retention value")


@dataclass(frozen=True)
class ArchiveJob:
    """One archive job. ``where`` is a raw predicate, ``filters`` a stored definition.

    A bounded run takes rows in order of ``order_by``, else of the keys, else of the
    filter column. An order that follows the files (time, as a rule) touches fewer. Without
    ``max_rows`` it takes all.

    ``on_duplicate`` says what keys are for. 'skip': they are unique; a row that is in the
    target already is not written again, and a row whose key is there with other content is
    left in the source and counted. 'fail': a known key fails the run. 'append': keys order
    the rows at most; exactly the rows written leave the source, and the run id alone tells
    a repeated run.

    ``method`` is what a scheduled run does: 'bounded', 'copy' or 'move' of all matching rows,
    or 'partition', which archives partition ``partition_no`` of a partitioned source.
    """

    name: str
    source: str
    target: str
    filter_column: str | None = None
    where: str | None = None
    filters: str | None = None
    keys: tuple[str, ...] = ()
    batch_size: int = 5_000
    max_rows: int | None = None
    delete_source: bool = True
    on_duplicate: str = "skip"
    max_failures: int = 5
    enabled: bool = True
    as_of: datetime | None = None
    exclude: tuple[str, ...] = field(default_factory=tuple)
    order_by: tuple[str, ...] = field(default_factory=tuple)
    method: str = "bounded"
    partition_no: int | None = None

    def __post_init__(self):
        for label in ("name", "source", "target"):
            if not str(getattr(self, label) or "").strip():
                raise ValueError(f"{label} must not be blank")
        if self.batch_size <= 0:
            raise ValueError("batch_size must be positive")
        if self.max_rows is not None and self.max_rows < self.batch_size:
            raise ValueError("max_rows must not be below batch_size")
        if self.max_failures <= 0:
            raise ValueError("max_failures must be positive")
        if self.on_duplicate not in ("fail", "skip", "append"):
            raise ValueError("on_duplicate is 'fail', 'skip' or 'append'")
        if self.method not in ("bounded", "copy", "move", "partition"):
            raise ValueError("method is 'bounded', 'copy', 'move' or 'partition'")
        if (self.method == "partition") != (self.partition_no is not None):
            raise ValueError("a partition job, and no other, needs a partition_no")

    def describe(self) -> str:
        return json.dumps({"job": self.name, "source": self.source, "target": self.target})
