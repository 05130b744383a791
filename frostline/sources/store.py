"""Tables as immutable write folders plus a numbered list of commits.

A commit is one small JSON file, renamed into place; it names the folders (or
single files) that make up the table, so readers always see a whole version and a
row is never deleted in place. Each writer states the version it started from, and
of two that start from the same one only the first gets through.

Partition numbers live in the commit, not in the files: renumbering, merging or
handing a partition to another table moves no data.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.functions.names import free_name, free_names
from frostline.operators.checks import content_marks
from frostline.operators.ranges import with_partition_no
from frostline.sources import paths, removals
from frostline.sources.removals import Removal
from frostline.sources.storage import MB, data_files
from frostline.spec import PartitionSpec


class CommitConflict(Exception):
    """Another writer committed first."""


class VerificationFailed(Exception):
    """What landed on disk is not what was sent."""


class UnsettledMove(Exception):
    """Rows of the table are on their way to another one; finish or abandon that run first."""


class SchemaMismatch(Exception):
    """Rows do not have the columns of the table they are meant for."""


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the table's column order; refuses missing, extra and differently typed ones.

    Leaving a column out is the caller's decision, never a side effect.
    """
    given = {f.name.lower(): f for f in df.schema}
    wanted = {f.name.lower(): f for f in schema}
    if given.keys() != wanted.keys():
        raise SchemaMismatch(f"columns {sorted(given.keys() ^ wanted.keys())} are on one side only")
    for name, field_ in wanted.items():
        if given[name].dataType != field_.dataType:
            have = given[name].dataType.simpleString()
            raise SchemaMismatch(f"{name} is {have}, not {field_.dataType.simpleString()}")
    return df.select(*[F.col(given[n].name).alias(f.name) for n, f in wanted.items()])


@dataclass(frozen=True)
class Part:
    """A folder of the table, or some files of it; ``pno`` only in partitioned tables, ``rows``
    where the writer counted them."""

    path: str
    pno: int | None = None
    files: tuple[str, ...] | None = None
    rows: int | None = None

    def locations(self) -> list[str]:
        return [self.path] if self.files is None else list(self.files)


@dataclass(frozen=True)
class Snapshot:
    """One version of a table."""

    version: int
    schema: T.StructType
    spec: PartitionSpec | None = None
    parts: tuple[Part, ...] = ()
    runs: dict = field(default_factory=dict)
    lent: tuple[str, ...] = ()  # folders other tables read, to be kept
    removed: tuple[Removal, ...] = ()  # rows of the parts' files that are gone
    intents: dict = field(default_factory=dict)  # moves under way, by run

    def read(self, spark: SparkSession, numbers=None) -> DataFrame:
        """Rows of the table, or of some partitions, found through the commit alone."""
        if self.removed:
            return self.addressed(spark, *self.address_names(), numbers).select(*self.schema.names)
        wanted = self.parts if numbers is None else self.of(numbers)
        return read_parts(spark, wanted, self.schema)

    def address_names(self) -> list[str]:
        """Free names for a row's file and its place in it."""
        return free_names(self.schema.names, "_file", "_row")

    def addressed(self, spark: SparkSession, file: str, row: str, numbers=None, also_without=()):
        """Rows with their file and place in it, which name a row of a version exactly."""
        wanted = self.parts if numbers is None else self.of(numbers)
        rows = read_parts(spark, wanted, self.schema)
        if not wanted:
            return rows.withColumns({file: F.lit(None).cast("string"), row: F.lit(None).cast("long")})
        rows = rows.select(
            "*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)
        )
        return removals.without(rows, (*self.removed, *also_without), file, row)

    def in_flight(self, but: str | None = None) -> tuple[Removal, ...]:
        """Rows that open moves, other than the given run, have claimed."""
        return tuple(Removal(*i["rows"]) for run, i in self.intents.items() if run != but)

    def require_settled(self) -> None:
        if self.intents:
            raise UnsettledMove(f"runs {sorted(self.intents)} are under way")

    def of(self, numbers) -> tuple[Part, ...]:
        if self.spec is None:
            raise ValueError("the table is not partitioned")
        chosen = {numbers} if isinstance(numbers, int) else set(numbers)
        return tuple(p for p in self.parts if p.pno in chosen)

    def without(self, parts) -> "Snapshot":
        gone = set(parts)
        return replace(self, parts=tuple(p for p in self.parts if p not in gone))

    def plus(self, parts) -> "Snapshot":
        return replace(self, parts=(*self.parts, *parts))

    def noting(self, run: str, facts: dict) -> "Snapshot":
        return replace(self, runs={**self.runs, run: facts})

    def to_json(self) -> str:
        return json.dumps(
            {
                "version": self.version,
                "schema": json.loads(self.schema.json()),
                "spec": self.spec.to_dict() if self.spec else None,
                "parts": [
                    {"path": p.path, "pno": p.pno, "files": p.files, "rows": p.rows}
                    for p in self.parts
                ],
                "runs": self.runs,
                "lent": self.lent,
                "removed": [[r.path, r.spans, r.rows] for r in self.removed],
                "intents": self.intents,
            }
        )

    @classmethod
    def from_json(cls, text: str) -> "Snapshot":
        data = json.loads(text)
        return cls(
            data["version"],
            T.StructType.fromJson(data["schema"]),
            PartitionSpec.from_dict(data["spec"]) if data["spec"] else None,
            tuple(
                Part(
                    p["path"],
                    p["pno"],
                    tuple(p["files"]) if p["files"] is not None else None,
                    p.get("rows"),
                )
                for p in data["parts"]
            ),
            data["runs"],
            tuple(data["lent"]),
            tuple(Removal(*r) for r in data.get("removed", ())),
            data.get("intents", {}),
        )


def read_parts(spark: SparkSession, parts, schema: T.StructType) -> DataFrame:
    """The given schema is used as is, so no file is opened for planning."""
    locations = [loc for p in parts for loc in p.locations()]
    if not locations:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*locations)


@dataclass(frozen=True)
class Written:
    """Rows that landed in a folder not yet part of any version."""

    parts: tuple[Part, ...]
    rows: int
    marks: tuple | None = None


class Store:
    """A table at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Versions.

    def commits_path(self) -> str:
        return f"{self.path}/_commits"

    def versions(self) -> list[int]:
        found = paths.names(self.spark, self.commits_path())
        return sorted(int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit())

    def exists(self) -> bool:
        return bool(self.versions())

    def snapshot(self, version: int | None = None) -> Snapshot:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        chosen = found[-1] if version is None else version
        text = paths.read_text(self.spark, f"{self.commits_path()}/{chosen:020d}.json")
        return Snapshot.from_json(text)

    def commit(self, changed: Snapshot) -> Snapshot:
        """Publish a changed snapshot as the version after the one it came from."""
        nxt = replace(changed, version=changed.version + 1)
        draft = f"{self.commits_path()}/.draft-{uuid.uuid4().hex}"
        place = f"{self.commits_path()}/{nxt.version:020d}.json"
        if not paths.write_once(self.spark, draft, place, nxt.to_json()):
            raise CommitConflict(f"{self.path} has moved past version {changed.version}")
        return nxt

    def create(self, schema: T.StructType, spec: PartitionSpec | None = None) -> Snapshot:
        """An empty table; fails if there is one."""
        return self.commit(Snapshot(0, schema, spec))

    def ensure(self, schema: T.StructType, spec: PartitionSpec | None = None) -> Snapshot:
        """The current version, creating an empty table shaped like the source if needed."""
        if not self.exists():
            try:
                return self.create(schema, spec)
            except CommitConflict:
                pass
        return self.snapshot()

    def adopt(self, location: str, schema: T.StructType | None = None) -> Snapshot:
        """A table over parquet files that already lie somewhere; they are only read."""
        found = schema or self.spark.read.parquet(location).schema
        where = paths.qualified(self.spark, location)
        return self.commit(Snapshot(0, found, None, (Part(where),), {}, (where,)))

    def read(self, numbers=None, version=None) -> DataFrame:
        return self.snapshot(version).read(self.spark, numbers)

    # Rows.

    def write(self, df: DataFrame, spec=None, content=False, small=False) -> Written:
        """Write rows to a new folder and count them on the way, with no second scan.

        A partitioned write is rebalanced by partition number: AQE splits a partition
        that dominates and packs the small ones. ``small`` packs a few rows out of many
        tasks into few files. The count sits in the last stage, where a task that is
        run again is counted once.
        """
        folder = f"{self.path}/data/w={uuid.uuid4().hex}"
        columns = sorted(df.columns)
        marks = content_marks(columns) if content else [F.count(F.lit(1)).alias("rows")]
        number = free_name("_pno", *df.columns)
        if spec is not None:
            df = with_partition_no(df, spec, number).hint("rebalance", number)
        elif small:
            df = df.hint("rebalance")
        seen = Observation(f"written-{uuid.uuid4().hex}")
        writer = df.observe(seen, *marks).write
        if spec is None:
            writer.parquet(folder)
        else:
            writer.partitionBy(number).parquet(folder)
        folder = paths.qualified(self.spark, folder)
        facts = seen.get
        if spec is None:
            parts = (Part(folder, rows=facts["rows"]),) if facts["rows"] else ()
        else:
            numbered = [n for n in paths.names(self.spark, folder) if n.startswith(f"{number}=")]
            parts = tuple(Part(f"{folder}/{n}", int(n.split("=")[1])) for n in numbered)
        print_ = (facts["mark_xor"], facts["mark_sum"]) if content else None
        return Written(parts, facts["rows"], print_)

    def write_removal(self, marks: DataFrame) -> Removal:
        """Write bitmaps to a new folder not yet part of any version."""
        folder = f"{self.path}/removed/m={uuid.uuid4().hex}"
        seen = Observation(f"removed-{uuid.uuid4().hex}")
        counts = [
            F.count(F.lit(1)).alias("spans"),
            F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("rows"),
        ]
        marks.observe(seen, *counts).write.parquet(folder)
        facts = seen.get
        return Removal(paths.qualified(self.spark, folder), facts["spans"], facts["rows"])

    def verify(self, written: Written, schema: T.StructType) -> None:
        """Read back what was written: the rows, and their content if it was marked."""
        back = read_parts(self.spark, written.parts, schema)
        if written.marks is None:
            landed = (back.count(), None)
        else:
            row = back.agg(*content_marks(sorted(schema.names))).first()
            landed = (row["rows"], (row["mark_xor"], row["mark_sum"]))
        if landed != (written.rows, written.marks):
            raise VerificationFailed(f"sent {written.rows} rows, found {landed[0]}")

    def append(self, df: DataFrame, run: str | None = None, facts=None, content=False) -> int:
        """Add rows as one commit; a run id that was committed before adds nothing.

        ``facts`` may carry a ``tick`` number: then the run id names a series, and only
        a tick beyond the last one adds rows.
        """
        base, written = self.ensure(df.schema), None
        while True:
            if run is not None and run in base.runs:
                tick = (facts or {}).get("tick")
                if tick is None:
                    return base.runs[run]["rows"]
                if tick <= base.runs[run]["tick"]:
                    return 0
            if written is None:
                written = self.write(conform(df, base.schema), base.spec, content)
                self.verify(written, base.schema)
            changed = base.plus(written.parts)
            if run is not None:
                changed = changed.noting(run, {"rows": written.rows, **(facts or {})})
            try:
                self.commit(changed)
                return written.rows
            except CommitConflict:
                # Added rows fit any later version of the same layout.
                later = self.snapshot()
                if later.spec != base.spec or later.schema != base.schema:
                    raise
                base = later

    def sizes(self) -> DataFrame:
        """MB per partition number (NULL if not partitioned), from one file listing."""
        parts = self.snapshot().parts
        where = [(loc, p.pno) for p in parts for loc in p.locations()]
        numbers = self.spark.createDataFrame(where, "location string, partition_number int")
        if not where:
            return numbers.select("partition_number", F.lit(0.0).alias("size_mb"))
        files = data_files(self.spark, [loc for loc, _ in where])
        # A location is a folder or a file; a file's own path or its folder finds it.
        folder = F.regexp_replace("path", "/[^/]*$", "")
        spots = files.withColumn("location", F.explode(F.array("path", folder)))
        return (
            spots.join(numbers, "location")
            .groupBy("partition_number")
            .agg(F.round(F.sum("length") / MB, 2).alias("size_mb"))
        )

    def reclaim(self) -> list[str]:
        """Delete own folders no version in use needs: neither the current one nor a table
        a folder was lent to. Call it while nobody reads an older version or writes."""
        current = self.snapshot()
        in_use = {r.path for r in (*current.removed, *current.in_flight())}
        own = paths.qualified(self.spark, f"{self.path}/data")
        needed = {p.path for p in current.parts} | set(current.lent) | in_use
        removed = []
        marks = paths.qualified(self.spark, f"{self.path}/removed")
        for spot in [f"{marks}/{n}" for n in paths.names(self.spark, marks)]:
            if spot not in needed:
                paths.delete_folder(self.spark, spot)
                removed.append(spot)
        for name in paths.names(self.spark, own):
            folder = f"{own}/{name}"
            inner = [n for n in paths.names(self.spark, folder) if "=" in n]
            for spot in [f"{folder}/{n}" for n in inner] if inner else [folder]:
                if spot not in needed:
                    paths.delete_folder(self.spark, spot)
                    removed.append(spot)
        return removed
