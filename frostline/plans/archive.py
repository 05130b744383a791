"""Archive jobs: copy, move, bounded runs, whole partitions, many jobs.

A move claims its rows in the source by one commit, writes them to the target, checks and
commits them there, and takes them out of the source by another commit. No file of the source
is written again. A crash between any two steps leaves every row in at least one table, and
running again with the same run id picks up where it stopped.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce
from threading import Lock
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.operators.checks import (
    DuplicateRows,
    RepeatedKeys,
    conflicts,
    guard_duplicates,
    reconcile,
    require_unique,
    same_rows,
)
from frostline.operators.filters import filter_from_json, raw_filter
from frostline.operators.joins import key_lookup, new_rows, new_rows_of_batch, within_keys_of
from frostline.operators.ordering import smallest
from frostline.operators.runlog import batch_summary
from frostline.plans.runs import (
    FAILED,
    SKIPPED,
    SUCCESS,
    RunLog,
    RunResult,
    new_run_id,
    utc_now,
)
from frostline.session import write_scratch
from frostline.sources import paths, removals
from frostline.sources.removals import Removal
from frostline.sources.store import (
    CommitConflict,
    Part,
    SchemaMismatch,
    Snapshot,
    Store,
    VerificationFailed,
    conform,
)
from frostline.spec import ArchiveJob


class ConflictingRows(Exception):
    """The target holds rows of the batch's keys with other content."""


# Why a load is given up before its commit.
REFUSALS = (DuplicateRows, RepeatedKeys, SchemaMismatch, VerificationFailed, CommitConflict)


def job_predicate(job: ArchiveJob, schema) -> Column:
    """Stored filter and raw predicate of a job, joined by AND. One must be given."""
    parts = []
    if job.filters:
        stored = filter_from_json(job.filters, schema, job.as_of)
        if stored is not None:
            parts.append(stored)
    if job.where:
        if not job.filter_column:
            raise ValueError("a raw predicate needs its filter column")
        parts.append(raw_filter(job.filter_column, job.where, job.as_of))
    if not parts:
        raise ValueError("an archive job needs a filter")
    return reduce(lambda a, b: a & b, parts)


def _result(job, run, method, status, started, **facts) -> RunResult:
    return RunResult(
        run, job.name, job.source, job.target, method, status,
        started_at=started, finished_at=utc_now(), **facts,
    )


def _load(
    target: Store, rows: DataFrame, job, run, facts, content=False, batch=None, moving=False,
    unknown_at=None,
) -> int:
    """Write rows the target does not have, check them and commit. Returns rows written.

    ``batch`` is the exact row count of a bounded run, if this is one. A move leaves out
    only rows that the target holds with the same content, a copy those of known keys. At
    version ``unknown_at`` the target is known to hold none of the keys.
    """
    base = target.snapshot()
    if run in base.runs:
        return base.runs[run]["rows"]
    fresh = conform(rows, base.schema)
    if job.keys and base.parts and job.on_duplicate != "append" and base.version != unknown_at:
        there = base.read(target.spark)
        if moving and job.on_duplicate == "skip":
            fresh = same_rows(fresh, there, job.keys, base.schema.names, "left_anti")
        elif job.on_duplicate == "skip":
            fresh = new_rows_of_batch(fresh, there, job.keys)
        else:
            fresh = guard_duplicates(fresh, there, job.keys, job.on_duplicate)
    written = target.write(fresh, base.spec, content, small=batch is not None)
    target.verify(written, base.schema)
    while True:
        try:
            target.commit(base.plus(written.parts).noting(run, {"rows": written.rows, **facts}))
            return written.rows
        except CommitConflict:
            later = target.snapshot()
            if run in later.runs:
                return later.runs[run]["rows"]
            # what others added may hold keys of this batch, unless keys don't count
            if job.on_duplicate != "append" or later.spec != base.spec or later.schema != base.schema:
                raise
            base = later


def _check_counts(expected: int, copied: int, before: DataFrame | None, rows, keys) -> None:
    """Every expected row was copied now, or the target held the same row before."""
    if copied == expected:
        return
    there = 0
    if before is not None:
        batch = conform(rows, before.schema)
        there = same_rows(batch, before, keys, before.columns).count()
    outcome, fine = reconcile(expected, there, copied)
    if not fine:
        raise VerificationFailed(
            f"{outcome}: expected {expected}, already there {there}, copied {copied}"
        )


def archive_copy(spark: SparkSession, job: ArchiveJob, run_id=None, content=False) -> RunResult:
    """Copy all matching rows and keep the source. With keys, running again adds nothing."""
    run, started = run_id or new_run_id(), utc_now()
    source, target = Store(spark, job.source), Store(spark, job.target)
    s = source.snapshot()
    rows = s.read(spark).filter(job_predicate(job, s.schema)).drop(*job.exclude)
    target.ensure(rows.schema)
    left = _conflicts(rows, target.snapshot(), job, run)
    odd = 0 if left is None else left.count()
    copied = _load(target, rows, job, run, {"source_version": s.version}, content)
    status = SUCCESS if copied else SKIPPED
    return _result(job, run, "copy", status, started, rows=copied, conflicts=odd)


def _conflicts(rows: DataFrame, t: Snapshot, job: ArchiveJob, run) -> DataFrame | None:
    """Rows whose key the target has with other content; None if there can be none.

    They are never written nor cut out. A run that is taken up again finds the same ones:
    what it has written itself is the same as in the source.
    """
    if not job.keys or not t.parts or job.on_duplicate != "skip":
        return None
    there = within_keys_of(t.read(rows.sparkSession), rows, job.keys)
    return conflicts(rows, there, job.keys, t.schema.names)


# Moves.


def archive_move(spark: SparkSession, job: ArchiveJob, run_id=None, content=False) -> RunResult:
    """Move all matching rows. A row for which the predicate is NULL stays."""
    return _move(spark, job, run_id, content, bounded=False)


def archive_bounded(spark: SparkSession, job: ArchiveJob, run_id=None, content=False):
    """Archive at most ``max_rows`` matching rows, in batches of ``batch_size`` by key order.

    The rows are picked and written in one go; a batch is a number, not a loop. Moves
    when the job deletes its source rows, else copies what the target lacks.
    """
    return _move(spark, job, run_id, content, bounded=True)


def _pick(rows: DataFrame, job: ArchiveJob, file: str, row: str) -> tuple[DataFrame, int | None]:
    """The first ``max_rows`` rows by key, and how many rows there are if that was counted; the
    row address makes the order total."""
    if job.max_rows is None:
        return rows, None
    fallback = (job.filter_column,) if job.filter_column else ()
    order = job.order_by or job.keys or fallback
    return smallest(rows, [*order, file, row], job.max_rows)


def begin_move(spark: SparkSession, job: ArchiveJob, run: str, bounded=False) -> dict:
    """Claim the rows of a move in the source, by one commit; returns what was claimed.

    The claim is a table of bitmaps over the rows of the source's files, which never change.
    It outlives appends and other moves, and rows that one open move has claimed are left out
    by all others. A run that has a claim keeps it. Nothing is claimed if no row matches.
    """
    source, target = Store(spark, job.source), Store(spark, job.target)
    while True:
        s = source.snapshot()
        if run in s.intents or run in s.runs:
            return s.intents.get(run) or s.runs[run]
        t = target.ensure(conform_schema(s, job))
        predicate = job_predicate(job, s.schema)
        file, row = s.address_names()
        chosen = s.addressed(spark, file, row, also_without=s.in_flight()).filter(predicate)
        if job.keys and job.on_duplicate == "skip":
            require_unique(chosen, job.keys)
        odd, known = 0, bool(job.keys and t.parts and job.on_duplicate != "append")
        if known and job.on_duplicate == "skip":
            there = within_keys_of(t.read(spark).select(*job.keys), chosen, job.keys)
            known = not key_lookup(chosen.select(*job.keys), there, job.keys).isEmpty()
        if known and job.on_duplicate == "skip":
            left = _conflicts(chosen, t, job, run)
            left = write_scratch(left.select(file, row), "conflicts")
            odd = left.count()
            if odd:
                chosen = chosen.join(left, [file, row], "left_anti")
        picked, found = _pick(chosen, job, file, row) if bounded else (chosen, None)
        claim = source.write_removal(removals.bitmaps(picked.select(file, row), file, row))
        intent = {
            "rows": [claim.path, claim.spans, claim.rows],
            "version": s.version,
            "target": target.path,
            "target_version": t.version,
            "known_keys": known,  # may the target, at that version, hold keys of these rows?
            "facts": {
                "rows": claim.rows,
                "batches": -(-claim.rows // job.batch_size) if bounded else 1,
                "conflicts": odd,
                "rows_left": 0 if found is None else found - claim.rows,
            },
        }
        if not claim.rows:
            return intent
        try:
            source.commit(replace(s, intents={**s.intents, run: intent}))
            return intent
        except CommitConflict:
            continue  # rows may have come or been claimed: choose again


def conform_schema(s: Snapshot, job: ArchiveJob):
    """Columns that a job writes."""
    return T.StructType([f for f in s.schema if f.name not in job.exclude])


def load_move(spark: SparkSession, job: ArchiveJob, run: str, content=False) -> int:
    """Write the claimed rows to the target, check them and commit; rows written. A run that
    the target has adds nothing."""
    source, target = Store(spark, job.source), Store(spark, job.target)
    intent = source.snapshot().intents[run]
    if run in target.snapshot().runs:
        return target.snapshot().runs[run]["rows"]
    s = source.snapshot(intent["version"])
    claim = Removal(*intent["rows"])
    file, row = s.address_names()
    rows = removals.only(s.addressed(spark, file, row), (claim,), file, row)
    wanted = rows.select(*conform_schema(s, job).names)
    t = target.snapshot()
    before = t.read(spark) if job.keys and t.parts and job.on_duplicate != "append" else None
    small = claim.rows if intent["facts"]["batches"] > 1 else None
    fresh = t.version == intent["target_version"] and not intent["known_keys"]
    copied = _load(
        target, wanted, job, run, {"batches": intent["facts"]["batches"]}, content, small,
        moving=True, unknown_at=t.version if fresh else None,
    )
    _check_counts(claim.rows, copied, before, wanted, job.keys)
    return copied


def finish_move(spark: SparkSession, source: Store, run: str) -> dict:
    """Take the claimed rows of a loaded run out of the source, on whatever its newest version
    is: files are immutable, and nothing rewrites them while a move is open."""
    while True:
        s = source.snapshot()
        if run in s.runs:
            return s.runs[run]
        intent = s.intents[run]
        gone = (*s.removed, Removal(*intent["rows"]))
        empty = _emptied(spark, s, gone)
        changed = s.without(empty).noting(run, intent["facts"])
        intents = {r: i for r, i in s.intents.items() if r != run}
        try:
            source.commit(replace(changed, removed=gone if changed.parts else (), intents=intents))
            return intent["facts"]
        except CommitConflict:
            continue


def _emptied(spark: SparkSession, s: Snapshot, gone) -> list[Part]:
    """Parts, of those whose rows were counted, all of whose rows are gone. A row per folder
    comes back, of which the commit names each anyway."""
    counted = {unquoted(p.path): p for p in s.parts if p.rows is not None and p.files is None}
    if not counted:
        return []
    folders = removals.rows_per_folder(spark, gone).collect()
    lost = {unquoted(r["folder"]): r["rows"] for r in folders}
    return [p for path, p in counted.items() if lost.get(path, 0) >= p.rows]


def unquoted(address: str) -> str:
    """File address (an encoded URI) as the path text Hadoop uses, file:/x if local."""
    text = unquote(address) if address.startswith("file:///") else address
    return "file:/" + text.removeprefix("file:").lstrip("/") if text.startswith("file:") else text


def abandon_move(spark: SparkSession, source: Store, run: str, target: Store) -> None:
    """Give the rows of an open move free again. The run must not be active any more, and is
    finished instead if its rows have reached the target."""
    if target.exists() and run in target.snapshot().runs:
        finish_move(spark, source, run)
        return
    s = source.snapshot()
    source.commit(replace(s, intents={r: i for r, i in s.intents.items() if r != run}))


def settle_moves(spark: SparkSession, source: Store) -> list[str]:
    """Finish the open moves whose rows have reached their target; returns their runs."""
    done = []
    for run, intent in source.snapshot().intents.items():
        target = Store(spark, intent["target"])
        if target.exists() and run in target.snapshot().runs:
            finish_move(spark, source, run)
            done.append(run)
    return done


def _move(spark, job, run_id, content, bounded) -> RunResult:
    """Claim, load, finish. A crash at any point leaves the claim, so the same run id goes on
    where it stopped, and any other run leaves the claimed rows alone: each row arrives once,
    with or without keys, whatever is appended to the source meanwhile."""
    run, started = run_id or new_run_id(), utc_now()
    method = "bounded" if bounded else "move"
    source = Store(spark, job.source)
    if bounded and not job.delete_source:
        return _bounded_copy(spark, job, run, content, started)
    settle_moves(spark, source)
    claimed = begin_move(spark, job, run, bounded)
    facts = claimed.get("facts", claimed)
    if not facts["rows"]:
        return _result(job, run, method, SKIPPED, started, conflicts=facts["conflicts"])
    if run not in source.snapshot().runs:
        try:
            load_move(spark, job, run, content)
        except REFUSALS:  # nothing was committed: the rows are free for the next run
            abandon_move(spark, source, run, Store(spark, job.target))
            raise
        finish_move(spark, source, run)
    return _result(job, run, method, SUCCESS, started, **facts)


def _bounded_copy(spark, job, run, content, started) -> RunResult:
    """The first rows, by key, that the target does not have yet; the source keeps them."""
    source, target = Store(spark, job.source), Store(spark, job.target)
    s = source.snapshot()
    t = target.ensure(conform_schema(s, job))
    if run in t.runs:
        done = t.runs[run]
        facts = {"rows": done["rows"], "batches": done["batches"]}
        return _result(job, run, "bounded", SUCCESS, started, **facts)
    if not job.keys:
        raise ValueError("a bounded copy needs keys to know what was copied")
    file, row = s.address_names()
    matching = s.addressed(spark, file, row).filter(job_predicate(job, s.schema))
    chosen, found = _pick(new_rows(matching, t.read(spark), job.keys), job, file, row)
    expected = chosen.count()
    if not expected:
        return _result(job, run, "bounded", SKIPPED, started)
    batches = -(-expected // job.batch_size)
    facts = {"source_version": s.version, "batches": batches}
    wanted = chosen.select(*conform_schema(s, job).names)
    copied = _load(target, wanted, job, run, facts, content, expected)
    _check_counts(expected, copied, None, wanted, job.keys)
    rest = 0 if found is None else found - expected
    return _result(
        job, run, "bounded", SUCCESS, started, rows=expected, batches=batches, rows_left=rest
    )


# Whole partitions.


def _staging_root(job: ArchiveJob) -> str:
    return f"{job.source}_staging"


def find_staged(spark: SparkSession, job: ArchiveJob, number: int) -> str | None:
    """Newest staging table of a partition that still holds rows, left by a failed run."""
    prefix = f"p{number:05d}-"
    for name in reversed(paths.names(spark, _staging_root(job))):
        if name.startswith(prefix):
            where = f"{_staging_root(job)}/{name}"
            store = Store(spark, where)
            if store.exists() and store.snapshot().parts:
                return where
    return None


def stage_partition(spark: SparkSession, job: ArchiveJob, number: int) -> str | None:
    """Switch a partition into a staging table by commits alone; None if it is empty."""
    s = Store(spark, job.source).snapshot()
    s.require_settled()
    parts = s.of(number)
    if not parts:
        return None
    stamp = utc_now().strftime("%Y%m%d%H%M%S%f")
    where = f"{_staging_root(job)}/p{number:05d}-{stamp}-{new_run_id()}"
    held = tuple(replace(p, pno=None) for p in parts)
    Store(spark, where).commit(Snapshot(0, s.schema, None, held, removed=s.removed))
    return where


def _detach(source: Store, staged: Snapshot) -> None:
    """Take staged parts out of the source, which keeps the folders until they are done with."""
    s = source.snapshot()
    held = {(p.path, p.files) for p in staged.parts}
    still = [p for p in s.parts if (p.path, p.files) in held]
    if still:
        folders = [p.path for p in (*still, *staged.removed)]
        lent = tuple(dict.fromkeys((*s.lent, *folders)))
        source.commit(replace(s.without(still), lent=lent))


def archive_partition(spark: SparkSession, job: ArchiveJob, number: int, content=False):
    """Stage a partition, transfer it, check it, clean up; resumes from staged data.

    Staging changes two small commit files, whatever the size of the partition; the
    source is free of it from then on. Staged rows are given up only once checked.
    """
    started, source, target = utc_now(), Store(spark, job.source), Store(spark, job.target)
    where = find_staged(spark, job, number) or stage_partition(spark, job, number)
    if where is None:
        return _result(job, new_run_id(), "partition", SKIPPED, started, partition_no=number)
    run = where.rsplit("-", 1)[1]
    staging = Store(spark, where)
    staged = staging.snapshot()
    _detach(source, staged)

    rows = staged.read(spark).drop(*job.exclude)
    t = target.ensure(rows.schema)
    expected = rows.count()
    if run not in t.runs:
        left = _conflicts(rows, t, job, run)
        odd = 0 if left is None else left.count()
        if odd:  # staged rows are never given up, so the run fails and can be resumed
            raise ConflictingRows(f"{odd} rows of partition {number} differ from the target's")
        if job.keys and job.on_duplicate == "skip":
            require_unique(rows, job.keys)
    copied = _load(target, rows, job, run, {"partition": number}, content, moving=True)
    if run not in t.runs:
        before = t.read(spark) if job.keys and t.parts else None
        _check_counts(expected, copied, before, rows, job.keys)
    staging.commit(replace(staged, parts=(), removed=()))
    s = source.snapshot()
    done = {p.path for p in (*staged.parts, *staged.removed)}
    source.commit(replace(s, lent=tuple(p for p in s.lent if p not in done)))
    return _result(job, run, "partition", SUCCESS, started, rows=copied, partition_no=number)


# Jobs with a status.


def _dispatch(spark: SparkSession, job: ArchiveJob, run: str) -> RunResult:
    if job.method == "partition":
        return archive_partition(spark, job, job.partition_no)
    if job.method == "copy":
        return archive_copy(spark, job, run)
    if job.method == "move":
        return archive_move(spark, job, run)
    return archive_bounded(spark, job, run)


def run_job(spark: SparkSession, job: ArchiveJob, log: RunLog | None = None, run_id=None):
    """One scheduled run by the job's method: skipped when disabled or empty, failed when
    anything breaks.

    With a log, a job that failed ``max_failures`` times in a row is not tried again until
    a run of it is logged that did not fail.
    """
    started, run = utc_now(), run_id or new_run_id()
    failures = log.failures_in_row(job.name) if log is not None else 0
    if not job.enabled:
        result = _result(job, run, job.method, SKIPPED, started, message="job is disabled")
    elif failures >= job.max_failures:
        # no row in the log: a skipped run would count as one that did not fail
        text = f"disabled after {failures} failures in a row"
        return _result(job, run, job.method, SKIPPED, started, message=text)
    else:
        try:
            result = _dispatch(spark, job, run)
        except Exception as error:  # one bad job must not stop the others
            text = str(error)
            result = _result(job, run, job.method, FAILED, started, message=text)
            _release(spark, job, run)
    if log is not None:
        log.append([result])
    return result


def _release(spark: SparkSession, job: ArchiveJob, run: str) -> None:
    """Free the rows a failed run had claimed, so that the job's next run takes them again."""
    source = Store(spark, job.source)
    if source.exists() and run in source.snapshot().intents:
        abandon_move(spark, source, run, Store(spark, job.target))


def archive_many(spark: SparkSession, jobs, log: RunLog | None = None, at_once=1) -> list[RunResult]:
    """Run jobs, up to ``at_once`` of them side by side, and keep going after a failure.

    Jobs that share a source or a target run one after the other, in the given order; each
    of the others gets a scheduler pool of its own, so a long one doesn't hold up short ones.
    Results come in the order of the jobs.
    """
    jobs = list(jobs)
    if at_once <= 1:
        return [run_job(spark, job, log) for job in jobs]
    chains = _chains(jobs)
    log_lock = Lock()

    def run_chain(places: list[int]) -> list[tuple[int, RunResult]]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"archive-{places[0]}")
        done = []
        for i in places:
            done.append((i, run_job(spark, jobs[i], _Locked(log, log_lock) if log else None)))
        return done

    with ThreadPoolExecutor(at_once) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(run_chain), c) for c in chains]
        found = dict(pair for r in runs for pair in r.result())
    return [found[i] for i in range(len(jobs))]


def _chains(jobs) -> list[list[int]]:
    """Places of the jobs, those connected by a table together."""
    chains: list[tuple[set, list[int]]] = []
    for i, job in enumerate(jobs):
        tables, places = {job.source.rstrip("/"), job.target.rstrip("/")}, [i]
        for other in [c for c in chains if c[0] & tables]:
            chains.remove(other)
            tables |= other[0]
            places += other[1]
        chains.append((tables, sorted(places)))
    return [places for _, places in chains]


class _Locked:
    """A run log that one thread at a time appends to."""

    def __init__(self, log: RunLog, lock):
        self.log, self.lock = log, lock

    def failures_in_row(self, job: str) -> int:
        with self.lock:
            return self.log.failures_in_row(job)

    def append(self, results) -> None:
        with self.lock:
            self.log.append(results)


def summarise(log_rows: DataFrame) -> DataFrame:
    """Tasks, successes, failures and rows of the successes of a run log."""
    good = log_rows.withColumn("_ok", F.col("status").isin(SUCCESS, SKIPPED))
    return batch_summary(good, succeeded="_ok", rows="rows")
