"""Moves keep every row, survive a crash between any two steps, and can be run again."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frostline.operators.checks import DuplicateRows, RepeatedKeys
from frostline.plans import archive as ar
from frostline.plans.maintain import to_partitioned
from frostline.plans.runs import FAILED, SKIPPED, SUCCESS, RunLog
from frostline.sources.store import SchemaMismatch, Store, VerificationFailed
from frostline.spec import ArchiveJob, PartitionSpec, ValueKind

START = datetime(2024, 1, 1)
TOTAL = 300


@pytest.fixture
def job(spark, tmp_path):
    """Two files of rows; every tenth row has no date, so its predicate is NULL."""
    rows = [
        (i, None if i % 10 == 9 else START + timedelta(days=i), f"row {i}") for i in range(TOTAL)
    ]
    df = spark.createDataFrame(rows, "id bigint, d timestamp_ntz, s string")
    source = Store(spark, str(tmp_path / "source"))
    source.append(df.filter("id < 150").coalesce(1))
    source.append(df.filter("id >= 150").coalesce(1))
    return ArchiveJob(
        "job", source.path, str(tmp_path / "target"), filter_column="d",
        where="< '2024-04-10'", keys=("id",), batch_size=10, max_rows=40,
    )


OLD = {i for i in range(100) if i % 10 != 9}


def ids(spark, path, version=None):
    store = Store(spark, path)
    if not store.exists():
        return []
    return sorted(r.id for r in store.read(version=version).select("id").collect())


def check_conserved(spark, job):
    source, target = ids(spark, job.source), ids(spark, job.target)
    assert sorted(source + target) == list(range(TOTAL))
    return source, target


def test_copy_is_idempotent(spark, job):
    assert ar.archive_copy(spark, job).rows == len(OLD)
    assert ar.archive_copy(spark, job).status == SKIPPED
    assert set(ids(spark, job.target)) == OLD
    assert len(ids(spark, job.source)) == TOTAL


def test_copy_fails_on_duplicates_if_asked(spark, job):
    ar.archive_copy(spark, job)
    with pytest.raises(DuplicateRows):
        ar.archive_copy(spark, replace(job, on_duplicate="fail"))


def test_move_conserves_rows_and_keeps_null_rows(spark, job):
    before = Store(spark, job.source).snapshot()
    result = ar.archive_move(spark, job, content=True)
    source, target = check_conserved(spark, job)
    assert result.rows == len(OLD) and set(target) == OLD
    assert {9, 19, 299} <= set(source)
    # The file without a match is kept as it was.
    after = Store(spark, job.source).snapshot()
    assert before.parts[1] in after.parts
    assert ids(spark, job.source, before.version) == list(range(TOTAL))  # old readers


def test_move_again_finds_nothing(spark, job):
    ar.archive_move(spark, job, "r1")
    assert ar.archive_move(spark, job, "r1").rows == len(OLD)  # recorded result
    assert ar.archive_move(spark, job, "r2").status == SKIPPED
    check_conserved(spark, job)


def test_whole_file_moves_without_a_rewrite(spark, job):
    everything = replace(job, where="d IS NULL OR d IS NOT NULL")
    ar.archive_move(spark, everything)
    assert ids(spark, job.source) == []
    assert ids(spark, job.target) == list(range(TOTAL))


def test_move_without_keys_keeps_equal_rows(spark, tmp_path):
    source = Store(spark, str(tmp_path / "s"))
    source.append(spark.createDataFrame([(1, "a")] * 5 + [(2, "b")] * 3, "k int, s string"))
    job = ArchiveJob("j", source.path, str(tmp_path / "t"), filter_column="k", where="= 1")
    ar.archive_move(spark, job)
    assert Store(spark, job.target).read().count() == 5
    assert source.read().count() == 3


def test_bounded_without_unique_keys_moves_exactly_the_limit(spark, tmp_path):
    source = Store(spark, str(tmp_path / "s"))
    source.append(spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 3, "k int, s string"))
    job = ArchiveJob("j", source.path, str(tmp_path / "t"), filter_column="k", where="= 1",
                     batch_size=10, max_rows=20)
    assert ar.archive_bounded(spark, job).batches == 2
    assert Store(spark, job.target).read().count() == 20
    assert source.read().count() == 33


def test_bounded_runs_in_key_order(spark, job):
    result = ar.archive_bounded(spark, job)
    assert (result.rows, result.batches) == (40, 4)
    assert set(ids(spark, job.target)) == set(sorted(OLD)[:40])
    check_conserved(spark, job)
    rows = [ar.archive_bounded(spark, job).rows for _ in range(3)]
    assert rows == [40, 10, 0]
    assert set(ids(spark, job.target)) == OLD


def test_bounded_takes_the_given_order(spark, job):
    ar.archive_bounded(spark, replace(job, keys=("s",), order_by=("d", "id")))
    assert ids(spark, job.target) == sorted(OLD)[:40]
    check_conserved(spark, job)


def test_bounded_copy_goes_on_where_it_stopped(spark, job):
    copy = replace(job, delete_source=False)
    rows = [ar.archive_bounded(spark, copy).rows for _ in range(4)]
    assert rows == [40, 40, 10, 0]
    assert len(ids(spark, job.source)) == TOTAL
    assert ids(spark, job.target) == sorted(OLD)


def test_excluded_columns_stay_behind(spark, job):
    ar.archive_move(spark, replace(job, exclude=("s",)))
    assert Store(spark, job.target).read().columns == ["id", "d"]
    check_conserved(spark, job)


def test_job_needs_a_filter(spark, job):
    with pytest.raises(ValueError):
        ar.archive_move(spark, replace(job, where=None))


class Crash(Exception):
    pass


def crash_at(monkeypatch, method, nth):
    """Make the n-th call of a store method fail, before or instead of its effect."""
    calls = {"n": 0}
    real = getattr(Store, method)

    def failing(self, *args, **kwargs):
        calls["n"] += 1
        if calls["n"] == nth:
            raise Crash(f"{method} {nth}")
        return real(self, *args, **kwargs)

    monkeypatch.setattr(Store, method, failing)


@pytest.mark.parametrize("run", [ar.archive_move, ar.archive_bounded])
@pytest.mark.parametrize("mode", ["skip", "append"])
@pytest.mark.parametrize(
    "method, nth", [("write_removal", 1), ("commit", 2), ("write", 1), ("verify", 1), ("commit", 3), ("commit", 4)],
)
def test_crash_then_resume(spark, job, monkeypatch, run, method, nth, mode):
    job = replace(job, on_duplicate=mode)
    with monkeypatch.context() as patched:
        crash_at(patched, method, nth)
        with pytest.raises(Crash):
            run(spark, job, "r1")
    kept = ids(spark, job.source) + ids(spark, job.target)
    assert set(kept) == set(range(TOTAL))  # nothing is lost at any point
    wanted = 40 if run is ar.archive_bounded else len(OLD)
    assert run(spark, job, "r1").rows == wanted
    source, target = check_conserved(spark, job)
    assert target == sorted(OLD)[:wanted]


def late_row(spark):
    return spark.createDataFrame([(1000, START, "late")], "id bigint, d timestamp_ntz, s string")


@pytest.mark.parametrize("mode", ["skip", "append"])
@pytest.mark.parametrize("nth", [2, 3, 4])
def test_each_row_arrives_once_though_the_source_grows(spark, job, monkeypatch, nth, mode):
    """The source is appended to after a crash; the run goes on, others leave its rows alone."""
    job = replace(job, on_duplicate=mode)
    with monkeypatch.context() as patched:
        crash_at(patched, "commit", nth)
        with pytest.raises(Crash):
            ar.archive_move(spark, job, "r1")
    Store(spark, job.source).append(late_row(spark))
    claimed = nth > 2
    result = ar.archive_move(spark, job, "r2")
    assert result.rows == (1 if claimed else len(OLD) + 1)
    assert ar.archive_move(spark, job, "r1").rows == (len(OLD) if claimed else 0)
    assert ids(spark, job.target) == sorted(OLD | {1000})
    assert ids(spark, job.source) == sorted(set(range(TOTAL)) - OLD)
    assert Store(spark, job.source).snapshot().intents == {}


def test_two_bounded_runs_share_no_row(spark, job):
    job = replace(job, on_duplicate="append")
    claims = [ar.begin_move(spark, job, run, bounded=True)["facts"]["rows"] for run in ("a", "b", "c")]
    assert claims == [40, 40, 10]
    for run in ("b", "a", "c"):
        assert ar.archive_bounded(spark, job, run).status == SUCCESS
    assert ids(spark, job.target) == sorted(OLD)
    check_conserved(spark, job)


def test_open_moves_stop_maintenance_and_can_be_abandoned(spark, job):
    from frostline.plans.maintain import compact
    from frostline.sources.store import UnsettledMove

    source, target = Store(spark, job.source), Store(spark, job.target)
    ar.begin_move(spark, job, "r1")
    spec = PartitionSpec("id", ValueKind.BIGINT, (100,))
    for change in (lambda: to_partitioned(spark, job.source, spec), lambda: compact(spark, job.source)):
        with pytest.raises(UnsettledMove):
            change()
    ar.abandon_move(spark, source, "r1", target)
    assert source.snapshot().intents == {} and len(ids(spark, job.source)) == TOTAL
    ar.begin_move(spark, job, "r2")
    ar.load_move(spark, job, "r2")
    ar.abandon_move(spark, source, "r2", target)  # too late: it is finished instead
    check_conserved(spark, job)
    assert ids(spark, job.target) == sorted(OLD)


def test_moves_write_no_source_file_and_compacting_drops_the_rows(spark, job):
    from frostline.plans.maintain import compact

    source = Store(spark, job.source)
    before = source.snapshot()
    for _ in range(3):
        ar.archive_bounded(spark, job)
    after = source.snapshot()
    assert after.parts == before.parts and sum(r.rows for r in after.removed) == len(OLD)
    to_partitioned(spark, job.source, PartitionSpec("id", ValueKind.BIGINT, (50,)))
    assert source.snapshot().removed == ()
    ar.archive_move(spark, replace(job, where="< '2024-05-01'"))
    left = ids(spark, job.source)
    assert compact(spark, job.source) > 0 and compact(spark, job.source) == 0
    assert ids(spark, job.source) == left and source.snapshot().removed == ()
    source.reclaim()
    assert ids(spark, job.source) == left
    check_conserved(spark, job)


def test_many_small_files_and_no_row_per_file_on_the_driver(spark, tmp_path, monkeypatch):
    source = Store(spark, str(tmp_path / "s"))
    source.append(spark.range(0, 6000, 1, 600).withColumnRenamed("id", "k"))
    job = ArchiveJob("j", source.path, str(tmp_path / "t"), filter_column="k", where="< 3000",
                     batch_size=100, max_rows=1000, keys=("k",))
    from pyspark.sql.classic.dataframe import DataFrame

    taken, real = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: taken.append(real(self)) or taken[-1])
    assert ar.archive_bounded(spark, job).rows == 1000
    assert ar.archive_move(spark, job).rows == 2000
    assert max(map(len, taken), default=0) <= 2
    assert sorted(r.k for r in real(source.read())) == list(range(3000, 6000))
    assert source.snapshot().to_json().count("part-") == 0


# Whole partitions.


@pytest.fixture
def parted(spark, job):
    spec = PartitionSpec("id", ValueKind.BIGINT, (100, 200))
    to_partitioned(spark, job.source, spec)
    return job


def test_partition_archive(spark, parted):
    result = ar.archive_partition(spark, parted, 2, content=True)
    source, target = check_conserved(spark, parted)
    assert result.rows == 100 and target == list(range(100, 200))
    assert ar.archive_partition(spark, parted, 2).status == SKIPPED
    s = Store(spark, parted.source)
    assert s.snapshot().lent == ()
    s.reclaim()
    assert s.read().count() == 200


def test_reclaim_spares_staged_folders(spark, parted):
    where = ar.stage_partition(spark, parted, 2)
    ar._detach(Store(spark, parted.source), Store(spark, where).snapshot())
    Store(spark, parted.source).reclaim()
    assert ar.archive_partition(spark, parted, 2).rows == 100
    check_conserved(spark, parted)


@pytest.mark.parametrize("nth", [1, 2, 3, 4, 5, 6])
def test_partition_crash_then_resume(spark, parted, monkeypatch, nth):
    with monkeypatch.context() as patched:
        crash_at(patched, "commit", nth)
        try:
            ar.archive_partition(spark, parted, 1)
        except Crash:
            pass
    staged = ar.find_staged(spark, parted, 1)
    kept = ids(spark, parted.source) + ids(spark, parted.target)
    if staged:
        kept += ids(spark, staged)
    assert set(kept) == set(range(TOTAL))
    ar.archive_partition(spark, parted, 1)
    _, target = check_conserved(spark, parted)
    assert target == list(range(100))


def test_duplicates_stop_a_partition_and_keep_it_staged(spark, parted):
    strict = replace(parted, on_duplicate="fail")
    rows = Store(spark, parted.source).read().filter("id < 5")
    Store(spark, parted.target).append(rows)
    with pytest.raises(DuplicateRows):
        ar.archive_partition(spark, strict, 1)
    assert len(ids(spark, ar.find_staged(spark, parted, 1))) == 100
    assert ar.archive_partition(spark, parted, 1).rows == 95  # skip what is there
    assert ids(spark, parted.target) == list(range(100))


def test_lost_rows_are_noticed(spark, parted, monkeypatch):
    real = Store.write

    def lossy(self, df, *args, **kwargs):
        return real(self, df.filter(F.col("id") != 3), *args, **kwargs)

    monkeypatch.setattr(Store, "write", lossy)
    with pytest.raises(VerificationFailed):
        ar.archive_partition(spark, parted, 1)
    assert ar.find_staged(spark, parted, 1) is not None


# Jobs with a status and the run log.


def test_many_jobs_keep_going(spark, job, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    jobs = [
        replace(job, name="bad", where="< 1; --"),
        replace(job, name="off", enabled=False),
        job,
        replace(job, name="empty", where="< '1990-01-01'"),
    ]
    results = ar.archive_many(spark, jobs, log)
    assert [r.status for r in results] == [FAILED, SKIPPED, SUCCESS, SKIPPED]
    assert [r.rows for r in results] == [0, 0, 40, 0]
    total = ar.summarise(log.read()).first()
    assert (total.tasks, total.success, total.failed, total.rows) == (4, 3, 1, 40)
    saved = log.read().filter("job = 'job'").first()
    assert saved.throughput > 0 and saved.batches == 4 and saved.run_date is not None


def test_streak_comes_from_the_run_log(spark, job, tmp_path):
    from frostline.operators.runlog import failure_streak

    log = RunLog(spark, str(tmp_path / "runs"))
    bad = replace(job, where="< 1; --", max_failures=2)
    for _ in range(2):
        ar.run_job(spark, bad, log)
    streaks = failure_streak(
        log.read(), bad.max_failures, job="job", ts="finished_at", tie="run_id",
        status="status", failed=FAILED, resets=(SUCCESS, SKIPPED),
    )
    assert sorted((r.streak, r.disabled) for r in streaks.collect()) == [(1, False), (2, True)]


def test_odd_paths(spark, tmp_path):
    """Blanks and percent signs in a path survive the detour through file addresses."""
    odd = tmp_path / "a b%20c"
    source = Store(spark, str(odd / "source"))
    source.append(spark.range(20).withColumnRenamed("id", "k"))
    job = ArchiveJob("j", source.path, str(odd / "target"), filter_column="k", where="< 5",
                     batch_size=2, max_rows=3)
    assert ar.archive_bounded(spark, job).rows == 3
    assert ar.archive_move(spark, job).rows == 2
    assert source.read().count() == 15 and Store(spark, job.target).read().count() == 5


@pytest.mark.parametrize(
    "schema", ["id bigint, d timestamp_ntz", "id int, d timestamp_ntz, s string",
               "id bigint, d timestamp_ntz, s string, extra int"],
)
@pytest.mark.parametrize("run", [ar.archive_move, ar.archive_bounded, ar.archive_copy])
def test_other_columns_in_the_target_stop_a_run(spark, job, run, schema):
    Store(spark, job.target).create(spark.createDataFrame([], schema).schema)
    with pytest.raises(SchemaMismatch):
        run(spark, job)
    assert len(ids(spark, job.source)) == TOTAL and ids(spark, job.target) == []


@pytest.mark.parametrize("keys", [(), ("id",)])
def test_source_changed_during_the_copy(spark, job, monkeypatch, keys):
    """Rows that come meanwhile stay; those claimed move."""
    real, calls = Store.verify, []

    def slow(self, *args):
        if not calls:
            calls.append(1)
            Store(spark, job.source).append(late_row(spark))
        return real(self, *args)

    with monkeypatch.context() as patched:
        patched.setattr(Store, "verify", slow)
        ar.archive_move(spark, replace(job, keys=keys))
    assert ids(spark, job.target) == sorted(OLD)
    assert ids(spark, job.source) == sorted((set(range(TOTAL)) - OLD) | {1000})


@pytest.mark.parametrize("run", [ar.archive_move, ar.archive_bounded])
def test_rows_move_between_partitioned_tables(spark, parted, run):
    """Partitions not touched keep their folders, and every row stays in its partition."""
    spec = PartitionSpec("id", ValueKind.BIGINT, (50, 250))
    Store(spark, parted.target).create(Store(spark, parted.source).snapshot().schema, spec)
    before = {p.pno: p for p in Store(spark, parted.source).snapshot().parts}
    run(spark, replace(parted, order_by=("id",)))
    run(spark, replace(parted, order_by=("id",)))
    _, target = check_conserved(spark, parted)
    assert target == (sorted(OLD) if run is ar.archive_move else sorted(OLD)[:80])
    for path in (parted.source, parted.target):
        snap = Store(spark, path).snapshot()
        for n in range(1, 4):
            low, high = snap.spec.bounds(n)
            for r in snap.read(spark, n).collect():
                assert (low is None or r.id >= low) and (high is None or r.id < high)
    after = Store(spark, parted.source).snapshot().parts
    assert set(before.values()) == set(after)  # no file is written again


def _stores(spark, tmp_path, rows, archived=()):
    source, target = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "t"))
    source.append(spark.createDataFrame(rows, "k bigint, v string"))
    if archived:
        target.append(spark.createDataFrame(archived, "k bigint, v string"))
    return source, target


def _simple(source, target, **given):
    return ArchiveJob(**{**dict(name="j", source=source.path, target=target.path, filter_column="k",
                                where="< 10", keys=("k",), batch_size=1), **given})


def _rows(store):
    return sorted(tuple(r) for r in store.read().collect())


def test_conflicting_row_stays_in_the_source(spark, tmp_path):
    source, target = _stores(spark, tmp_path, [(1, "new"), (2, "same"), (3, "c")], [(1, "old"), (2, "same")])
    result = ar.archive_move(spark, _simple(source, target))
    assert (result.rows, result.conflicts) == (2, 1)
    assert _rows(source) == [(1, "new")]
    assert _rows(target) == [(1, "old"), (2, "same"), (3, "c")]


def test_conflicts_do_not_starve_a_bounded_run(spark, tmp_path):
    source, target = _stores(spark, tmp_path, [(1, "new"), (2, "b"), (3, "c")], [(1, "old")])
    job = _simple(source, target, max_rows=1)
    assert [ar.archive_bounded(spark, job).rows_left for _ in range(2)] == [1, 0]
    assert _rows(source) == [(1, "new")] and len(_rows(target)) == 3


def test_repeated_keys_are_refused_or_appended(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (2, "c"), (3, "d")]
    source, target = _stores(spark, tmp_path, rows)
    with pytest.raises(RepeatedKeys):
        ar.archive_bounded(spark, _simple(source, target, max_rows=2))
    assert _rows(source) == rows
    job = _simple(source, target, max_rows=2, on_duplicate="append")
    ar.archive_bounded(spark, job)
    assert len(_rows(source)) == 2
    ar.archive_bounded(spark, job)
    assert _rows(source) == [] and _rows(target) == rows


def test_conflict_fails_a_partition_and_keeps_its_rows(spark, tmp_path):
    source, target = _stores(spark, tmp_path, [(1, "new"), (20, "x")], [(1, "old")])
    to_partitioned(spark, source.path, PartitionSpec("k", ValueKind.BIGINT, (10,)))
    with pytest.raises(ar.ConflictingRows):
        ar.archive_partition(spark, _simple(source, target), 1)
    with pytest.raises(ar.ConflictingRows):  # the staged rows are still there
        ar.archive_partition(spark, _simple(source, target), 1)
    assert _rows(target) == [(1, "old")]
    assert _rows(Store(spark, ar.find_staged(spark, _simple(source, target), 1))) == [(1, "new")]
