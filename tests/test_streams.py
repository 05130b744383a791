import os
from datetime import datetime, timedelta

import pytest

from frostline.operators.runlog import logs_since
from frostline.sources.store import Store
from frostline.spec import ArchiveJob
from frostline.streaming import streams

START = datetime(2024, 1, 1)
SCHEMA = "id bigint, ts timestamp_ntz, st string"


def drop(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def entries(a, b):
    return [(i, START + timedelta(hours=i), "run") for i in range(a, b)]


@pytest.fixture
def job(tmp_path):
    return ArchiveJob("j", "unused", str(tmp_path / "target"), filter_column="ts",
                      where="< '2024-01-03'", keys=("id",))


def run(spark, folder, job, checkpoint):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = streams.file_stream(spark, folder, schema, files_per_tick=1)
    streams.archive_stream(stream, job, checkpoint).awaitTermination()


def test_stream_equals_batch_and_goes_on(spark, tmp_path, job):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    drop(spark, folder, entries(0, 30))
    drop(spark, folder, entries(20, 60))  # overlaps
    run(spark, folder, job, checkpoint)
    target = Store(spark, job.target)
    assert sorted(r.id for r in target.read().collect()) == list(range(48))
    drop(spark, folder, [(100, START, "late")])
    run(spark, folder, job, checkpoint)
    run(spark, folder, job, checkpoint)
    assert target.read().count() == 49


def test_replayed_tick_adds_nothing(spark, tmp_path, job, monkeypatch):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    no_keys = ArchiveJob("j", "unused", job.target, filter_column="ts", where=job.where)
    drop(spark, folder, entries(0, 10))
    real = Store.append

    def dies_after_commit(self, *args, **kwargs):
        real(self, *args, **kwargs)
        raise RuntimeError("crash")

    with monkeypatch.context() as patched:
        patched.setattr(Store, "append", dies_after_commit)
        with pytest.raises(Exception):
            run(spark, folder, no_keys, checkpoint)
    run(spark, folder, no_keys, checkpoint)
    assert Store(spark, job.target).read().count() == 10


def test_stale_tasks_are_reported_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    minute = lambda m: START + timedelta(minutes=m)
    schema = "id bigint, ts timestamp, st string"
    drop(spark, folder, [(1, minute(m), "run") for m in (0, 2, 4)], schema)
    drop(spark, folder, [(1, minute(20), "run"), (2, minute(1), "done")], schema)
    drop(spark, folder, [(3, minute(m), "run") for m in range(0, 62, 4)], schema)
    stream = streams.file_stream(spark, folder, spark.createDataFrame([], schema).schema)
    stale = streams.stale_stream(stream, task="id", ts="ts", status="st", terminal=("done",),
                                 delay="0 seconds")
    query = (
        stale.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.schema(stale.schema).parquet(str(tmp_path / "out")).collect()
    found = sorted((r.id, r.last_heartbeat, r.heartbeats) for r in got)
    assert found == [(1, minute(4), 3), (1, minute(20), 1)]  # task 3 is alive


def test_tail_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop(spark, folder, entries(0, 30))
    schema = spark.createDataFrame([], SCHEMA).schema
    since = START + timedelta(hours=10)
    tail = streams.tail_logs(
        streams.file_stream(spark, folder, schema), ts="ts", task="run", task_column="st",
        since=since,
    )
    query = tail.writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = logs_since(
        spark.read.parquet(folder), "run", since, task_column="st", ts="ts", entry="id"
    )
    assert sorted(r.id for r in spark.table("tail").collect()) == [r.id for r in batch.collect()]


def test_tables_stream_as_a_file_or_a_folder(spark, tmp_path):
    """A folder of part files in any order of time gives the same as one file."""
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = spark.createDataFrame(entries(0, 120), SCHEMA)
    folder, single = str(tmp_path / "many.parquet"), str(tmp_path / "one")
    rows.repartition(9).write.parquet(folder)
    rows.coalesce(1).write.parquet(single)
    (part,) = [f for f in os.listdir(single) if f.endswith(".parquet")]
    for name, path in (("many", folder), ("one", f"{single}/{part}")):
        stream = streams.table_stream(spark, path, schema, 2)
        query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r.id for r in spark.table(name).collect()) == list(range(120))


@pytest.fixture
def mover(spark, tmp_path):
    job = ArchiveJob("m", str(tmp_path / "source"), str(tmp_path / "moved"), filter_column="ts",
                     where="< '2024-01-03'", batch_size=5, max_rows=10, on_duplicate="append",
                     order_by=("id",))
    Store(spark, job.source).append(spark.createDataFrame(entries(0, 40), SCHEMA))
    return job


def sides(spark, job):
    return [sorted(r.id for r in Store(spark, p).read().collect()) for p in (job.source, job.target)]


def test_moving_stream_follows_the_commits(spark, tmp_path, mover):
    """Two rounds of appends; each matching row moves once, a bounded move at a time."""
    checkpoint = str(tmp_path / "cp")
    streams.move_stream(spark, mover, checkpoint).awaitTermination()
    assert sides(spark, mover) == [[], list(range(40))]
    moves = [r for r in Store(spark, mover.target).snapshot().runs.values()]
    assert [m["rows"] for m in moves] == [10] * 4
    Store(spark, mover.source).append(spark.createDataFrame(entries(40, 60), SCHEMA))
    for _ in range(2):
        streams.move_stream(spark, mover, checkpoint).awaitTermination()
    assert sides(spark, mover) == [list(range(48, 60)), list(range(48))]


@pytest.mark.parametrize("step", ["load_move", "finish_move"])
def test_replayed_tick_goes_on_with_its_moves(spark, tmp_path, mover, monkeypatch, step):
    """No keys: only the run ids keep a tick that died in its second move from adding twice."""
    from frostline.plans import archive

    checkpoint, calls, real = str(tmp_path / "cp"), [], getattr(archive, step)

    def dies(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("crash")
        return real(*args, **kwargs)

    with monkeypatch.context() as patched:
        patched.setattr(archive, step, dies)
        with pytest.raises(Exception):
            streams.move_stream(spark, mover, checkpoint).awaitTermination()
    Store(spark, mover.source).append(spark.createDataFrame(entries(40, 50), SCHEMA))
    for _ in range(2):
        streams.move_stream(spark, mover, checkpoint).awaitTermination()
    assert sides(spark, mover) == [[48, 49], list(range(48))]


def test_backlog_of_a_tick_starts_the_next(spark, tmp_path, mover):
    query = streams.move_stream(spark, mover, str(tmp_path / "cp"), "0 seconds", moves_per_tick=1)
    try:
        for _ in range(20):
            query.processAllAvailable()
            if not sides(spark, mover)[0]:
                break
    finally:
        query.stop()
    assert sides(spark, mover) == [[], list(range(40))]
    assert query.lastProgress["batchId"] >= 3
    with pytest.raises(ValueError):
        streams.move_stream(spark, mover, str(tmp_path / "cp"), moves_per_tick=0)


def test_disordered_ticks_report_each_silence_once(spark, tmp_path):
    """A file a tick, beats out of order; one later than the delay is dropped."""
    folder = str(tmp_path / "in")
    minute = lambda m: START + timedelta(minutes=m)
    schema = "id bigint, ts timestamp, st string"
    ticks = [
        [(1, 4), (2, 0), (1, 0)],
        [(1, 2), (1, 20), (2, 3)],  # 20 closes nothing yet: the delay is 15 minutes
        [(1, 23), (2, 45), (1, 21)],  # 45 closes what ended by 30
        [(2, 46), (1, 80)],
        [(3, 81), (1, 1), (2, 79)],  # the beat of minute 1 is too late
    ]
    for tick in ticks:
        drop(spark, folder, [(i, minute(m), "run") for i, m in tick], schema)
    stream = streams.file_stream(spark, folder, spark.createDataFrame([], schema).schema, 1)
    stale = streams.stale_stream(stream, task="id", ts="ts", status="st", delay="15 minutes")
    query = (
        stale.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.schema(stale.schema).parquet(str(tmp_path / "out")).collect()
    found = sorted((r.id, r.last_heartbeat, r.heartbeats) for r in got)
    assert found == [(1, minute(4), 3), (1, minute(23), 3), (2, minute(3), 2), (2, minute(46), 2)]
