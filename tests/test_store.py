import pytest
from pyspark.sql import functions as F

from frostline.sources.store import CommitConflict, Store, VerificationFailed, Written
from frostline.spec import PartitionSpec, ValueKind

SPEC = PartitionSpec("k", ValueKind.BIGINT, (10, 20))


@pytest.fixture
def where(tmp_path):
    return str(tmp_path / "t")


def numbers(spark, n, start=0):
    return spark.range(start, start + n).withColumnRenamed("id", "k")


def keys(df):
    return sorted(r.k for r in df.collect())


def test_append_and_versions(spark, where):
    store = Store(spark, where)
    assert not store.exists()
    assert store.append(numbers(spark, 5)) == 5
    assert store.append(numbers(spark, 5, 100), "run-1", {"note": "x"}) == 5
    assert store.append(numbers(spark, 5, 100), "run-1") == 5  # replay
    assert store.read().count() == 10
    assert keys(store.read(version=2)) == list(range(5))
    assert store.snapshot().runs["run-1"] == {"rows": 5, "note": "x"}


def test_ticks_go_forward_only(spark, where):
    store = Store(spark, where)
    assert store.append(numbers(spark, 2), "s", {"tick": 0}) == 2
    assert store.append(numbers(spark, 2), "s", {"tick": 0}) == 0
    assert store.append(numbers(spark, 2, 5), "s", {"tick": 1}) == 2
    assert store.read().count() == 4
    assert list(store.snapshot().runs) == ["s"]


def test_one_of_two_writers_wins(spark, where):
    store = Store(spark, where)
    store.append(numbers(spark, 3))
    base = store.snapshot()
    store.commit(base.noting("first", {}))
    with pytest.raises(CommitConflict):
        store.commit(base.noting("second", {}))
    assert list(store.snapshot().runs) == ["first"]


def test_create_refuses_an_existing_table(spark, where):
    store = Store(spark, where)
    schema = numbers(spark, 0).schema
    store.create(schema)
    with pytest.raises(CommitConflict):
        store.create(schema)
    assert store.ensure(schema).version == 1
    assert store.read().count() == 0


def test_uncommitted_rows_are_invisible(spark, where):
    store = Store(spark, where)
    store.append(numbers(spark, 3))
    store.write(numbers(spark, 50))  # a writer that died before its commit
    assert store.read().count() == 3
    assert len(store.reclaim()) == 1
    assert store.read().count() == 3


def test_partitioned_write_and_pruned_read(spark, where, plan):
    store = Store(spark, where)
    store.create(numbers(spark, 0).schema, SPEC)
    store.append(numbers(spark, 30))
    assert [p.pno for p in sorted(store.snapshot().parts, key=lambda p: p.pno)] == [1, 2, 3]
    assert keys(store.read(2)) == list(range(10, 20))
    assert "_pno=2" in plan(store.read(2)) and "_pno=3" not in plan(store.read(2))


def test_dominant_partition_is_split_over_tasks(spark, where):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store = Store(spark, where)
        rows = spark.range(0, 400_000, numPartitions=8).select(
            F.when(F.col("id") % 3 > 0, F.lit(15)).otherwise(F.col("id") % 10).alias("k"),
            F.rand(1).alias("x"),
        )
        rows = rows.withColumn("k", F.col("k").cast("bigint"))
        store.create(rows.schema, SPEC)
        store.append(rows)
        assert store.read().count() == 400_000
        assert len(store.read(2).inputFiles()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_verification_sees_missing_and_changed_rows(spark, where):
    store = Store(spark, where)
    written = store.write(numbers(spark, 10), content=True)
    schema = numbers(spark, 0).schema
    store.verify(written, schema)
    with pytest.raises(VerificationFailed):
        store.verify(Written(written.parts, 11, written.marks), schema)
    with pytest.raises(VerificationFailed):
        store.verify(Written(written.parts, 10, (1, 2)), schema)


def test_sizes(spark, where):
    store = Store(spark, where)
    store.create(numbers(spark, 0).schema, SPEC)
    assert store.sizes().count() == 0
    store.append(numbers(spark, 200_000))
    sizes = {r.partition_number: r.size_mb for r in store.sizes().collect()}
    assert set(sizes) == {1, 2, 3} and sizes[3] > 0.1


def test_adopted_files_are_never_removed(spark, tmp_path):
    numbers(spark, 5).write.parquet(str(tmp_path / "given"))
    store = Store(spark, str(tmp_path / "t"))
    store.adopt(str(tmp_path / "given"))
    assert store.read().count() == 5
    store.commit(store.snapshot().without(store.snapshot().parts))
    store.reclaim()
    assert spark.read.parquet(str(tmp_path / "given")).count() == 5


def test_append_goes_on_after_another_writer(spark, where, monkeypatch):
    store = Store(spark, where)
    store.append(numbers(spark, 3))
    real, calls = Store.verify, []

    def slow(self, *args):
        if not calls:
            calls.append(1)
            store.append(numbers(spark, 2, 50), "other")  # gets in between
        return real(self, *args)

    monkeypatch.setattr(Store, "verify", slow)
    store.append(numbers(spark, 4, 100), "mine")
    assert keys(store.read()) == [0, 1, 2, 50, 51, 100, 101, 102, 103]
    assert set(store.snapshot().runs) == {"other", "mine"}
