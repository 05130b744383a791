import pytest
from pyspark.sql import functions as F

from frostline.plans import maintain as mt
from frostline.sources.store import Store
from frostline.spec import PartitionSpec, ValueKind

SPEC = PartitionSpec("k", ValueKind.BIGINT, (10, 20, 30))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    s.append(spark.range(40).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    return s


def layout(store):
    snap = store.snapshot()
    return {
        n: sorted(r.k for r in store.read(n).collect())
        for n in range(1, snap.spec.partition_count + 1)
    }


def span(*edges):
    return {i: list(range(a, b)) for i, (a, b) in enumerate(zip(edges, edges[1:]), 1)}


def test_convert_once(spark, store):
    assert mt.to_partitioned(spark, store.path, SPEC)
    assert layout(store) == span(0, 10, 20, 30, 40)
    assert not mt.to_partitioned(spark, store.path, SPEC)
    assert not mt.to_partitioned(spark, store.path, SPEC.merge(10))
    with pytest.raises(mt.Refused):
        mt.to_partitioned(spark, store.path, PartitionSpec("v", ValueKind.STRING, ("m",)))


def test_sync_converts_then_adds_what_is_missing(spark, store):
    assert mt.sync_boundaries(spark, store.path, SPEC) == []
    assert mt.sync_boundaries(spark, store.path, SPEC) == []
    assert mt.sync_boundaries(spark, store.path, SPEC.split([25])) == [25]
    assert layout(store) == span(0, 10, 20, 25, 30, 40)


def test_null_keys_block_a_not_null_column(spark, tmp_path):
    store = Store(spark, str(tmp_path / "n"))
    store.append(spark.createDataFrame([(None,), (5,)], "k bigint"))
    strict = PartitionSpec("k", ValueKind.BIGINT, (3,), nullable=False)
    with pytest.raises(mt.Refused):
        mt.to_partitioned(spark, store.path, strict)
    assert mt.to_partitioned(spark, store.path, PartitionSpec("k", ValueKind.BIGINT, (3,)))
    assert [r.k for r in store.read(1).collect()] == [None]


@pytest.mark.parametrize("right", [True, False])
def test_split_rewrites_only_what_it_cuts(spark, store, right):
    spec = PartitionSpec("k", ValueKind.BIGINT, (10, 20, 30), right)
    mt.to_partitioned(spark, store.path, spec)
    before = {p.path for p in store.snapshot().parts}
    mt.apply_split(spark, store.path, [15, 35])
    shift = 0 if right else 1
    edges = [0, *(e + shift for e in (10, 15, 20, 30, 35)), 40]
    assert layout(store) == span(*edges)
    kept = {p.path for p in store.snapshot().parts} & before
    assert len(kept) == 2


def test_merge_moves_no_data(spark, store):
    mt.to_partitioned(spark, store.path, SPEC)
    before = {p.path for p in store.snapshot().parts}
    mt.apply_merge(spark, store.path, 20)
    assert layout(store) == span(0, 10, 30, 40)
    assert {p.path for p in store.snapshot().parts} == before


def test_merge_guard(spark, store):
    mt.to_partitioned(spark, store.path, PartitionSpec("k", ValueKind.BIGINT, (10, 100)))
    with pytest.raises(mt.Refused):
        mt.apply_merge(spark, store.path, 100)
    mt.apply_merge(spark, store.path, 100, force=True)
    assert layout(store) == span(0, 10, 40)


def test_split_then_merge_then_split(spark, store):
    mt.to_partitioned(spark, store.path, SPEC)
    mt.apply_merge(spark, store.path, 10)
    mt.apply_split(spark, store.path, [5])
    assert layout(store) == span(0, 5, 20, 30, 40)


def test_switch(spark, store, tmp_path):
    mt.to_partitioned(spark, store.path, SPEC)
    target = Store(spark, str(tmp_path / "dst"))
    target.create(store.snapshot().schema, SPEC)
    assert mt.switch_partition(spark, store.path, target.path, 2, "s1") == 10
    assert layout(target)[2] == list(range(10, 20)) and layout(store)[2] == []
    assert mt.switch_partition(spark, store.path, target.path, 2, "s1") == 10  # replay
    store.reclaim()  # lent folders stay
    assert len(layout(target)[2]) == 10


def test_switch_resumes_between_its_commits(spark, store, tmp_path, monkeypatch):
    mt.to_partitioned(spark, store.path, SPEC)
    target = Store(spark, str(tmp_path / "dst"))
    target.create(store.snapshot().schema)
    real = Store.commit

    def once(self, changed):
        if self.path == store.path:
            raise RuntimeError("crash")
        return real(self, changed)

    with monkeypatch.context() as patched:
        patched.setattr(Store, "commit", once)
        with pytest.raises(RuntimeError):
            mt.switch_partition(spark, store.path, target.path, 1, "s1")
    assert store.read().count() == 40 and target.read().count() == 10
    mt.switch_partition(spark, store.path, target.path, 1, "s1")
    assert store.read().count() == 30 and target.read().count() == 10


def test_switch_refuses(spark, store, tmp_path):
    mt.to_partitioned(spark, store.path, SPEC)
    schema = store.snapshot().schema
    full = Store(spark, str(tmp_path / "full"))
    full.append(store.read().limit(1))
    other = Store(spark, str(tmp_path / "other"))
    other.create(spark.createDataFrame([], "k int, v string").schema)
    shifted = Store(spark, str(tmp_path / "shifted"))
    shifted.create(schema, PartitionSpec("k", ValueKind.BIGINT, (11, 20, 30)))
    for target in (full, other, shifted):
        with pytest.raises(mt.Refused):
            mt.switch_partition(spark, store.path, target.path, 1, "x")
    assert store.read().count() == 40


def test_truncate_needs_confirmation(spark, store):
    mt.to_partitioned(spark, store.path, SPEC)
    with pytest.raises(mt.Refused):
        mt.truncate_partition(spark, store.path, 3)
    assert mt.residual_rows(spark, store.path, 3) == 10
    assert mt.truncate_partition(spark, store.path, 3, confirm=True) == 10
    assert mt.residual_rows(spark, store.path, 3) == 0
    assert store.read().count() == 30
