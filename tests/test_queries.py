"""Every registered query against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, compare, connect

SF = f"{DATA}/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    fn = entry.queries()[name]
    if name in ORACLE:
        problem, _, _ = compare(spark, con, SF, fn, ORACLE[name])
        assert problem is None
    else:
        assert fn(spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
