from datetime import date, datetime

import pytest

from frostline.spec import (
    ArchiveJob,
    PartitionSpec,
    Retention,
    ValueKind,
    invariant_text,
    literal_text,
    parse_value,
)


def ints(*values, right=True):
    return PartitionSpec("k", ValueKind.INT, values, right)


def test_boundaries_are_sorted_and_deduplicated():
    assert PartitionSpec.of("k", "Int", [30, 10, 20, 10]).boundaries == (10, 20, 30)
    with pytest.raises(ValueError):
        PartitionSpec.of("k", "Int", [])


def test_boundaries_must_rise():
    with pytest.raises(ValueError):
        ints(10, 10)
    with pytest.raises(ValueError):
        ints(20, 10)


def test_append_right_grows_upwards():
    with pytest.raises(ValueError):
        ints(10).append(8)
    assert ints(10).append(12).boundaries == (10, 12)


def test_append_left_grows_downwards():
    with pytest.raises(ValueError):
        ints(10, right=False).append(12)
    assert ints(10, right=False).append(8).boundaries == (8, 10)


def test_split_rejects_duplicates_and_mixed_order():
    assert ints(10, 20).split([15, 12]).boundaries == (10, 12, 15, 20)
    for bad in ([], [15, 12, 14], [15, 15], [20]):
        with pytest.raises(ValueError):
            ints(10, 20).split(bad)


def test_split_at_stays_inside_the_range():
    assert ints(10, 20).split_at("0002", 15).boundaries == (10, 15, 20)
    assert ints(10, 20).split_at("0001", 5).boundaries == (5, 10, 20)
    assert ints(10, 20, right=False).split_at("0002", 25).boundaries == (10, 20, 25)
    with pytest.raises(ValueError):
        ints(10, 20).split_at("0002", 25)
    with pytest.raises(ValueError):
        ints(10, 20, right=False).split_at("0001", 5)


def test_missing_and_merge():
    assert ints(10, 20).missing([30, 20, 5]) == [5, 30]
    assert ints(10, 20, 30).merge("0002").boundaries == (10, 30)
    assert ints(10, 20, 30).merge(30).boundaries == (10, 20)


def test_texts():
    assert literal_text(ValueKind.STRING, "O'Reilly") == "'O''Reilly'"
    assert literal_text(ValueKind.DATE, date(2025, 10, 4)) == "'2025-10-04'"
    assert literal_text(ValueKind.INT, 5) == "5"
    moment = datetime(2025, 1, 2, 3, 4, 5, 678900)
    assert invariant_text(ValueKind.DATETIME, moment) == "2025-01-02 03:04:05"
    assert invariant_text(ValueKind.DATETIME2, moment) == "2025-01-02 03:04:05.6789000"


def test_parse():
    assert parse_value(ValueKind.GUID, "{0000ABCD-0000-4000-8000-000000000001}") == (
        "0000abcd-0000-4000-8000-000000000001"
    )
    for kind, raw in ((ValueKind.INT, "x"), (ValueKind.INT, str(2**31)), (ValueKind.DATE, " ")):
        with pytest.raises(ValueError):
            parse_value(kind, raw)


def test_strings_order_by_bytes():
    spec = PartitionSpec.of("k", "String", ["b", "B", "é", "z"])
    assert spec.boundaries == ("B", "b", "z", "é")


def test_round_trip():
    spec = PartitionSpec("d", ValueKind.DATETIME2, ("2024-01-01", "2024-02-01 10:00:00"), False)
    assert PartitionSpec.from_dict(spec.to_dict()) == spec


def test_job_and_retention_limits():
    with pytest.raises(ValueError):
        ArchiveJob("j", "a", "b", batch_size=0)
    with pytest.raises(ValueError):
        ArchiveJob("j", "a", "b", batch_size=10, max_rows=5)
    with pytest.raises(ValueError):
        ArchiveJob(" ", "a", "b")
    with pytest.raises(ValueError):
        Retention()
    with pytest.raises(ValueError):
        Retention(keep_latest=1, keep_days=1)
