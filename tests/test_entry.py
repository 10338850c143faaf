"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry


def test_registry_and_twins():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values()) and all(s.strip() for s in entry.oracle_sql().values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["region", "nation", "urgent", "dearest", "poorest"] and df.count() == 20
