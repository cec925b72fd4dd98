"""Every registered query against its SQL on the smallest tables."""
from pathlib import Path

import pytest

import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not there")


def _names():
    import __spark_entry__ as entry

    return sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    import __spark_entry__ as entry

    ok, message = oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert ok, message


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
