"""Every query runs on the smallest tables and equals its SQL where it has one."""

import pytest

from areascope.queries import QUERIES
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, _, _ = compare(spark, con, name, FOLDER)
    # held-out and per-group gates may leave nothing at this size, then in the SQL too
    assert verdict in ("ok", "rows only", "EMPTY"), verdict


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
