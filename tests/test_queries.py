"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from codeatlas.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import connect, differ

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert differ(QUERIES[name](spark, DIR), con, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_is_about_rows(name):
    """No query is compared over nothing: its SQL has rows on the tables that the comparison is made on."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    assert connect(d).execute(f"SELECT count(*) FROM ({ORACLE_SQL[name]})").fetchone()[0] > 0


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["call_id", "callee", "basis"] and found.count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
