"""The queries that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

from codeatlas.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, differ

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert differ(QUERIES[name](spark, DIR), connect(DIR), ORACLE_SQL[name]) == ""
