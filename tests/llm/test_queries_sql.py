"""Queries that SQL can express, side by side on the smallest tables."""

import os

import pytest
from compare import differences, open_tables

from emberfall.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert differences(queries.QUERIES[name](spark, SF), open_tables(SF), queries.ORACLE_SQL[name]) == []
