"""The queries that SQL expresses, on the smallest tables."""

import oracle
import pytest

from hopwright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    oracle.check(spark, name, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.001")
