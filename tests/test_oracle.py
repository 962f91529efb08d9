"""Every query of the library against its SQL on the smallest tables."""

import oracle
import pytest

from hopwright import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    oracle.check(spark, name, catalog.QUERIES[name], catalog.SQL[name], SF)


def test_entry_has_all_queries(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
