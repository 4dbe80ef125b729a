"""Every registered query against its SQL on the same tables."""

import pytest

from workloads.compare import compare, connect
from workloads.oracles import ORACLES
from workloads.queries import QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, folder, name):
    assert compare(spark, con, folder, QUERIES[name], ORACLES.get(name)) == ""


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    df = entry(spark)
    assert df.columns == ["section", "subject", "metric", "value", "label"]
    assert df.count() > 0
    assert set(oracle_sql()) <= set(queries())
