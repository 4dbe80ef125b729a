import pytest

from synthtab.llm.oracles import ORACLES
from synthtab.llm.queries import QUERIES
from workloads.compare import compare, connect


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, folder, name):
    assert compare(spark, connect(folder), folder, QUERIES[name], ORACLES[name]) == ""


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
