"""The registered queries: names, and those that SQL can express against DuckDB."""

import pytest

import __spark_entry__ as E
from citylens.llm.queries import ORACLE, QUERIES
from tests.conftest import SF01
from tools.oracle_check import compare, duck


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, len(QUERIES) + 1))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    problems, _, _ = compare(spark, duck(SF01), name, QUERIES[name], ORACLE[name], SF01)
    assert not problems, problems
