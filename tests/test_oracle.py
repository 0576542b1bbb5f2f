"""Every registered query against its DuckDB oracle at sf0.01 (exact values, types, row multiset)."""

import pytest

import __spark_entry__ as E
from citylens.plans import registry
from citylens.plans.oracle import ORACLE as CITY_ORACLE
from tests.conftest import SF01
from tools.oracle_check import compare, duck

QUERIES = registry()
ORACLE = CITY_ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    problems, _, _ = compare(spark, con, name, QUERIES[name], ORACLE[name], SF01)
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["bin", "violation_code", "count", "rank"]
    assert len(rows) >= 18 and all(r["rank"] <= 3 for r in rows)


TIME_DEPENDENT = ["clock_hours", "clock_hours_lenient", "speed_by_month", "date_parts", "csv_trips", "materialize", "top_codes_per_bin"]


@pytest.mark.parametrize("name", TIME_DEPENDENT)
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        problems, _, _ = compare(spark, con, name, QUERIES[name], ORACLE[name], SF01)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert not problems, problems
