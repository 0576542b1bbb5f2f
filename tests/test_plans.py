"""Physical-plan properties that matter at scale."""

import pytest

from citylens.plans import registry
from citylens.operators import freq_within_top_groups, top_k_per_group
from citylens.plans import taxi
from citylens.sources import views as V
from tests.conftest import SF01


def executed(df) -> str:
    df.collect()  # small results only: runs this DataFrame's own query execution
    return df._jdf.queryExecution().executedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_filter_reaches_parquet_scan(spark):
    plan = physical(taxi.QUERIES["clean_trips"](spark, SF01))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1997-11-01T00:00)" in plan
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01T00:00)" in plan


def test_column_pruning(spark):
    plan = physical(registry()["top_codes"](spark, SF01))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_top_k_per_group_uses_window_group_limit(spark):
    binned = registry()["time_bin_left"](spark, SF01)
    df = top_k_per_group(binned.select("bin", "violation_code"), "bin", "violation_code", 3)
    assert "WindowGroupLimit" in physical(df)


def test_rule_counts_scan_each_table_once(spark):
    plan = physical(registry()["rule_counts_by_vendor"](spark, SF01))
    assert plan.count("FileScan parquet") == 2  # lineitem and orders, one scan each
    assert "Expand" in plan  # unpivot of the one aggregate row per vendor


def test_top_k_broadcast_side_is_bounded(spark):
    t = V.tickets(spark, SF01)
    plan = physical(freq_within_top_groups(t, "issuer_precinct", "violation_code", 3))
    i = plan.index("BroadcastExchange")
    assert "TakeOrderedAndProject(limit=3" in plan[i:]


def test_share_total_reuses_the_shuffle(spark):
    plan = executed(registry()["tip_bucket_share"](spark, SF01))
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(registry()))
def test_no_cross_join_no_python_udf(spark, name):
    df = registry()[name](spark, SF01)
    plan = df._jdf.queryExecution().optimizedPlan().toString() + physical(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Join Cross"):
        assert bad not in plan, f"{name}: {bad}"


def final_plan(df) -> str:
    df.collect()
    ep = df._jdf.queryExecution().executedPlan()
    return ep.executedPlan().toString()  # AQE's final plan (runtime reuse visible)


@pytest.mark.parametrize(
    "name,table",
    [
        ("codes_in_top_precincts", "lineitem"),
        ("codes_in_top_precincts_pooled", "lineitem"),
        ("stacked_precinct_codes", "lineitem"),
        ("top_bins_per_code", "events"),
    ],
)
def test_busiest_groups_scan_raw_rows_once(spark, name, table):
    plan = final_plan(registry()[name](spark, SF01))
    assert plan.count(f"/{table}.parquet]") == 1, plan
    assert "ReusedExchange" in plan


def test_compare_years_aggregates_once(spark):
    plan = final_plan(registry()["yearly_comparison"](spark, SF01))
    assert plan.count("/lineitem.parquet]") == 1
    assert "Window" in plan


@pytest.mark.parametrize("name", sorted(n for n in registry() if not n.startswith(("csv_", "stream_", "materialize"))))
def test_only_bounded_broadcasts_when_no_table_is_small(spark, name):
    from tools.plan_report import broadcast_sides

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(registry()[name](spark, SF01))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(bounded for bounded, _ in broadcast_sides(plan)), plan


def test_tickets_deal_the_large_table_twice(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(V.tickets(spark, SF01))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # orders meet customers below: two joins, so two exchanges, stand above the large table's scan
    assert plan.count("SortMergeJoin") == 3
    lines = plan.splitlines()
    (at,) = [i for i, line in enumerate(lines) if "l_orderkey" in line and "FileScan" in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, level = 0, depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above += "Exchange hashpartitioning" in line
    assert above == 2


def test_date_text_is_parsed_once(spark):
    plan = physical(registry()["date_parts"](spark, SF01))
    assert plan.count("gettimestamp") + plan.count("try_to_date") <= 1


def test_holiday_ranges_reach_the_scan(spark):
    plan = physical(registry()["speed_by_day"](spark, SF01))
    assert "1997-12-25" in plan.split("PushedFilters")[1] + plan.split("PushedFilters")[2]


def test_yearly_comparison_expands_nothing(spark):
    assert "Expand" not in physical(registry()["yearly_comparison"](spark, SF01))


def test_exact_percentiles_hold_no_group(spark):
    import numpy as np

    from citylens.operators import exact_percentiles

    values = [float(v) for v in np.random.default_rng(1).integers(0, 900, 5000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    row = exact_percentiles(df, "v", [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]).first()
    want = np.percentile(values[:-1], [0, 10, 25, 50, 99.9, 100])
    assert list(row) == pytest.approx(want.tolist())
    assert "percentile" not in physical(registry()["tip_percentiles_exact"](spark, SF01))
    assert exact_percentiles(df.filter("false"), "v", [0.5]).first()[0] is None
