import pytest
from pyspark.sql import functions as F

from citylens.operators import (
    FINES,
    avg_speed,
    avg_speed_vs_overall,
    bucket_share,
    common_items,
    compare_years,
    count_by,
    distinct_count,
    drop_sparse_columns,
    fine_revenue,
    fine_table,
    fraction_where,
    freq_within_top_groups,
    missing_address,
    normalize_columns,
    null_profile,
    percent_share,
    revenue_total,
    rule_counts,
    select_range,
    sentinel_profile,
    shape_report,
    stack_years,
    stacked_counts,
    summary_percentiles,
    top_bins_for_top_items,
    top_k_per_group,
    top_n,
    top_revenue_code,
    trip_rules,
    worst_offender,
)


def test_top_n_ties_exclude_and_null(spark):
    df = spark.createDataFrame([(c,) for c in [5, 5, 5, 3, 3, 4, 4, 0, 0, 0, 0, None, None, None, None, None]], "c int")
    got = [(r.c, r["count"]) for r in top_n(df, "c", 2, exclude=(0, None)).collect()]
    assert got == [(5, 3), (3, 2)]  # 3 and 4 tie at 2: the lower key wins
    got_all = [(r.c, r["count"]) for r in top_n(df, "c", 1, exclude=()).collect()]
    assert got_all == [(None, 5)]


def test_count_by_of_counts_non_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "k string")
    plain = {r.k: r["count"] for r in count_by(df, "k").collect()}
    of = {r.k: r["count"] for r in count_by(df, "k", of="k").collect()}
    assert plain == {"a": 2, None: 2}
    assert of == {"a": 2, None: 0}


def test_top_k_per_group_keeps_ties(spark):
    rows = [("g1", "x")] * 3 + [("g1", "y")] * 3 + [("g1", "z")] * 2 + [("g1", "w")] * 1 + [("g2", "x")] * 1
    df = spark.createDataFrame(rows, "g string, i string")
    got = sorted((r.g, r.i, r["count"], r["rank"]) for r in top_k_per_group(df, "g", "i", k=2).collect())
    assert got == [("g1", "x", 3, 1), ("g1", "y", 3, 1), ("g1", "z", 2, 2), ("g2", "x", 1, 1)]


def test_dense_rank_superset_of_row_number(spark):
    df = spark.range(0, 2000).select((F.col("id") % 7).alias("g"), (F.col("id") % 13).alias("i"))
    ranked = top_k_per_group(df, "g", "i", k=3)
    per_group = ranked.groupBy("g").count().collect()
    assert all(r["count"] >= 3 for r in per_group)


def test_percent_share_sums_to_100(spark):
    df = spark.range(0, 997).select((F.col("id") % 7).alias("k"))
    s = percent_share(df, "k")
    assert abs(s.agg(F.sum("share")).first()[0] - 100.0) < 1e-9
    assert s.agg(F.sum("count")).first()[0] == 997


def test_bucket_share(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 5.0, 7.0, 25.0]], "tip double")
    got = {r.bucket: (r["count"], r.share) for r in bucket_share(df, "tip", [0, 5, 10, 15, 20]).collect()}
    assert got == {"[0-5)": (2, 40.0), "[5-10)": (2, 40.0), ">=20": (1, 20.0)}


def test_rule_counts_single_pass_and_zero_groups(spark):
    df = spark.createDataFrame(
        [("1", 0.0, 1, 5.0), ("1", 2.0, 0, -1.0), ("2", 3.0, 2, 4.0), ("2", None, 1, 4.0)],
        "vendor string, trip_distance double, passenger_count int, fare_amount double",
    )
    rules = {k: v for k, v in trip_rules().items() if k in ("distance_zero", "passengers_zero", "fare_negative")}
    total = {r.rule: r.n_bad for r in rule_counts(df, rules).collect()}
    assert total == {"distance_zero": 1, "passengers_zero": 1, "fare_negative": 1}
    by = {(r.vendor, r.rule): r.n_bad for r in rule_counts(df, rules, by="vendor").collect()}
    assert by[("2", "distance_zero")] == 0 and by[("1", "fare_negative")] == 1 and len(by) == 6
    worst = worst_offender(df, rules, "vendor").collect()
    assert [(r.vendor, r.n_bad) for r in worst] == [("1", 3)]


def test_profiles_and_missing_address(spark):
    df = spark.createDataFrame(
        [(None, "NA", None), ("12", "", None), ("3", "MAIN", "X"), (None, None, None)],
        "house string, street string, cross string",
    )
    nulls = {r.column: (r.n_null, r.fraction) for r in null_profile(df).collect()}
    assert nulls == {"house": (2, 0.5), "street": (1, 0.25), "cross": (3, 0.75)}
    sent = {r.column: r.n_missing for r in sentinel_profile(df, {"street": ("", "NA")}).collect()}
    assert sent == {"street": 3}
    assert missing_address(df, ["house", "street"], "any").first().n == 2
    assert missing_address(df, ["house", "street", "cross"], "all", ("", "NA")).first().n == 2


def test_distinct_count_null_accounting(spark):
    df = spark.createDataFrame([("NY",), ("NJ",), (None,), ("NY",)], "s string")
    assert distinct_count(df, "s").first().n == 2
    assert distinct_count(df, "s", include_null=True).first().n == 3
    assert distinct_count(df, "s", approx=True).first().n == 2


def test_fraction_where_null_as(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (None,), (1.0,)], "extra double")
    assert fraction_where(df, F.col("extra") != 0, null_as=True).first().percent == 75.0
    assert fraction_where(df, F.col("extra") != 0).first().percent == 50.0


def test_summary_percentiles(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    approx = summary_percentiles(df, "x").first()
    exact = summary_percentiles(df, "x", exact=True).first()
    assert (approx.avg, approx.p25, approx.p50, approx.p75) == (50.5, 25.0, 50.0, 75.0)
    assert (exact.p25, exact.p50, exact.p75) == (25.75, 50.5, 75.25)


def test_avg_speed_ignores_zero_distance_and_duration(spark):
    import datetime as dt

    t = dt.datetime(2017, 12, 25, 10)
    df = spark.createDataFrame(
        [
            (10.0, t, t + dt.timedelta(hours=1), 12),
            (0.0, t, t + dt.timedelta(hours=1), 12),
            (5.0, t, t, 12),
            (30.0, t, t + dt.timedelta(hours=1), 11),
        ],
        "trip_distance double, pickup_ts timestamp, dropoff_ts timestamp, m int",
    )
    assert avg_speed(df).first().avg_speed == 20.0
    per = {r.m: (r.avg_speed, r.overall_speed, r.diff) for r in avg_speed_vs_overall(df, "m").collect()}
    assert per == {12: (10.0, 20.0, -10.0), 11: (30.0, 20.0, 10.0)}


def test_busiest_groups(spark):
    rows = [(19, 38)] * 5 + [(19, 14)] * 4 + [(18, 14)] * 6 + [(18, 21)] * 1 + [(14, 14)] * 2 + [(14, 69)] * 3 + [(1, 14)] * 1 + [(0, 1)] * 50
    df = spark.createDataFrame(rows, "precinct int, code int")
    per = {(r.precinct, r.code): r["count"] for r in freq_within_top_groups(df, "precinct", "code", 3).collect()}
    assert set(p for p, _ in per) == {19, 18, 14}
    pooled = {r.code: r["count"] for r in freq_within_top_groups(df, "precinct", "code", 3, pooled=True).collect()}
    assert pooled == {38: 5, 14: 12, 21: 1, 69: 3}
    common = [(r.code, r.groups, r["count"]) for r in common_items(df, "precinct", "code", 3, per_group=2).collect()]
    assert common == [(14, 3, 12)]
    stacked = {(r.precinct, r.code): r.share for r in stacked_counts(df, "precinct", "code").collect()}
    assert stacked[(18, 14)] == pytest.approx(600 / 7)


def test_top_bins_for_top_items(spark):
    rows = [("a", 1)] * 5 + [("a", 2)] * 3 + [("b", 1)] * 4 + [("c", 3)] * 3 + [("d", 1)] * 1
    df = spark.createDataFrame(rows, "item string, bin int")
    got = sorted((r.item, r.bin, r["count"], r["rank"]) for r in top_bins_for_top_items(df, "item", "bin", k=2, per_item=1, exclude=(None,)).collect())
    assert got == [("a", 1, 5, 1), ("b", 1, 4, 1)]


def test_fine_revenue_reference_anchors(spark):
    # ticket counts published for 2015: code 21 x 809914, 38 x 746562, 14 x 517733
    counts = [(21, 809914), (38, 746562), (14, 517733), (36, 457313)]
    df = None
    offset = 0
    for code, n in counts:
        part = spark.range(offset, offset + n).select(F.lit(code).alias("violation_code"))
        df = part if df is None else df.unionByName(part)
        offset += n
    rev = fine_revenue(df, fine_table(spark, FINES), k=3)
    got = {r.violation_code: (r.tickets, r.avg_fine, r.total) for r in rev.collect()}
    assert got == {21: (809914, 55.0, 44545270.0), 38: (746562, 50.0, 37328100.0), 14: (517733, 115.0, 59539295.0)}
    assert revenue_total(rev).first().total == 44545270.0 + 37328100.0 + 59539295.0
    top = top_revenue_code(rev).first()
    assert (top.violation_code, top.total) == (14, 59539295.0)


def test_compare_years(spark):
    y15 = spark.createDataFrame([(1, "NY"), (2, "NJ"), (3, "NY")], "s long, st string")
    y16 = spark.createDataFrame([(4, "NY"), (5, "NY")], "s long, st string")
    stacked = stack_years({2015: y15, 2016: y16})
    out = compare_years(stacked, "year", {"tickets": F.count_distinct("s"), "states": F.count_distinct("st")})
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(2015, 3, 2, None, None), (2016, 2, 1, -1, -1)]


def test_columns_tidy(spark):
    df = spark.createDataFrame([(1, None, "x", None)], "`Summons Number` int, `Days Parking In Effect    ` string, `Unregistered Vehicle?` string, `All Null` string")
    norm = normalize_columns(df)
    assert norm.columns == ["Summons_Number", "Days_Parking_In_Effect", "Unregistered_Vehicle", "All_Null"]
    assert select_range(df, 1, 3).columns == ["Days Parking In Effect    ", "Unregistered Vehicle?"]
    assert drop_sparse_columns(df).columns == ["Summons Number", "Unregistered Vehicle?"]
    shape = {r.column: (r.type, r.n_rows, r.n_cols) for r in shape_report(df).collect()}
    assert shape["Summons Number"] == ("int", 1, 4)


def test_pivot_years(spark):
    from citylens.operators import pivot_years

    df = spark.createDataFrame([(21, 2015), (21, 2015), (38, 2016), (21, 2017), (21, 2014), (7, None)], "code int, y int")
    out = pivot_years(df, "y", [2015, 2016, 2017], "code", F.count(F.lit(1)), fill=0)
    assert out.columns == ["code", "2015", "2016", "2017", "other", "unknown"]
    # every row is in one of the columns
    assert sorted(tuple(r) for r in out.collect()) == [(7, 0, 0, 0, 0, 1), (21, 2, 0, 1, 1, 0), (38, 0, 1, 0, 0, 0)]


def test_hot_key_holding_a_third_of_rows(spark):
    # key 0 holds a third of all rows; results stay exact and the count is combined map-side
    n = 300_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("g"),
        (F.col("id") % 7).alias("i"),
    )
    top = top_k_per_group(df, "g", "i", k=2)
    hot = {r.i: r["count"] for r in top.filter("g = 0").collect()}
    assert sum(hot.values()) <= n // 3 and len(hot) >= 2
    assert top_n(df, "g", 1, exclude=()).first()["count"] == n // 3 + sum(1 for x in range(n) if x % 3 and x % 1000 == 0)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "WindowGroupLimit" in plan


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "s string, x double")
    assert distinct_count(df, "s", include_null=True).first().n == 0
    assert distinct_count(df, "s").first().n == 0
    assert top_n(df, "s", 3).count() == 0
    assert percent_share(df, "s").count() == 0
    assert drop_sparse_columns(df).columns == ["s", "x"]
    assert null_profile(df).first().fraction is None
    assert summary_percentiles(df, "x").first().p50 is None


def test_exclude_on_text_column(spark):
    df = spark.createDataFrame([("0",), ("0",), ("19",), ("14",), ("NA",)], "precinct string")
    got = [tuple(r) for r in top_n(df, "precinct", 5, exclude=(0, None)).collect()]
    assert got == [("14", 1), ("19", 1), ("NA", 1)]
