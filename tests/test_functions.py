import datetime as dt

import pytest
from pyspark.sql import functions as F

from citylens.functions import (
    bucketize,
    duration_seconds,
    in_period,
    is_missing,
    month_ranges,
    parse_clock,
    parse_date,
    season,
    speed_mph,
    time_bin,
    year_ranges,
)

CLOCKS = ["0143A", "0143P", "1230A", "1230P", "0043P", "1300A", "2515P", "0960A", "", "NA", None]
STRICT = [1, 13, 0, 12, None, None, None, None, None, None, None]
LENIENT = [1, 13, 0, 12, 12, 13, None, None, None, None, None]


def _col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_parse_clock_strict(spark):
    rows = _col(spark, CLOCKS).select(parse_clock("v").alias("h")).collect()
    assert [r.h for r in rows] == STRICT


def test_parse_clock_lenient(spark):
    rows = _col(spark, CLOCKS).select(parse_clock("v", lenient=True).alias("h")).collect()
    assert [r.h for r in rows] == LENIENT


def test_parse_clock_inverts_date_format(spark):
    # every minute of a day, formatted as hhmm + A/P, parses back to its hour
    df = spark.range(0, 24 * 60).select(
        (F.col("id") / 60).cast("int").alias("h"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
    )
    txt = df.select("h", F.substring(F.date_format("ts", "hhmma"), 1, 5).alias("t"))
    bad = txt.filter((parse_clock("t") != F.col("h")) | (parse_clock("t", lenient=True) != F.col("h")))
    assert bad.count() == 0


def test_time_bin_edges(spark):
    hours = list(range(24)) + [None]
    df = _col(spark, hours, "int")
    left = [r.b for r in df.select(time_bin("v").alias("b")).collect()]
    right = [r.b for r in df.select(time_bin("v", closed="right").alias("b")).collect()]
    assert left == [1] * 4 + [2] * 4 + [3] * 4 + [4] * 4 + [5] * 4 + [6] * 4 + [None]
    assert right == [1] * 5 + [2] * 4 + [3] * 4 + [4] * 4 + [5] * 4 + [6] * 3 + [None]
    null_bin = df.select(time_bin("v", null_bin=6).alias("b")).collect()[-1].b
    assert null_bin == 6
    labels = [r.b for r in df.select(time_bin("v", labels=True).alias("b")).collect()]
    assert labels[0] == "Late_Night" and labels[4] == "Early_Morning" and labels[23] == "Night"


def test_season(spark):
    df = _col(spark, list(range(1, 13)) + [None, 13], "int")
    got = [r.s for r in df.select(season("v").alias("s")).collect()]
    assert got == [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 1, None, None]
    lab = [r.s for r in df.select(season("v", labels=True).alias("s")).collect()]
    assert lab[:3] == ["Winter", "Winter", "Spring"] and lab[8] == "Autumn"


def test_bucketize_edges(spark):
    vals = [-0.01, 0.0, 4.99, 5.0, 10.0, 14.999, 15.0, 19.99, 20.0, 250.0, None]
    got = [r.b for r in _col(spark, vals, "double").select(bucketize("v", [0, 5, 10, 15, 20]).alias("b")).collect()]
    assert got == [None, "[0-5)", "[0-5)", "[5-10)", "[10-15)", "[10-15)", "[15-20)", "[15-20)", ">=20", ">=20", None]


def test_month_and_year_ranges():
    assert month_ranges(2017, [12, 11]) == [(dt.date(2017, 11, 1), dt.date(2018, 1, 1))]
    assert month_ranges(2017, [1, 3]) == [
        (dt.date(2017, 1, 1), dt.date(2017, 2, 1)),
        (dt.date(2017, 3, 1), dt.date(2017, 4, 1)),
    ]
    assert year_ranges([2018, 2017]) == [(dt.date(2017, 1, 1), dt.date(2019, 1, 1))]
    with pytest.raises(ValueError):
        month_ranges(2017, [13])


def test_in_period_half_open(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2017, 10, 31, 23, 59, 59),), (dt.datetime(2017, 11, 1),), (dt.datetime(2017, 12, 31, 23, 59),), (dt.datetime(2018, 1, 1),), (None,)],
        "ts timestamp",
    )
    got = [r.x for r in df.select(in_period("ts", "2017-11-01", "2018-01-01").alias("x")).collect()]
    assert got == [False, True, True, False, None]


def test_is_missing(spark):
    df = _col(spark, [None, "", "  ", "NA", "0", "12 MAIN"])
    got = [r.m for r in df.select(is_missing("v", ("", "NA")).alias("m")).collect()]
    assert got == [True, True, True, True, False, False]
    got0 = [r.m for r in df.select(is_missing("v", ("0",)).alias("m")).collect()]
    assert got0 == [True, False, False, False, True, False]


def test_parse_date(spark):
    df = _col(spark, ["06/04/2015", "6/4/2015", "13/40/2015", "", None])
    got = [r.d for r in df.select(parse_date("v").alias("d")).collect()]
    assert got == [dt.date(2015, 6, 4), dt.date(2015, 6, 4), None, None, None]


def test_speed_zero_and_negative_duration(spark):
    t = dt.datetime(2017, 11, 1, 10, 0, 0)
    df = spark.createDataFrame(
        [(10.0, t, t + dt.timedelta(hours=2)), (5.0, t, t), (3.0, t, t - dt.timedelta(hours=1))],
        "d double, a timestamp, b timestamp",
    )
    rows = df.select(duration_seconds("a", "b").alias("s"), speed_mph("d", "a", "b").alias("v")).collect()
    assert [(r.s, r.v) for r in rows] == [(7200, 5.0), (0, None), (-3600, -3.0)]


def test_strict_clock_equals_hhmma_timestamp_parse(spark):
    # every 4-digit prefix with every suffix, plus odd shapes
    suffix = spark.createDataFrame([(s,) for s in ["A", "P", "a", "p", "X", "", "M", " "]], "s string")
    digits = spark.range(0, 10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    texts = digits.crossJoin(suffix).select(F.concat("d", "s").alias("t")).unionByName(
        spark.createDataFrame([(x,) for x in [None, "", "NA", " 0143A", "0143A ", "143A", "01:43A", "0143AM"]], "t string")
    )
    reference = F.hour(F.try_to_timestamp(F.concat("t", F.lit("M")), F.lit("hhmma")))
    assert texts.filter(~reference.eqNullSafe(parse_clock("t"))).count() == 0
