"""Merged distinct counts, shared reductions, dated fines, bounded top-n, manifest loads, epoch text."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.functions import from_epoch, to_epoch
from citylens.operators import (
    count_bitmaps,
    distinct_bitmaps,
    fine_revenue_by_year,
    fines_in_force,
    merge_bitmaps,
    rollup_reports,
    top_n,
    top_n_bounded,
    value_numbers,
)
from citylens.operators.frequency import frequent_candidates
from citylens.plans import registry
from citylens.plans import taxi
from citylens.sources import materialize, read_trips
from citylens.sources.loads import LoadedTable
from tests.conftest import SF01


# -- distinct counts ------------------------------------------------------------------

def test_distinct_counts_merge_exactly(spark, tmp_path):
    draw = random.Random(1)
    rows = [(draw.choice([1, 2, 3, None]), draw.choice([draw.randint(-70000, 70000), draw.randint(0, 9), 2**62, None])) for _ in range(3000)]
    rows += [(4, None)]
    df = spark.createDataFrame(rows, "month int, id bigint")
    bits = materialize(distinct_bitmaps(df, "month", "id"), f"{tmp_path}/bits")
    assert count_bitmaps(bits).first()[0] == len({i for _, i in rows if i is not None})
    want = {m: len({i for k, i in rows if k == m and i is not None}) for m in (1, 2, 3, None)}
    assert dict(map(tuple, count_bitmaps(bits, "month").collect())) == want
    # a month that comes again replaces its bits
    again = distinct_bitmaps(df.filter("month = 2 AND id < 5"), "month", "id")
    merged = merge_bitmaps(bits.filter("NOT month <=> 2").unionByName(again))
    kept = {i for m, i in rows if i is not None and (m != 2 or i < 5)}
    assert merged.agg(F.sum(F.bitmap_count("bits"))).first()[0] == len(kept)
    assert count_bitmaps(bits.limit(0)).first()[0] == 0


def test_the_counts_come_from_the_stored_bits_alone(spark, tmp_path):
    df = spark.range(1000).withColumn("month", F.col("id") % 3)
    bits = materialize(distinct_bitmaps(df, "month", "id"), f"{tmp_path}/bits")
    plan = count_bitmaps(bits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Range" not in plan and "bitmap_or_agg" in plan


def test_value_numbers_never_change(spark, tmp_path):
    path = f"{tmp_path}/numbers"
    first = dict(map(tuple, value_numbers(spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "s string"), "s", path).collect()))
    second = dict(map(tuple, value_numbers(spark.createDataFrame([("c",), ("b",), ("d",)], "s string"), "s", path).collect()))
    assert set(first) == {"a", "b"} and set(second) == set("abcd")
    assert all(second[k] == v for k, v in first.items()) and len(set(second.values())) == 4


# -- shared reductions -------------------------------------------------------------------

def test_rollup_reports(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["x", "y", None]), draw.choice([1, 2]), draw.randint(0, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b int, v int")
    reports = {"by a": ["a"], "by both": ["b", "a"], "all": [], "a again": ["a"]}
    got = sorted(map(tuple, rollup_reports(df, {"a": F.col("a"), "b": F.col("b")}, reports, {"s": F.col("v")}).collect()), key=str)
    want = []
    for report, of in reports.items():
        groups = {}
        for a, b, v in rows:
            key = (a if "a" in of else None, b if "b" in of else None)
            n, s = groups.get(key, (0, 0))
            groups[key] = (n + 1, s + v)
        want += [(report, *k, n, s) for k, (n, s) in groups.items()]
    assert got == sorted(want, key=str)
    assert rollup_reports(df.limit(0), {"a": F.col("a")}, {"by a": ["a"], "all": []}).collect() == []
    with pytest.raises(ValueError):
        rollup_reports(df, {"a": F.col("a")}, {"r": ["b"]})


def test_five_reports_scan_the_trips_once(spark):
    plan = registry()["one_pass_reports"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # lineitem and orders, one scan each
    assert plan.index("Expand") < plan.rindex("HashAggregate")  # the sets are taken of the reduced rows
    assert taxi.study(spark, SF01).vendor_counts().count() > 0


# -- fines ------------------------------------------------------------------------------

def test_each_ticket_has_the_fine_of_its_day(spark):
    d = dt.date
    fines = spark.createDataFrame(
        [(21, "a", d(2014, 1, 1), d(2015, 6, 1), 45.0), (21, "a", d(2015, 7, 1), None, 65.0), (21, "b", d(2015, 3, 1), None, 35.0),
         (14, "a", d(2015, 1, 1), d(2015, 2, 1), 10.0), (14, "a", d(2015, 1, 1), None, 20.0), (None, "a", d(2014, 1, 1), None, 99.0)],
        "violation_code int, zone string, valid_from date, valid_to date, fine double",
    )
    days = [
        (21, "a", d(2013, 12, 31), None), (21, "a", d(2014, 1, 1), 45.0), (21, "a", d(2015, 5, 31), 45.0), (21, "a", d(2015, 6, 1), None),
        (21, "a", d(2015, 7, 1), 65.0), (21, "b", d(2015, 2, 28), None), (21, "b", d(2019, 1, 1), 35.0), (36, "a", d(2015, 1, 1), None),
        (14, "a", d(2015, 1, 15), 20.0), (None, "a", d(2015, 1, 1), None), (21, "a", None, None), (21, "a", d(2015, 7, 1), 65.0),
    ]
    counts = spark.createDataFrame(days, "violation_code int, zone string, day date, want double")
    got = fines_in_force(counts, fines, "day")
    assert got.count() == len(days) and got.filter("NOT fine <=> want").collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_revenue_on_both_sides_of_a_change(spark):
    fines = spark.createDataFrame(
        [(1, "all", dt.date(2015, 1, 1), None, 10.0), (1, "all", dt.date(2016, 7, 1), None, 15.0)],
        "violation_code int, zone string, valid_from date, valid_to date, fine double")
    rows = [(1, dt.datetime(2016, 6, 30, 23, 59)), (1, dt.datetime(2016, 7, 1)), (1, dt.datetime(2016, 7, 1, 5)), (2, dt.datetime(2016, 7, 1)),
            (0, dt.datetime(2016, 7, 1)), (1, dt.datetime(2014, 1, 1)), (1, None)]
    df = spark.createDataFrame(rows, "violation_code int, issue_ts timestamp_ntz")
    got = {(r.year, r.violation_code): (r.tickets, r.total, r.tickets_without_fine) for r in fine_revenue_by_year(df, fines).collect()}
    assert got == {(2016, 1): (3, 40.0, 0), (2016, 2): (1, None, 1), (2014, 1): (1, None, 1), (None, 1): (1, None, 1)}


# -- frequent values --------------------------------------------------------------------

def _skewed(spark, n=20_000):
    draw = random.Random(3)
    values = [f"v{int(40 * draw.random() ** 4)}" if draw.random() < 0.6 else f"rare{draw.randint(0, n)}" for _ in range(n)]
    return spark.createDataFrame([(v if draw.random() < 0.95 else None,) for v in values], "c string")


@pytest.mark.parametrize("exclude", [(None,), (None, "v0"), ()])
def test_top_n_bounded_is_top_n(spark, exclude):
    df = _skewed(spark)
    for n, tracked in ((1, 1000), (5, 2000), (5, 16), (200, 1000), (50_000, 1000)):
        want = [tuple(r) for r in top_n(df, "c", n, exclude).collect()]
        assert [tuple(r) for r in top_n_bounded(df, "c", n, exclude, tracked=tracked).collect()] == want


def test_no_other_value_exceeds_the_bound(spark):
    df = _skewed(spark)
    counts = dict(map(tuple, df.groupBy("c").count().collect()))
    for tracked, most in ((16, 5), (64, 20), (1000, 25), (5000, 5000)):
        candidates, bound = frequent_candidates(df, "c", tracked, most)
        assert max((n for v, n in counts.items() if v not in candidates), default=0) <= bound
    assert frequent_candidates(df.limit(0), "c", 100, 10) is None


def test_the_second_pass_shuffles_candidates_only(spark):
    df = top_n_bounded(_skewed(spark), "c", 3, tracked=2000)
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()  # proven: no exact pass over all values
    near = spark.range(1000).select((F.col("id") % 500).alias("c"))
    assert "Range" in top_n_bounded(near, "c", 3, tracked=50)._jdf.queryExecution().executedPlan().toString()  # not proven


# -- loads ------------------------------------------------------------------------------

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType())])


def _put(root, name, ids, text="x"):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text("id,v\n" + "".join(f"{i},{text}\n" for i in ids))


def test_a_file_is_loaded_once(spark, tmp_path):
    root, read = tmp_path / "in coming+1", lambda paths: read_trips(spark, paths, schema=SCHEMA)
    loads = LoadedTable(spark, f"{tmp_path}/table")
    ids = lambda: sorted(r.id for r in loads.table().collect())
    _put(root, "nov.csv", range(5))
    assert len(loads.load(str(root), read)) == 1 and ids() == [0, 1, 2, 3, 4]
    assert loads.load(str(root), read) == [] and ids() == [0, 1, 2, 3, 4]
    # by another name, twice, with a new month and an empty file beside them
    _put(root, "nov again.csv", range(5))
    _put(root, "deep/nov%20.csv", range(5))
    _put(root, "dec.csv", [7, 7])
    (root / "empty.csv").write_text("")
    assert [p.rsplit("/", 1)[1] for p in loads.load(str(root), read)] == ["dec.csv"]
    assert ids() == [0, 1, 2, 3, 4, 7, 7]
    assert loads.table().columns == ["id", "v"]
    # rewritten with the same content: nothing changes
    time.sleep(1.1)
    _put(root, "dec.csv", [7, 7])
    assert loads.load(str(root), read) == [] and ids() == [0, 1, 2, 3, 4, 7, 7]
    # corrected content under the same name replaces the rows it gave
    _put(root, "dec.csv", [8])
    assert len(loads.load(str(root), read)) == 1 and ids() == [0, 1, 2, 3, 4, 8]
    # and back again
    _put(root, "dec.csv", [7, 7])
    loads.load(str(root), read)
    assert ids() == [0, 1, 2, 3, 4, 7, 7]


def test_a_load_that_fails_leaves_nothing(spark, tmp_path):
    root, read = tmp_path / "in", lambda paths: read_trips(spark, paths, schema=SCHEMA)
    loads = LoadedTable(spark, f"{tmp_path}/table")
    with pytest.raises(ValueError):
        loads.table()
    _put(root, "a.csv", [1, 2])
    loads.load(str(root), read)
    _put(root, "b.csv", [3])
    with pytest.raises(Exception, match="lost"):
        loads.load(str(root), lambda paths: read(paths).filter(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).isNull()))
    assert loads.manifest().count() == 1 and sorted(r.id for r in loads.table().collect()) == [1, 2]
    loads.load(str(root), read)
    assert sorted(r.id for r in loads.table().collect()) == [1, 2, 3]


# -- epoch text -------------------------------------------------------------------------

@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_epoch_round_trip(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("06/04/2015",), ("6/4/2015",), ("12/31/1969",), ("x",), (None,)], "d string")
        got = [tuple(r) for r in df.select(to_epoch("d"), from_epoch(to_epoch("d")), from_epoch(to_epoch("d"), "MMM yyyy HH:mm")).collect()]
        clock = spark.createDataFrame([("0143PM",)], "t string").select(from_epoch(to_epoch("t", "hhmma"), "HH:mm")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0] == got[1] == (1433376000, "2015-06-04", "Jun 2015 00:00")
    assert got[2] == (-86400, "1969-12-31", "Dec 1969 00:00") and got[3:] == [(None, None, None)] * 2
    assert clock == "13:43"
