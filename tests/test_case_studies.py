"""Both studies end to end on small CSV files with the real file layouts (FIXTURES.md §1-§3)."""

import os
import tempfile

import pytest

from citylens.operators import FINES, fine_table, normalize_columns
from citylens.plans.studies import ParkingStudy, TaxiStudy
from citylens.schemas import TICKET_CORE_COLUMNS, TRIP_SCHEMA
from citylens.sources import read_tickets, read_trips, union_months

TRIP_FIELDS = [f.name for f in TRIP_SCHEMA.fields]
BASE_TRIP = dict(
    VendorID=1, tpep_pickup_datetime="2017-11-10 10:00:00", tpep_dropoff_datetime="2017-11-10 10:30:00",
    passenger_count=1, trip_distance=5.0, RatecodeID=1, store_and_fwd_flag="N", PULocationID=100,
    DOLocationID=200, payment_type=1, fare_amount=20.0, extra=0.5, mta_tax=0.5, tip_amount=3.0,
    tolls_amount=0.0, improvement_surcharge=0.3, total_amount=24.3,
)


def trip(**kw):
    row = dict(BASE_TRIP, **kw)
    return ",".join("" if row[f] is None else str(row[f]) for f in TRIP_FIELDS)


NOV = [
    trip(),                                                    # clean, 10 mph
    trip(VendorID=2, trip_distance=0),                         # distance 0
    trip(VendorID=2, passenger_count=0),                       # no passengers
    trip(VendorID=2, RatecodeID=99),                           # bad rate code
    trip(VendorID=2, fare_amount=-5.0, total_amount=-4.0),     # fare < 0, total < 0
    trip(VendorID=1, fare_amount=0.0, total_amount=0.0, tip_amount=0.0),  # fare = 0, total = 0
    trip(VendorID=2, tip_amount=-1.0),                         # tip < 0
    trip(tpep_dropoff_datetime="2017-11-10 10:00:00"),         # zero duration
    trip(extra=None),                                          # NULL extra (counted as charged)
    trip(extra=0.0, passenger_count=2, tip_amount=7.0),        # no extra charge
    trip(tpep_pickup_datetime="2017-11-30 23:50:00", tpep_dropoff_datetime="2018-01-01 00:10:00"),  # dropoff Jan 2018: kept
    trip(tpep_dropoff_datetime="2016-11-10 10:30:00"),         # dropoff 2016: out
    trip(tpep_dropoff_datetime="2019-11-10 10:30:00"),         # dropoff 2019: out
] + [trip(VendorID=2, tpep_pickup_datetime=f"{y}-11-10 10:00:00", tpep_dropoff_datetime=f"{y}-11-10 10:30:00") for y in (2001, 2003, 2008, 2009, 2041)]
DEC = [
    trip(tpep_pickup_datetime="2017-12-25 08:00:00", tpep_dropoff_datetime="2017-12-25 08:30:00", trip_distance=15.0, tip_amount=12.0),
    trip(tpep_pickup_datetime="2017-12-31 20:00:00", tpep_dropoff_datetime="2017-12-31 21:00:00", trip_distance=30.0, tip_amount=25.0),
    trip(tpep_pickup_datetime="2017-12-05 09:00:00", tpep_dropoff_datetime="2017-12-05 10:00:00", trip_distance=8.0, tip_amount=16.0, payment_type=2),
    trip(VendorID=2, tpep_pickup_datetime="2018-12-01 09:00:00", tpep_dropoff_datetime="2018-12-01 10:00:00"),  # pickup 2018
] + [trip(VendorID=2, tpep_pickup_datetime=f"2017-{m:02d}-03 09:00:00", tpep_dropoff_datetime=f"2017-{m:02d}-03 09:30:00") for m in (1, 2, 3, 10)]


def _write(folder, name, header, rows, blank_second_line=False):
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        fh.write(header + "\n" + ("\n" if blank_second_line else "") + "\n".join(rows) + "\n")
    return path


@pytest.fixture(scope="module")
def taxi(spark):
    folder = tempfile.mkdtemp(prefix="citylens-taxi-")
    header = ",".join(TRIP_FIELDS)
    nov = read_trips(spark, _write(folder, "nov.csv", header, NOV, blank_second_line=True))
    dec = read_trips(spark, _write(folder, "dec.csv", header, DEC, blank_second_line=True))
    return TaxiStudy(union_months(nov, dec))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_taxi_audit(taxi):
    assert rows(taxi.vendor_counts()) == [(1, 11), (2, 15)]
    assert {r.month for r in taxi.distinct_months().collect()} == {1, 2, 3, 10, 11, 12}
    assert {r.year for r in taxi.distinct_years().collect()} == {2001, 2003, 2008, 2009, 2017, 2018, 2041}
    assert {r.year for r in taxi.distinct_years_in_months().collect()} == {2001, 2003, 2008, 2009, 2017, 2018, 2041}
    assert {r.year for r in taxi.distinct_dropoff_years().collect()} == {2016, 2017, 2018, 2019}
    assert {r.month for r in taxi.distinct_dropoff_months().collect()} == {1, 11, 12}
    assert {r.RatecodeID for r in taxi.distinct_rate_codes().collect()} == {1, 99}
    counts = dict(rows(taxi.rule_counts()))
    assert counts == {
        "distance_zero": 1, "passengers_zero": 1, "fare_negative": 1, "fare_zero": 1,
        "tip_negative": 1, "total_negative": 1, "total_zero": 1,
    }
    by_vendor = {(v, r): n for v, r, n in rows(taxi.rule_counts_by_vendor())}
    assert by_vendor[(2, "rate_code_invalid")] == 1 and by_vendor[(1, "rate_code_invalid")] == 0
    assert rows(taxi.worst_vendor()) == [(2, 6)]  # 0 km, 0 pax, rate 99, fare<0 + total<0, tip<0
    assert taxi.clean().count() == 14
    assert taxi.union_months().count() == 14 + 2  # the two dropoff-outside rows are in the months too


def test_taxi_analysis(taxi):
    fares = dict(rows(taxi.avg_fare_by_month()))
    assert fares[12] == 20.0 and fares[11] == 20.0
    assert rows(taxi.passenger_counts()) == [(1, 12), (2, 1)]
    assert rows(taxi.top_payment()) == [(1, 13)]
    tips = taxi.tip_percentiles().first()
    assert (tips.p25, tips.p50, tips.p75) == (3.0, 3.0, 7.0)
    # 13 clean trips with extra != 0 or NULL out of 14
    assert taxi.extra_fraction().first().percent == round(13 * 100 / 14, 2)
    shares = {r.bucket: r["count"] for r in taxi.tip_bucket_share().collect()}
    assert shares == {"[0-5)": 9, "[5-10)": 1, "[10-15)": 1, "[15-20)": 1, ">=20": 1}
    day = dict(rows(taxi.speed_by_day()))
    assert day == {25: 30.0, 31: 30.0}
    month = dict(rows(taxi.speed_by_month()))
    assert month[12] == round((30.0 + 30.0 + 8.0) / 3, 9)
    vs = {r.month: (r.avg_speed, r.overall_speed) for r in taxi.speed_vs_overall().collect()}
    assert vs[12][0] == month[12] and vs[11][1] == taxi.speed_overall().first().avg_speed


def ticket(**kw):
    row = {c: "" for c in TICKET_CORE_COLUMNS}
    row.update({"Summons Number": "1", "Registration State": "NY", "Issue Date": "06/04/2015", "Violation Code": "21",
                "Vehicle Body Type": "SUBN", "Vehicle Make": "FORD", "Violation Precinct": "19",
                "Issuer Precinct": "19", "Violation Time": "0843A", "House Number": "12", "Street Name": "MAIN ST",
                "Intersecting Street": "1ST AVE"})
    row.update(kw)
    return ",".join(f'"{row[c]}"' if row[c] != "" else "" for c in TICKET_CORE_COLUMNS)


@pytest.fixture(scope="module")
def parking(spark):
    rows_ = []
    n = 0

    def add(**kw):
        nonlocal n
        n += 1
        rows_.append(ticket(**{"Summons Number": str(n), **kw}))

    # clock texts: 0143A, 0143P, 1230A, 1230P, 0043P, 1300A, empty, NA
    for t, code in [("0143A", "21"), ("0143P", "38"), ("1230A", "21"), ("1230P", "14"), ("0043P", "38"), ("1300A", "14"), ("", "36"), ("NA", "36")]:
        add(**{"Violation Time": t, "Violation Code": code})
    # ties inside the 0-3 bin: 21 and 40 twice each (plus the two 21s above -> 21 x4), 78 and 7 once each
    for code in ["40", "40", "40", "40", "78", "7", "21", "21"]:
        add(**{"Violation Time": "0210A", "Violation Code": code})
    # missing address parts (NULL, empty, NA) and NULL body type / make
    add(**{"House Number": "", "Street Name": "", "Intersecting Street": ""})
    add(**{"House Number": "NA", "Street Name": "NA", "Intersecting Street": ""})
    add(**{"Vehicle Body Type": "", "Vehicle Make": ""})
    # a second year in the same file, another precinct
    add(**{"Issue Date": "12/30/2014", "Issuer Precinct": "18", "Violation Precinct": "0"})
    add(**{"Issue Date": "7/1/2014", "Issuer Precinct": "14", "Registration State": "NJ"})
    folder = tempfile.mkdtemp(prefix="citylens-parking-")
    header = ",".join(f'"{c}"' for c in TICKET_CORE_COLUMNS)
    path = _write(folder, "2015.csv", header, rows_)
    df = normalize_columns(read_tickets(spark, path, columns=TICKET_CORE_COLUMNS))
    return ParkingStudy(df, year=2015)


def test_parking_examine(parking):
    assert parking.ticket_count().first().n == 19  # the year's own: two of the file's 21 are of 2014
    assert parking.ticket_count_in_year().first().n == 19
    assert parking.out_of_year_count().first().n == 2
    assert parking.state_count().first().n == 1  # the other state is on a 2014 ticket
    assert parking.missing_address_all().first().n == 2  # NULL/empty and NA count as missing
    assert parking.missing_address_any().first().n == 1  # NULL only: "NA" text is a value here
    assert rows(parking.top_body_types()) == [("SUBN", 18)]


def test_parking_clock_and_bins(parking):
    strict = {r.Summons_Number: r.hour for r in parking.clock_hours().collect()}
    lenient = {r.Summons_Number: r.hour for r in parking.clock_hours_lenient().collect()}
    assert [strict.get(i) for i in range(1, 9)] == [1, 13, 0, 12, None, None, None, None]
    assert [lenient.get(i) for i in range(1, 9)] == [1, 13, 0, 12, 12, 13, None, None]
    missing = parking.clock_missing().first()
    assert missing.n_missing == 2  # "" and "NA"
    top = {(r.bin, r.Violation_Code): (r["count"], r["rank"]) for r in parking.top_codes_per_bin().collect()}
    # bin 1 (hours 0-3): 21 x4 and 40 x4 share rank 1, then 78 and 7 share rank 2
    assert top[(1, 21)] == (4, 1) and top[(1, 40)] == (4, 1) and top[(1, 78)] == (1, 2) and top[(1, 7)] == (1, 2)


def test_parking_aggregates_and_revenue(parking, spark):
    # codes: 21 x7, 40 x4, then 14, 36, 38 tie at 2 (the lower code wins), 78 and 7 once
    assert [tuple(r) for r in parking.top_codes().collect()] == [(21, 7), (40, 4), (14, 2), (36, 2), (38, 2)]
    assert {r.Issuer_Precinct for r in parking.codes_in_top_precincts().collect()} == {19}
    rev = {r.Violation_Code: (r.tickets, r.avg_fine, r.total) for r in parking.fine_revenue(fine_table(spark, FINES)).collect()}
    assert rev == {21: (7, 55.0, 385.0), 40: (4, None, None), 14: (2, 115.0, 230.0)}  # 40 has no fine listed
    total = parking.revenue_total(fine_table(spark, FINES)).first()
    assert (total.total, total.tickets_without_fine) == (615.0, 4)
    assert parking.top_revenue_code(fine_table(spark, FINES)).first().Violation_Code == 21
    seasons = dict(rows(parking.season_counts()))
    assert seasons == {3: 19}
    parts = {(r.issue_year, r.issue_month): r["count"] for r in parking.date_parts().collect()}
    assert parts == {(2015, 6): 19, (2014, 12): 1, (2014, 7): 1}
    years = {r.year: r.tickets for r in parking.yearly_comparison().collect()}
    assert years == {2014: 2, 2015: 19}


def test_materialized_clean_gives_the_same_reports(taxi):
    fast = taxi.with_materialized_clean()
    assert "Relation" in fast.clean()._jdf.queryExecution().optimizedPlan().toString()
    for name in ("rule_counts", "avg_fare_by_month", "tip_bucket_share", "speed_vs_overall", "passenger_counts"):
        assert rows(getattr(fast, name)()) == rows(getattr(taxi, name)()), name
    assert rows(fast.vendor_counts()) == rows(taxi.vendor_counts())  # audits still read the raw trips


def test_every_report_runs_on_real_layouts(taxi, parking, spark):
    for name, df in taxi.reports().items():
        df.collect()
    reports = parking.reports(fines=fine_table(spark, FINES))
    assert set(ParkingStudy.REPORTS) | {"fine_revenue", "revenue_total", "top_revenue_code"} == set(reports)
    for name, df in reports.items():
        df.collect()


def test_parking_reports_on_an_all_text_file(parking, spark):
    # the same file read without types (as an untyped yearly file would be): every report still runs
    text = parking.tickets.select(*[parking.tickets[c].cast("string").alias(c) for c in parking.tickets.columns])
    study = ParkingStudy(text, year=2015)
    for name, df in study.reports(fines=fine_table(spark, FINES)).items():
        df.collect()
    assert [tuple(r) for r in study.top_codes().collect()][:2] == [("21", 7), ("40", 4)]
    assert study.ticket_count_in_year().first().n == 19


def test_analyses_see_their_own_year_only(spark):
    rows_ = [(1, "21", "06/04/2015", "NY", "0843A", "19")] + [
        (i, "99", "06/04/2014", "NJ", "1143P", "18") for i in range(2, 6)
    ]
    names = ["Summons_Number", "Violation_Code", "Issue_Date", "Registration_State", "Violation_Time", "Issuer_Precinct"]
    study = ParkingStudy(spark.createDataFrame(rows_, names), year=2015)
    assert [tuple(r) for r in study.top_codes().collect()] == [("21", 1)]
    assert study.ticket_count().first().n == study.state_count().first().n == 1
    assert [tuple(r) for r in study.season_counts().collect()] == [(3, 1)]
    assert [r.hour for r in study.clock_hours().collect()] == [8]
    assert {r.Issuer_Precinct for r in study.codes_in_top_precincts().collect()} == {"19"}
    # the whole file
    assert study.out_of_year_count().first().n == 4
    assert {r.year: r.tickets for r in study.yearly_comparison().collect()} == {2014: 4, 2015: 1}
    pivot = {r.Violation_Code: (r["2015"], r["other"], r["unknown"]) for r in study.yearly_code_pivot().collect()}
    assert pivot == {"21": (1, 0, 0), "99": (0, 4, 0)}


def test_materialized_parking_gives_the_same_reports(parking):
    fast = parking.with_materialized_clean()
    for name in ("ticket_count", "top_codes", "top_codes_per_bin", "season_counts", "yearly_comparison"):
        assert rows(getattr(fast, name)()) == rows(getattr(parking, name)()), name


def test_materialized_clean_prunes_by_month(taxi):
    plan = taxi.with_materialized_clean().clean().filter("pickup_month = 12")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pickup_month" in plan
