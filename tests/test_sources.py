import datetime as dt
import os
import tempfile

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens import session

from citylens.operators import normalize_columns
from citylens.schemas import TICKET_CORE_COLUMNS, TRIP_SCHEMA
from citylens.sources import count_malformed, materialize, read_tickets, read_trips, union_months, with_year_month

TRIP_HEADER = ",".join(f.name for f in TRIP_SCHEMA.fields)


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        fh.write(text)
    return path




def test_read_trips(spark):
    folder = tempfile.mkdtemp(prefix="citylens-test-")
    nov = _write(
        folder,
        "nov.csv",
        TRIP_HEADER + "\n\n"
        "1,2017-11-01 00:10:11,2017-11-01 00:20:11,1,2.5,1,N,100,200,1,10.0,0.5,0.5,2.0,0,0.3,13.3\n"
        "2,2017-11-02 10:00:00,2017-11-02 10:00:00,0,0,99,N,100,200,2,-5.0,,0.5,0,0,0.3,-4.2\n"
        "2,not-a-date,2017-11-02 10:00:00,300,1.0,1,N,1,2,1,3.0,0,0.5,0,0,0.3,3.8\n",
    )
    dec = _write(folder, "dec.csv", TRIP_HEADER + "\n1,2017-12-25 08:00:00,2017-12-25 09:00:00,2,12.0,1,Y,1,2,1,30.0,0,0.5,5,0,0.3,35.8\n")
    trips = union_months(read_trips(spark, nov), read_trips(spark, dec))
    rows = trips.orderBy("tpep_dropoff_datetime").collect()
    assert len(rows) == 4  # blank second line dropped, no data row lost
    assert rows[0].tpep_pickup_datetime == dt.datetime(2017, 11, 1, 0, 10, 11)
    bad = [r for r in rows if r.tpep_pickup_datetime is None]
    assert len(bad) == 1 and bad[0].passenger_count is None  # 300 overflows tinyint -> NULL
    zero = [r for r in rows if r.RatecodeID == 99][0]
    assert zero.extra is None and zero.fare_amount == -5.0


def test_read_tickets_normalise(spark):
    folder = tempfile.mkdtemp(prefix="citylens-test-")
    header = ",".join(f'"{c}"' for c in TICKET_CORE_COLUMNS)
    row = ["1361929741", "NY", "PAS", "PAS", "06/04/2015", "21", "SUBN", "FORD"] + [""] * 30
    row[19] = "0143A"
    path = _write(folder, "t.csv", header + "\n" + ",".join(row) + "\n")
    typed = read_tickets(spark, path, columns=TICKET_CORE_COLUMNS)
    assert dict(typed.dtypes)["Summons Number"] == "bigint"
    assert "Days Parking In Effect    " in typed.columns
    norm = normalize_columns(typed)
    assert "Days_Parking_In_Effect" in norm.columns and "Unregistered_Vehicle" in norm.columns
    r = norm.first()
    assert r.Summons_Number == 1361929741 and r.Violation_Code == 21 and r.Violation_Time == "0143A"
    text = read_tickets(spark, path, columns=TICKET_CORE_COLUMNS, typed=False)
    assert set(dict(text.dtypes).values()) == {"string"}


def test_materialize_partitioned(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2017, 11, 3), 1.0), (dt.datetime(2017, 12, 3), 2.0)], "ts timestamp, v double"
    )
    out = materialize(with_year_month(df, "ts"), partition_by=("year", "month"), name="test")
    assert sorted((r.year, r.month, r.v) for r in out.collect()) == [(2017, 11, 1.0), (2017, 12, 2.0)]
    pruned = out.filter(F.col("month") == 12)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_read_ticket_years_with_drift(spark):
    from citylens.sources import read_ticket_years

    folder = tempfile.mkdtemp(prefix="citylens-test-")
    y15 = _write(folder, "2015.csv", 'Summons Number,Issue Date,Violation Code,"Days Parking In Effect    "\n1,06/04/2015,21,YYYYYYY\n2,6/5/2015,x,\n')
    y16 = _write(folder, "2016.csv", "Summons Number,Issue Date,Violation Code,Meter Number\n3,01/02/2016,38,123\n")
    y17 = _write(folder, "2017.csv", "Summons Number,Issue Date\n4,03/03/2017\n")
    out = read_ticket_years(spark, {2015: y15, 2016: y16, 2017: y17}, keep=["Summons_Number", "Violation_Code", "Days_Parking_In_Effect"])
    assert dict(out.dtypes) == {"Summons_Number": "bigint", "Violation_Code": "int", "Days_Parking_In_Effect": "string", "year": "int"}
    rows = sorted(tuple(r) for r in out.collect())
    assert rows == [(1, 21, "YYYYYYY", 2015), (2, None, None, 2015), (3, 38, None, 2016), (4, None, None, 2017)]


def test_materialize_as_catalog_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = materialize(df, name="catalog-test", table="citylens_test_table")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a"), (2, "b")]
    assert sorted(tuple(r) for r in spark.table("citylens_test_table").collect()) == [(1, "a"), (2, "b")]
    spark.sql("DROP TABLE IF EXISTS citylens_test_table")


def test_monthly_loads_keep_each_other(spark, tmp_path):
    def month(m, v):
        return spark.createDataFrame([(dt.datetime(2017, m, 3), v)], "ts timestamp, v double").transform(with_year_month, "ts")

    path = str(tmp_path / "trips")
    for m, v in ((11, 1.0), (12, 2.0), (12, 3.0)):  # December is loaded twice: replaced, not doubled
        out = materialize(month(m, v), path, partition_by=("year", "month"))
    assert sorted((r.month, r.v) for r in out.collect()) == [(11, 1.0), (12, 3.0)]
    with pytest.raises(ValueError):
        materialize(out, path, partition_by=("year", "month"))


def test_partitions_are_written_in_few_files(spark, tmp_path):
    df = spark.range(0, 1200, numPartitions=16).selectExpr("id", "cast(id % 12 as int) as month")
    materialize(df, str(tmp_path / "t"), partition_by=("month",))
    assert len(list((tmp_path / "t").glob("month=*/part-*.parquet"))) <= 24


def test_other_headers_raise_instead_of_shifting(spark):
    folder = tempfile.mkdtemp(prefix="citylens-test-")
    _write(folder, "a.csv", "Summons Number,Issue Date,Violation Code\n1,06/04/2015,21\n")
    _write(folder, "b.csv", "Summons Number,Violation Code,Issue Date\n2,38,06/05/2015\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_tickets(spark, folder).collect()
    one = os.path.join(folder, "b.csv")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_tickets(spark, one, columns=["Summons Number", "Issue Date", "Violation Code"]).collect()
    assert read_tickets(spark, one).first()["Violation Code"] == 38


def test_malformed_lines_are_counted(spark):
    folder = tempfile.mkdtemp(prefix="citylens-test-")
    path = _write(folder, "t.csv", "a,b\n1,2\n\nx,3\n4,y\n5\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    assert tuple(count_malformed(spark, path, schema).first()) == (4, 3)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(session, "_is_local", lambda s: False)

    class Context:
        applicationId = "app"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_scratch_can_be_dropped(spark):
    path = session.scratch_path(spark, "to-drop")
    spark.range(3).write.parquet(path)
    assert session.drop_scratch(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_a_month_of_trips_is_dealt_over_files_with_a_header_each(spark):
    from citylens.plans import ingest
    from tests.conftest import SF01

    path, _ = ingest._trip_lines(spark, SF01)
    files = spark.read.text(f"{path}/*/*/", wholetext=True).collect()
    months = {r.month for r in spark.read.text(path).select("month").distinct().collect()}
    assert len(files) > len(months)
    assert all(f.value.startswith(",".join(ingest.TRIP_LINE) + "\n\n") for f in files)
    assert all(f.value.count(ingest.TRIP_LINE[0]) == 1 for f in files)
