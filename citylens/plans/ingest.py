"""Ingest and materialisation: CSV round trips, month union, partitioned Parquet, shape."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.functions import parse_date
from citylens.operators import compare_years, normalize_columns, shape_report
from citylens.plans.parking import DISPLAY_NAMES
from citylens.plans.taxi import clean
from citylens.schemas import ticket_schema
from citylens.session import scratch_path
from citylens.sources import count_malformed, materialize, read_ticket_years, read_tickets, read_trips, with_year_month, write_csv
from citylens.sources import views as V


def csv_trips(spark, sf):
    """Trips written as header CSV, then read back with a declared schema."""
    trips = V.trips(spark, sf)
    path = write_csv(trips, scratch_path(spark, "csv-trips"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in trips.schema.fields])
    return read_trips(spark, path, schema=schema)


def csv_tickets(spark, sf):
    """Tickets written the way the yearly files look (text dates, spaced headers), read back typed."""
    t = V.tickets(spark, sf).withColumn("issue_ts", F.date_format("issue_ts", "MM/dd/yyyy"))
    raw = t.toDF(*[DISPLAY_NAMES[c] for c in t.columns])
    path = write_csv(raw, scratch_path(spark, "csv-tickets"))
    back = read_tickets(spark, path, schema=ticket_schema(raw.columns))
    tidy = normalize_columns(back, lower=True)
    return tidy.withColumn("issue_date", parse_date("issue_date"))


# Yearly files whose layouts drift: some years carry an extra column, one lacks one.
EXTRA_COLUMN = "Meter Number"
YEARS_WITH_EXTRA = (1997, 2000)
YEAR_WITHOUT_CROSS = 1998


def csv_ticket_years(spark, sf):
    """Yearly ticket files with drifting columns, read as one table and compared year on year.

    The tickets are built once and written once per layout, a folder per year.
    """
    t = V.tickets(spark, sf).withColumn("year", F.year("issue_ts"))
    t = t.withColumn("issue_ts", F.date_format("issue_ts", "MM/dd/yyyy"))
    raw = t.toDF(*[DISPLAY_NAMES.get(c, c) for c in t.columns])
    once = materialize(raw, name="ticket-years")
    years = sorted(r[0] for r in once.select("year").distinct().collect())  # one number per folder
    cross = DISPLAY_NAMES["intersecting_street"]
    extra = F.lit(None).cast("string")
    # the years of one layout are one write
    layouts = (
        ("extra", [y for y in years if y in YEARS_WITH_EXTRA], lambda d: d.withColumn(EXTRA_COLUMN, extra)),
        ("no-cross", [y for y in years if y == YEAR_WITHOUT_CROSS], lambda d: d.drop(cross)),
        ("plain", [y for y in years if y not in (*YEARS_WITH_EXTRA, YEAR_WITHOUT_CROSS)], lambda d: d),
    )
    paths = {}
    for name, of, shaped in layouts:
        root = scratch_path(spark, f"tickets-{name}")
        write_csv(shaped(once.filter(F.col("year").isin(of))), root, partition_by=("year",))
        paths.update({year: f"{root}/year={year}" for year in of})
    core = ["summons_number", "registration_state", "issue_date", "violation_code", "intersecting_street"]
    stacked = read_ticket_years(spark, paths, keep=core, lower=True)
    metrics = {"rows": F.count(F.lit(1)), "no_cross_street": F.count_if(F.col("intersecting_street").isNull())}
    return compare_years(stacked, "year", metrics, distinct={"tickets": "summons_number", "states": "registration_state"})


def _ticket_files(spark, sf):
    t = V.tickets(spark, sf).withColumn("issue_ts", F.date_format("issue_ts", "MM/dd/yyyy"))
    raw = t.toDF(*[DISPLAY_NAMES[c] for c in t.columns])
    return write_csv(raw, scratch_path(spark, "csv-tickets"))


def csv_tickets_inferred(spark, sf):
    """The ticket files with Spark's own types."""
    back = normalize_columns(read_tickets(spark, _ticket_files(spark, sf), infer=True), lower=True)
    return back.groupBy("violation_code").agg(
        F.count("summons_number").alias("tickets"), F.sum("violation_precinct").cast("long").alias("precincts"),
        F.max("issue_date").alias("last_text"),
    )


def csv_tickets_text(spark, sf):
    """The ticket files with every column as text."""
    back = normalize_columns(read_tickets(spark, _ticket_files(spark, sf), typed=False), lower=True)
    return back.select("summons_number", "registration_state", "issue_date", "violation_code", "street_name")


#: Trips of one file: a month's trips are dealt over as many files as they need, two at least.
ROWS_PER_FILE = 1_000_000
LEAST_FILES = 2
TRIP_LINE = ["vendor_id", "pickup_ts", "dropoff_ts", "passenger_count", "fare_amount", "tip_amount"]


def _trip_lines(spark, sf, odd: str | None = None, torn: bool = False):
    """Monthly trip files as they come: a header, a blank second line, then the trips (one folder per month and file).

    ``odd`` is written for 6 passengers; with ``torn`` lines of no passengers lack their last field and lines of 5
    passengers have one more.
    """
    month = F.date_format("pickup_ts", "yyyy-MM").alias("month")
    trips = materialize(V.trips(spark, sf).select(*TRIP_LINE, month), name="line-trips")
    schema = T.StructType([trips.schema[c] for c in TRIP_LINE])
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TRIP_LINE}
    if odd is not None:
        text["passenger_count"] = F.when(F.col("passenger_count") == 6, F.lit(odd)).otherwise(text["passenger_count"])
    line = F.concat_ws(",", *text.values())
    if torn:
        short = F.concat_ws(",", *list(text.values())[:-1])
        line = F.when(F.col("passenger_count") == 0, short).when(F.col("passenger_count") == 5, F.concat(line, F.lit(",x"))).otherwise(line)
    files = F.greatest(F.lit(LEAST_FILES), F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE)).alias("files")
    sized = trips.join(trips.groupBy("month").agg(files), "month")
    part = F.pmod(F.xxhash64(*TRIP_LINE), F.col("files")).cast("int")
    lines = sized.select("month", part.alias("part"), F.lit(2).alias("kind"), line.alias("line"))
    starts = F.array(F.struct(F.lit(0).alias("kind"), F.lit(",".join(TRIP_LINE)).alias("line")),
                     F.struct(F.lit(1).alias("kind"), F.lit("").alias("line")))
    heads = lines.select("month", "part").distinct().select("month", "part", F.inline(starts))
    path = scratch_path(spark, "trip-lines")
    # a month and part is one file: the header stands once, at its top
    ordered = heads.unionByName(lines).repartition("month", "part").sortWithinPartitions("month", "part", "kind")
    ordered.select("month", "part", "line").write.partitionBy("month", "part").text(path)
    return path, schema


def csv_trips_blank_line(spark, sf):
    """Trip files whose second line is blank: no trip is lost, none is made up."""
    path, schema = _trip_lines(spark, sf)
    return read_trips(spark, f"{path}/*/*/", schema=schema).select(*TRIP_LINE)


def csv_malformed(spark, sf):
    """Trip lines with a text where a number belongs, counted instead of lost without a trace."""
    path, schema = _trip_lines(spark, sf, odd="six")
    return count_malformed(spark, f"{path}/*/*/", schema)


def filter_text(spark, sf):
    """A filter written as SQL text."""
    return V.trips(spark, sf).filter("passenger_count > 4 AND trip_distance < 10 AND tip_amount < 0")


def materialize_table(spark, sf):
    """The cleaned trips as a named catalog table, queried by name."""
    name = f"citylens_clean_trips_{uuid.uuid4().hex[:12]}"
    cleaned = with_year_month(clean(V.trips(spark, sf)), "pickup_ts")
    materialize(cleaned, partition_by=("year", "month"), name="clean-trips-table", table=name)
    return spark.sql(f"SELECT month, vendor_id, count(*) AS trips FROM {name} WHERE year = 1997 GROUP BY month, vendor_id")


def materialize_months(spark, sf):
    """Two monthly loads into one partitioned folder: the second keeps the first."""
    path = scratch_path(spark, "monthly-trips")
    trips = with_year_month(V.trips(spark, sf), "pickup_ts").filter("year = 1997")
    for month in (11, 12):
        out = materialize(trips.filter(F.col("month") == month), path, partition_by=("year", "month"))
    return out.groupBy("year", "month").agg(F.count("*").alias("trips"))


def materialize_q(spark, sf):
    """Cleaned trips written once as Parquet partitioned by pickup year and month."""
    cleaned = with_year_month(clean(V.trips(spark, sf)), "pickup_ts")
    return materialize(cleaned, partition_by=("year", "month"), name="clean-trips")


def shape_report_q(spark, sf):
    return shape_report(V.trips(spark, sf))


QUERIES = {
    "csv_trips": csv_trips,
    "csv_tickets": csv_tickets,
    "csv_ticket_years": csv_ticket_years,
    "csv_tickets_inferred": csv_tickets_inferred,
    "csv_tickets_text": csv_tickets_text,
    "csv_trips_blank_line": csv_trips_blank_line,
    "csv_malformed": csv_malformed,
    "filter_text": filter_text,
    "materialize_table": materialize_table,
    "materialize_months": materialize_months,
    "materialize": materialize_q,
    "shape_report": shape_report_q,
}

