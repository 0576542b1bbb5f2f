"""Keeping the tables: mixed folders, rejected lines, audits that follow the loads (registered queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citylens.functions import from_epoch, speed_mph, to_epoch
from citylens.functions.dates import in_periods
from citylens.operators import (
    count_bitmaps,
    distinct_bitmaps,
    fine_revenue_by_year,
    rollup_reports,
    top_n_bounded,
    trip_rules,
    value_numbers,
)
from citylens.plans import params as P
from citylens.plans.ingest import _trip_lines
from citylens.plans.parking import tickets_study
from citylens.plans.taxi import study
from citylens.session import scratch_path
from citylens.sources import materialize, materialize_audited, read_trips, split_rejects, with_year_month, write_csv
from citylens.sources import views as V
from citylens.sources.folders import read_mixed_folder
from citylens.sources.ledger import AuditLedger, Rule
from citylens.sources.loads import LoadedTable


def audit_ledger(spark, sf):
    """A year of trips loaded and audited, a month reloaded and a rule changed: the counts of the table as it is."""
    trips = with_year_month(V.trips(spark, sf), "pickup_ts").filter(F.col("year") == P.PERIOD_YEAR)
    path = scratch_path(spark, "ledger-trips")
    table = materialize(trips, path, partition_by=("year", "month"))
    ledger = AuditLedger(spark, path, scratch_path(spark, "audit-ledger"), by="vendor_id")
    rules = {name: Rule(p) for name, p in trip_rules(rate_code="rate_code", bad_rate_code=P.BAD_RATE_CODE).items()}
    ledger.update(rules)
    # November comes again without its standing trips
    again = materialize(table.filter((F.col("month") == 11) & (F.col("trip_distance") != 0)), name="november")
    materialize(again, path, partition_by=("year", "month"))
    rules["rate_code_invalid"] = Rule(F.col("rate_code") >= P.BAD_RATE_CODE - 4, version=2)
    ledger.update(rules)
    return ledger.counts(rules)


#: The layouts of the mixed folder: years up to the first, up to the second, and the rest.
LAYOUT_YEARS = (1996, 1998)


def csv_mixed_folder(spark, sf):
    """One folder of ticket files in three layouts: columns that come, go and move, numbers that become text."""
    t = V.tickets(spark, sf)
    layout = F.when(F.year("issue_ts") <= LAYOUT_YEARS[0], "a").when(F.year("issue_ts") <= LAYOUT_YEARS[1], "b").otherwise("c")
    once = materialize(t.select(
        F.col("summons_number").alias("Summons Number"), F.date_format("issue_ts", "MM/dd/yyyy").alias("Issue Date"),
        F.col("violation_code").alias("Violation Code"), F.col("violation_precinct").alias("Violation Precinct"),
        F.col("house_number").alias("House Number  "), F.col("intersecting_street").alias("Intersecting Street"),
        layout.alias("layout"),
    ), name="layouts")
    one = {name: once.filter(F.col("layout") == name).drop("layout") for name in "abc"}
    half = (F.col("Violation Precinct") + 0.5).alias("Violation Precinct")
    meter = F.concat(F.lit("M-"), (F.col("Summons Number") % 7).cast("string")).alias("Meter Number")
    house = F.concat(F.col("House Number  ").cast("string"), F.lit("B")).alias("House Number")
    number = (F.col("Summons Number") + 3_000_000_000).alias("Summons Number")
    shaped = {
        "a": one["a"],
        "b": one["b"].select("Summons Number", "Issue Date", "Violation Code", half, "House Number  ", meter),
        "c": one["c"].select("Violation Code", house, "Issue Date", "Intersecting Street", number, "Violation Precinct"),
    }
    root = scratch_path(spark, "mixed-folder")
    for name, df in shaped.items():
        write_csv(df, f"{root}/{name}")
    return read_mixed_folder(spark, root, lower=True)


def csv_quarantine(spark, sf):
    """Trip lines with a text for a number, a field too few or too many: accepted, and rejected by column and reason."""
    path, schema = _trip_lines(spark, sf, odd="six", torn=True)
    split = split_rejects(spark, f"{path}/*/*/", schema)
    n = F.count(F.lit(1)).alias("n")
    accepted = split.accepted.agg(n).select(F.lit(None).cast("string").alias("column"), F.lit("accepted").alias("reason"), "n")
    return accepted.unionByName(split.rejected.groupBy("column", "reason").agg(n))


def audit_while_writing(spark, sf):
    """The clean table is written and its audit counted in the pass that writes it."""
    s = study(spark, sf)
    inside = in_periods(s.c("pickup"), s.pickup_ranges) & in_periods(s.c("dropoff"), s.dropoff_ranges)
    rules = {name: inside & predicate for name, predicate in s.rules(True).items()}
    rules["out_of_period"] = ~inside
    table, counts = materialize_audited(with_year_month(s.trips, s.c("pickup")), rules, keep=inside, partition_by=("year", "month"))
    counted = spark.createDataFrame(sorted(counts.items()), "rule string, n long")
    return counted.unionByName(table.agg(F.count(F.lit(1)).alias("n")).select(F.lit("written").alias("rule"), "n"))


def distinct_rollup(spark, sf):
    """Distinct tickets and states per year and overall, merged from bitmaps stored per month."""
    t = with_year_month(V.tickets(spark, sf), "issue_ts")
    t = materialize(t.select("year", "month", "summons_number", F.col("registration_state").cast("string").alias("state")), name="rollup-tickets")
    numbers = value_numbers(t, "state", scratch_path(spark, "state-numbers"))
    states = t.select("year", "month", "state").distinct().join(numbers, F.col("state") == F.col("value"))
    measures = {"tickets": (t, "summons_number"), "states": (states, "number")}
    bits = {name: distinct_bitmaps(df, ["year", "month"], col).withColumn("measure", F.lit(name)) for name, (df, col) in measures.items()}
    stored = materialize(bits["tickets"].unionByName(bits["states"]), partition_by=("measure", "year"), name="distinct-bitmaps")
    of = lambda name: stored.filter(F.col("measure") == name)
    by_year = count_bitmaps(of("tickets"), "year", "tickets").join(count_bitmaps(of("states"), "year", "states"), "year", "left")
    overall = count_bitmaps(of("tickets"), name="tickets").withColumn("states", count_bitmaps(of("states")).scalar())
    overall = overall.select(F.lit(None).cast("int").alias("year"), "tickets", "states")
    return by_year.select("year", "tickets", F.coalesce("states", F.lit(0)).alias("states")).unionByName(overall)


def one_pass_reports(spark, sf):
    """Trips per provider, month and year, and the speed reports of the clean trips, from one reduction."""
    s = study(spark, sf)
    pick = s.c("pickup")
    inside = in_periods(pick, s.pickup_ranges) & in_periods(s.c("dropoff"), s.dropoff_ranges)
    moving = inside & (F.col(s.c("distance")) != 0)
    speed = F.when(moving, speed_mph(s.c("distance"), pick, s.c("dropoff")))
    out = rollup_reports(
        s.trips,
        {"vendor_id": F.col(s.c("vendor")), "year": F.year(pick), "month": F.month(pick)},
        {"vendors": ["vendor_id"], "vendor_months": ["vendor_id", "month"], "vendor_years": ["vendor_id", "year"], "months": ["month"], "overall": []},
        {"speed": speed, "speeds": speed.isNotNull().cast("int")},
        name="trips",
    )
    return out.select("report", "vendor_id", "year", "month", "trips", "speeds", F.round(F.try_divide("speed", "speeds"), 9).alias("avg_speed"))


#: The day the fines of zone ``a`` rise, and the one from which those of zone ``b`` of every fifth code hold no longer.
FINE_CHANGE, FINE_END = "1997-07-01", "1996-03-01"


def dated_fines(spark, sf):
    """Fines per code and zone with their periods: zone ``a`` rises once, some of zone ``b`` end."""
    p = V.table(spark, sf, "part").filter("p_size % 3 <> 0").groupBy(F.col("p_size").alias("violation_code")).agg(
        F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    date = lambda text: F.lit(text).cast("date")
    period = lambda zone, start, end, fine: F.struct(
        F.lit(zone).alias("zone"), date(start).alias("valid_from"), end.alias("valid_to"), fine.alias("fine"))
    periods = F.array(
        period("a", "1993-01-01", date(None), F.col("low")),
        period("a", FINE_CHANGE, date(None), F.col("low") + 10),
        period("b", "1993-01-01", F.when(F.col("violation_code") % 5 == 0, date(FINE_END)), F.col("high")),
    )
    return p.select("violation_code", F.inline(periods))


def fine_revenue_by_year_q(spark, sf):
    """Every ticket at the fine of its day and zone."""
    zone = F.when(F.col("violation_precinct") < 12, "a").otherwise("b")
    out = fine_revenue_by_year(V.tickets(spark, sf), dated_fines(spark, sf), zone=zone)
    return out.withColumn("total", F.round("total", 2))


def top_codes_bounded(spark, sf):
    """The top codes by a sketch and an exact second pass."""
    s = tickets_study(spark, sf)
    return top_n_bounded(s.clean(), s.c("code"), s.top_n, exclude=(0, None))


def top_tickets_bounded(spark, sf):
    """Ticket numbers with most lines: nearly equal counts, which a small sketch cannot separate."""
    s = tickets_study(spark, sf)
    return top_n_bounded(s.clean(), s.c("summons"), s.top_n, tracked=64)


def idempotent_loads(spark, sf):
    """Two monthly folders, one of them offered twice and once more under another name."""
    s = study(spark, sf)
    cols = ["vendor_id", "pickup_ts", "passenger_count", "fare_amount"]
    trips = s.trips.filter(in_periods(s.c("pickup"), s.pickup_ranges)).select(*cols)
    schema = trips.schema
    root = scratch_path(spark, "monthly-files")
    november, december = F.month("pickup_ts") == 11, F.month("pickup_ts") == 12
    write_csv(trips.filter(november), f"{root}/nov")
    loads = LoadedTable(spark, scratch_path(spark, "loaded-trips"))
    read = lambda paths: read_trips(spark, paths, schema=schema)
    loads.load(root, read)
    loads.load(root, read)
    # the same files by another name, and the next month
    write_csv(read_trips(spark, f"{root}/nov", schema=schema), f"{root}/nov-again")
    write_csv(trips.filter(december), f"{root}/dec")
    loads.load(root, read)
    return loads.table().groupBy(F.month("pickup_ts").alias("month")).agg(
        F.count(F.lit(1)).alias("trips"), F.sum("passenger_count").alias("passengers"), F.round(F.sum("fare_amount"), 2).alias("fares"))


def epoch_round_trip(spark, sf):
    """Issue dates as text, as seconds and as text again, counted."""
    t = V.tickets(spark, sf).select(F.date_format("issue_ts", "MM/dd/yyyy").alias("issue_date"))
    days = t.groupBy("issue_date").agg(F.count(F.lit(1)).alias("tickets")).withColumn("seconds", to_epoch("issue_date"))
    return days.select("issue_date", "tickets", "seconds", from_epoch("seconds").alias("day"), from_epoch("seconds", "yyyy").cast("int").alias("year"))


QUERIES = {
    "audit_ledger": audit_ledger,
    "csv_mixed_folder": csv_mixed_folder,
    "csv_quarantine": csv_quarantine,
    "audit_while_writing": audit_while_writing,
    "distinct_rollup": distinct_rollup,
    "one_pass_reports": one_pass_reports,
    "fine_revenue_by_year": fine_revenue_by_year_q,
    "top_codes_bounded": top_codes_bounded,
    "top_tickets_bounded": top_tickets_bounded,
    "idempotent_loads": idempotent_loads,
    "epoch_round_trip": epoch_round_trip,
}
