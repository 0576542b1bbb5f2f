"""Views over the synthetic TPC-H-like test tables that play trips, tickets and fines.

Every view is a lazy DataFrame over the given Parquet tables, so a query
on it scans only the columns it needs and gets its filters pushed into
the scans.  No join is hinted: Catalyst/AQE choose the strategy from the
measured sizes (sort-merge at scale, broadcast only when a side is
measured small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


TRIP_FARE = "CASE WHEN l_suppkey % 19 = 7 THEN 0.0D ELSE l_extendedprice - 5000 END"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxi-trip-shaped rows, dirty on purpose.

    0 passengers, 0 distance, fare and total < 0 and = 0, tip < 0, no extra, dropoff <= pickup.
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        F.col("l_returnflag").alias("vendor_id"),
        F.col("o_orderdate").alias("pickup_ts"),
        F.col("l_shipdate").alias("dropoff_ts"),
        (F.col("l_linenumber") - 1).alias("passenger_count"),
        (F.col("l_quantity") - 1).alias("trip_distance"),
        F.col("l_suppkey").alias("rate_code"),
        F.col("o_orderpriority").alias("payment_type"),
        F.expr(TRIP_FARE).alias("fare_amount"),
        F.expr("CASE WHEN l_suppkey % 13 <> 5 THEN l_tax END").alias("extra"),
        F.expr("l_discount * 250 * CASE WHEN l_suppkey % 17 = 3 THEN -1 ELSE 1 END").alias("tip_amount"),
        F.expr(f"{TRIP_FARE} * (1 + l_tax)").alias("total_amount"),
    )


#: "NA" and empty text stand for a missing street here and there.
STREET = "CASE WHEN {1} % 31 = 2 THEN 'NA' WHEN {1} % 31 = 9 THEN '' ELSE {0} END"


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parking-ticket-shaped rows with missing address parts, states and codes, and 0 as "unknown".

    Orders meet their customers first, so the large table is dealt by two keys only.
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    p = table(spark, sf_dir, "part")
    c = table(spark, sf_dir, "customer")
    j = (
        li.join(o.join(c, o.o_custkey == c.c_custkey, "inner"), li.l_orderkey == o.o_orderkey, "inner")
        .join(p, li.l_partkey == p.p_partkey, "inner")
    )
    return j.select(
        F.col("l_orderkey").alias("summons_number"),
        F.nullif(F.col("c_nationkey"), F.lit(24)).alias("registration_state"),
        F.col("o_orderdate").alias("issue_ts"),
        F.expr("CASE WHEN p_size = 50 THEN 0 WHEN p_size <> 49 THEN p_size END").alias("violation_code"),
        F.expr("CASE WHEN l_partkey % 23 <> 4 THEN p_type END").alias("vehicle_body_type"),
        F.expr("CASE WHEN l_partkey % 29 <> 6 THEN p_brand END").alias("vehicle_make"),
        (F.col("l_suppkey") % 25).alias("violation_precinct"),
        (F.col("l_suppkey") % 20).alias("issuer_precinct"),
        F.nullif(F.col("l_linenumber"), F.lit(7)).alias("house_number"),
        F.expr(STREET.format("nullif(l_returnflag, 'A')", "l_suppkey")).alias("street_name"),
        F.expr(STREET.format("nullif(l_linestatus, 'O')", "l_partkey")).alias("intersecting_street"),
    )


def clock_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets carrying the ``hhmm`` + ``A``/``P`` clock text (``0143A``), some of it odd, some of another year."""
    ev = table(spark, sf_dir, "events")
    clock = F.substring(F.date_format("ts", "hhmma"), 1, 5)
    odd = F.col("event_id") % 41
    text = F.when(odd == 1, F.concat(F.lit("00"), F.substring(clock, 3, 3)))
    for value, replacement in ((2, "1300A"), (3, "NA"), (4, ""), (5, None), (6, "2517P"), (7, "0860A")):
        text = text.when(odd == value, F.lit(replacement))
    return ev.select(
        "event_id",
        F.col("event_type").alias("violation_code"),
        F.col("user_id").alias("precinct"),
        "ts",
        F.expr("CASE WHEN event_id % 10 = 3 THEN ts - INTERVAL 1 YEAR ELSE ts END").alias("issue_ts"),
        text.otherwise(clock).alias("violation_time"),
    )


def fines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fine "zones" per violation code; every third code has none, every fifth only an average."""
    p = table(spark, sf_dir, "part").filter("p_size % 3 <> 0")
    zone = "CASE WHEN p_size % 5 <> 0 THEN p_retailprice END"
    return p.groupBy(F.col("p_size").alias("violation_code")).agg(
        F.min(F.expr(zone)).alias("fine_zone_a"), F.max(F.expr(zone)).alias("fine_zone_b"),
        F.max(F.expr("CASE WHEN p_size % 5 = 0 THEN p_retailprice END")).alias("average"),
    )


def register(spark: SparkSession, sf_dir: str) -> None:
    """Register the views as session temp views (``trips``, ``tickets``, ``clock_tickets``, ``fines``) for ``spark.sql``."""
    for name, build in (("trips", trips), ("tickets", tickets), ("clock_tickets", clock_tickets), ("fines", fines)):
        build(spark, sf_dir).createOrReplaceTempView(name)
