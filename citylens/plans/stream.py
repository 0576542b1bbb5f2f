"""Streaming form of the per-provider audit: trips arrive as CSV files, counts are kept in state."""

from __future__ import annotations

from pyspark.sql import types as T

from citylens.operators import trip_rules
from citylens.operators.quality import _long_form
from citylens.plans import params as P
from citylens.session import scratch_path
from citylens.sources import views as V
from citylens.sources import write_csv
from citylens.streaming import incremental_count_by, incremental_rule_counts, read_csv_stream, run_available


def _landed_trips(spark, sf):
    """Write the trips as CSV files and stream them."""
    trips = V.trips(spark, sf)
    root = scratch_path(spark, "trip-files")
    write_csv(trips.hint("rebalance"), root)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in trips.schema.fields])
    return read_csv_stream(spark, root, schema)


def stream_rule_counts(spark, sf):
    rules = trip_rules(rate_code="rate_code", bad_rate_code=P.BAD_RATE_CODE)
    wide = incremental_rule_counts(_landed_trips(spark, sf), rules, by="vendor_id")
    return run_available(wide, "rule-counts", finish=lambda b: _long_form(b, ["vendor_id"], list(rules), "rule", "n_bad"))


def stream_vendor_counts(spark, sf):
    return run_available(incremental_count_by(_landed_trips(spark, sf), "vendor_id"), "vendor-counts")


QUERIES = {
    "stream_rule_counts": stream_rule_counts,
    "stream_vendor_counts": stream_vendor_counts,
}
