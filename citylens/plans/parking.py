"""The parking-ticket study on the test views ``tickets``, ``clock_tickets`` and ``fines`` (registered queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citylens.operators import drop_sparse_columns, fine_revenue, fine_table, normalize_columns, select_range
from citylens.plans import params as P
from citylens.plans.studies import ParkingStudy
from citylens.sources import views as V

# Column names of the test views for each role of the study.
VIEW_COLUMNS = {
    "summons": "summons_number",
    "state": "registration_state",
    "issue": "issue_ts",
    "code": "violation_code",
    "body": "vehicle_body_type",
    "make": "vehicle_make",
    "violation_precinct": "violation_precinct",
    "issuer_precinct": "issuer_precinct",
    "house": "house_number",
    "street": "street_name",
    "cross": "intersecting_street",
}
CLOCK_COLUMNS = {"summons": "event_id", "issue": "issue_ts", "code": "violation_code", "time": "violation_time"}

# Header names as a ticket file would carry them (spaces, trailing blanks, "?").
DISPLAY_NAMES = {
    "summons_number": "Summons Number",
    "registration_state": "Registration State",
    "issue_ts": "Issue Date",
    "violation_code": "Violation Code",
    "vehicle_body_type": "Vehicle Body Type",
    "vehicle_make": "Vehicle Make",
    "violation_precinct": "Violation Precinct",
    "issuer_precinct": "Issuer Precinct",
    "house_number": "House Number  ",
    "street_name": "Street Name?",
    "intersecting_street": "Intersecting Street",
}


def study(df: DataFrame, columns: dict, year: int = P.TICKET_YEAR) -> ParkingStudy:
    return ParkingStudy(
        df,
        columns=dict(columns),
        year=year,
        top_n=P.TOP_N,
        top_k=P.TOP_K,
        common_per_group=P.COMMON_PER_GROUP,
        compare_years=P.COMPARE_YEARS,
    )


def tickets_study(spark: SparkSession, sf: str) -> ParkingStudy:
    return study(V.tickets(spark, sf), VIEW_COLUMNS)


def clock_study(spark: SparkSession, sf: str) -> ParkingStudy:
    return study(V.clock_tickets(spark, sf), CLOCK_COLUMNS, P.CLOCK_YEAR)


def _on_tickets(method: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return getattr(tickets_study(spark, sf), method)()

    run.__name__ = method
    return run


def _on_clock(method: str, **kw):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return getattr(clock_study(spark, sf), method)(**kw)

    run.__name__ = method
    return run


def _on_fines(method: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return getattr(tickets_study(spark, sf), method)(V.fines(spark, sf))

    run.__name__ = method
    return run


def date_parts(spark, sf):
    # The ticket file carries the date as MM/dd/yyyy text: parse it once, then take the parts.
    t = V.tickets(spark, sf).select(F.date_format("issue_ts", "MM/dd/yyyy").alias("issue_date"))
    return study(t, {"issue": "issue_date"}).date_parts()


def fine_revenue_stated(spark, sf):
    """Every code's revenue by the stated fines, one of which is only an average."""
    t = study(V.tickets(spark, sf), VIEW_COLUMNS)
    stated = fine_table(spark)
    return fine_revenue(t.clean(), stated, "violation_code", k=50).select(
        "violation_code", "tickets", "avg_fine", "total"
    )


# -- column tidying ----------------------------------------------------------------

def drop_sparse(spark, sf):
    return drop_sparse_columns(V.tickets(spark, sf), max_missing=P.SPARSE_MAX_MISSING)


def normalize_columns_q(spark, sf):
    t = V.tickets(spark, sf)
    raw = t.toDF(*[DISPLAY_NAMES[c] for c in t.columns])
    return normalize_columns(raw, lower=True).withColumnRenamed("issue_date", "issue_ts")


def select_range_q(spark, sf):
    return select_range(V.tickets(spark, sf), 0, 5)


_TICKET_METHODS = (
    "ticket_count", "ticket_count_in_year", "state_count", "state_count_with_null", "street_count_with_null",
    "out_of_year_count", "null_profile", "sentinel_profile", "missing_address_any", "missing_address_all",
)
_AGG_METHODS = (
    "top_codes", "top_body_types", "top_makes", "top_violation_precincts", "top_issuer_precincts",
    "house_number_counts", "codes_in_top_precincts", "codes_in_top_precincts_pooled", "common_codes",
    "stacked_precinct_codes",
)
_CLOCK_METHODS = (
    "clock_hours", "clock_hours_lenient", "clock_missing", "time_bin_left", "time_bin_labelled",
    "time_bin_right", "top_codes_per_bin",
)
_SEASON_YEAR_METHODS = (
    "season_counts", "season_counts_labelled", "top_codes_per_season",
)

QUERIES = {}
QUERIES.update({m: _on_tickets(m) for m in _TICKET_METHODS})
QUERIES.update(
    {"drop_sparse": drop_sparse, "normalize_columns": normalize_columns_q, "select_range": select_range_q}
)
QUERIES.update({m: _on_tickets(m) for m in _AGG_METHODS})
QUERIES.update({m: _on_clock(m) for m in _CLOCK_METHODS})
# violation codes of the clock view are text: only NULL is excluded from the top codes
QUERIES["top_bins_per_code"] = _on_clock("top_bins_per_code", exclude=(None,))
QUERIES.update({m: _on_tickets(m) for m in _SEASON_YEAR_METHODS})
QUERIES["date_parts"] = date_parts
QUERIES["fine_revenue_stated"] = fine_revenue_stated
QUERIES.update({m: _on_fines(m) for m in ("fine_revenue", "revenue_total", "top_revenue_code")})
QUERIES.update({m: _on_tickets(m) for m in ("yearly_comparison", "yearly_code_comparison", "yearly_code_pivot")})
