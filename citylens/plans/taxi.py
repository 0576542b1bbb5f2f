"""The taxi-trip study on the test view ``trips`` (registered queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citylens.plans import params as P
from citylens.plans.studies import TaxiStudy
from citylens.sources import views as V

# Column names of the test view for each role of the study.
VIEW_COLUMNS = {
    "vendor": "vendor_id",
    "pickup": "pickup_ts",
    "dropoff": "dropoff_ts",
    "passengers": "passenger_count",
    "distance": "trip_distance",
    "rate_code": "rate_code",
    "payment": "payment_type",
    "fare": "fare_amount",
    "extra": "extra",
    "tip": "tip_amount",
    "total": "total_amount",
}


def study(spark: SparkSession, sf: str) -> TaxiStudy:
    return TaxiStudy(
        V.trips(spark, sf),
        columns=dict(VIEW_COLUMNS),
        year=P.PERIOD_YEAR,
        months=P.PERIOD_MONTHS,
        holiday_month=P.HOLIDAY_MONTH,
        holiday_days=P.HOLIDAY_DAYS,
        bad_rate_code=P.BAD_RATE_CODE,
        tip_edges=P.TIP_EDGES,
    )


def clean(df: DataFrame) -> DataFrame:
    """In-period test trips (used by the ingest plans)."""
    return TaxiStudy(df, columns=dict(VIEW_COLUMNS), year=P.PERIOD_YEAR, months=P.PERIOD_MONTHS).clean()


def _query(method: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return getattr(study(spark, sf), method)()

    run.__name__ = method
    return run


QUERIES = {name: _query(name) for name in TaxiStudy.REPORTS}
QUERIES["clean_trips"] = QUERIES.pop("clean")
