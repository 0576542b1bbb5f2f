"""The two case studies as reusable analyses over any table with the right columns.

``TaxiStudy`` and ``ParkingStudy`` hold a trips / tickets DataFrame, a
column mapping (defaults: the headers of the real trip file and of a
normalised ticket file) and the study parameters.  Every method returns a
lazy DataFrame; ``reports()`` returns all of them by name.  The registered
test queries are these same methods applied to the test views.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.functions import parse_clock, season, time_bin
from citylens.functions.bins import bucketize
from citylens.functions.dates import in_periods, month_ranges, year_ranges
from citylens.functions.missing import TEXT_SENTINELS
from citylens.operators import (
    avg_by,
    avg_speed,
    avg_speed_vs_overall,
    bucket_share,
    clean_period,
    common_items,
    compare_years,
    correlation,
    count_by,
    count_date_parts,
    distinct_count,
    distinct_values,
    drop_missing,
    fine_revenue,
    fraction_where,
    freq_within_top_groups,
    mean_vs_median,
    missing_address,
    null_profile,
    out_of_period_count,
    pivot_years,
    revenue_total,
    rule_counts,
    sentinel_profile,
    stacked_counts,
    summary_percentiles,
    top_bins_for_top_items,
    top_k_per_group,
    top_n,
    top_revenue_code,
    trip_rules,
    worst_offender,
)
from citylens.operators._common import exclude_values
from citylens.sources.tables import materialize, union_months

# Headers of the monthly trip file.
TRIP_COLUMNS = {
    "vendor": "VendorID",
    "pickup": "tpep_pickup_datetime",
    "dropoff": "tpep_dropoff_datetime",
    "passengers": "passenger_count",
    "distance": "trip_distance",
    "rate_code": "RatecodeID",
    "payment": "payment_type",
    "fare": "fare_amount",
    "extra": "extra",
    "tip": "tip_amount",
    "total": "total_amount",
}

# Headers of a yearly ticket file after ``normalize_columns`` (spaces -> "_").
TICKET_COLUMNS = {
    "summons": "Summons_Number",
    "state": "Registration_State",
    "issue": "Issue_Date",
    "code": "Violation_Code",
    "body": "Vehicle_Body_Type",
    "make": "Vehicle_Make",
    "violation_precinct": "Violation_Precinct",
    "issuer_precinct": "Issuer_Precinct",
    "time": "Violation_Time",
    "house": "House_Number",
    "street": "Street_Name",
    "cross": "Intersecting_Street",
}


def _r(col: str, digits: int) -> Column:
    return F.round(col, digits).alias(col)


@dataclass
class TaxiStudy:
    """Audit and analysis of taxi trips for a period of months in one year."""

    trips: DataFrame
    columns: dict = field(default_factory=lambda: dict(TRIP_COLUMNS))
    year: int = 2017
    months: tuple = (11, 12)
    holiday_month: int = 12
    holiday_days: tuple = (25, 31)
    bad_rate_code: int = 99
    tip_edges: tuple = (0, 5, 10, 15, 20)
    # the in-period trips once written (``with_materialized_clean``); None: derived from ``trips``
    clean_table: DataFrame | None = None

    def c(self, key: str) -> str:
        return self.columns[key]

    # -- periods and rules --------------------------------------------------------
    @property
    def pickup_ranges(self):
        return month_ranges(self.year, self.months)

    @property
    def dropoff_ranges(self):
        return year_ranges([self.year, self.year + 1])

    def clean(self) -> DataFrame:
        """In-period trips: pickup in the months of the year, dropoff in that year or the next."""
        if self.clean_table is not None:
            return self.clean_table
        return clean_period(self.trips, {self.c("pickup"): self.pickup_ranges, self.c("dropoff"): self.dropoff_ranges})

    def with_materialized_clean(self, path: str | None = None) -> "TaxiStudy":
        """Write the in-period trips once (Parquet, partitioned by pickup year and month) and use them.

        The analysis reports all start from the clean trips; over raw CSV each
        would parse the whole file again.  After this they read the written
        table (shared storage below ``spark.checkpoint.dir`` by default), and
        a lost executor re-reads files instead of recomputing the cleaning.
        """
        pick = self.c("pickup")
        staged = self.clean().withColumn("pickup_year", F.year(pick)).withColumn("pickup_month", F.month(pick))
        written = materialize(staged, path, partition_by=("pickup_year", "pickup_month"), name="clean-trips")
        return replace(self, clean_table=written)

    def rules(self, with_rate_code: bool = False) -> dict[str, Column]:
        return trip_rules(
            distance=self.c("distance"),
            passengers=self.c("passengers"),
            fare=self.c("fare"),
            tip=self.c("tip"),
            total=self.c("total"),
            rate_code=self.c("rate_code") if with_rate_code else None,
            bad_rate_code=self.bad_rate_code,
        )

    def _in_pickup_period(self) -> DataFrame:
        return self.trips.filter(in_periods(self.c("pickup"), self.pickup_ranges))

    # -- audit ----------------------------------------------------------------------
    def vendor_counts(self):
        return count_by(self.trips, self.c("vendor")).orderBy(self.c("vendor"))

    def distinct_months(self):
        return distinct_values(self.trips, F.month(self.c("pickup")), "month")

    def distinct_years(self):
        return distinct_values(self.trips, F.year(self.c("pickup")), "year")

    def distinct_years_in_months(self):
        t = self.trips.filter(F.month(self.c("pickup")).isin(*self.months))
        return distinct_values(t, F.year(self.c("pickup")), "year")

    def distinct_dropoff_years(self):
        return distinct_values(self._in_pickup_period(), F.year(self.c("dropoff")), "year")

    def distinct_dropoff_months(self):
        return distinct_values(self.clean(), F.month(self.c("dropoff")), "month")

    def distinct_rate_codes(self):
        return distinct_values(self.clean(), self.c("rate_code"))

    def rule_counts(self):
        return rule_counts(self.clean(), self.rules())

    def rule_counts_by_vendor(self):
        return rule_counts(self.clean(), self.rules(True), by=self.c("vendor"))

    def worst_vendor(self):
        return worst_offender(self.clean(), self.rules(True), self.c("vendor"))

    def _vendor_by(self, df: DataFrame, part: Column, name: str) -> DataFrame:
        v = self.c("vendor")
        return count_by(df, [v, part.alias(name)]).orderBy(v, name)

    def vendor_month_counts(self):
        return self._vendor_by(self.trips, F.month(self.c("pickup")), "month")

    def vendor_year_counts(self):
        return self._vendor_by(self.trips, F.year(self.c("pickup")), "year")

    def vendor_year_counts_in_months(self):
        t = self.trips.filter(F.month(self.c("pickup")).isin(*self.months))
        return self._vendor_by(t, F.year(self.c("pickup")), "year")

    def vendor_dropoff_year_counts(self):
        return self._vendor_by(self._in_pickup_period(), F.year(self.c("dropoff")), "year")

    def vendor_dropoff_month_counts(self):
        return self._vendor_by(self.clean(), F.month(self.c("dropoff")), "month")

    def union_months(self):
        """The period rebuilt as a UNION ALL of its monthly parts (as monthly files are combined)."""
        parts = [clean_period(self.trips, {self.c("pickup"): month_ranges(self.year, [m])}) for m in self.months]
        return union_months(*parts)

    # -- analysis I -------------------------------------------------------------------
    def avg_fare_by_month(self):
        fare = self.c("fare")
        out = avg_by(self.clean(), F.month(self.c("pickup")).alias("month"), fare, where=F.col(fare) > 0, name="average_fare")
        return out.select("month", _r("average_fare", 2))

    def passenger_counts(self):
        p = self.c("passengers")
        return count_by(self.clean().filter(F.col(p) != 0), p).orderBy(p)

    def payment_counts(self):
        return count_by(self.clean(), self.c("payment")).orderBy(self.c("payment"))

    def top_payment(self):
        return top_n(self.clean(), self.c("payment"), 1)

    def _tips(self):
        return self.clean().filter(F.col(self.c("tip")) >= 0)

    def tip_percentiles(self):
        s = summary_percentiles(self._tips(), self.c("tip"))
        return s.select(*[_r(c, 2) for c in s.columns])

    def tip_percentiles_exact(self):
        s = summary_percentiles(self._tips(), self.c("tip"), exact=True)
        return s.select(*[_r(c, 6) for c in s.columns])

    def tip_percentiles_by_passengers(self):
        p = self.c("passengers")
        s = summary_percentiles(self._tips(), self.c("tip"), ps=(0.1, 0.25, 0.5, 0.75, 0.99), exact=True, by=p)
        return s.select(p, *[_r(c, 6) for c in s.columns if c != p])

    def tip_mean_vs_median(self):
        s = mean_vs_median(self._tips(), self.c("tip"), exact=True)
        return s.select(*[_r(c, 6) for c in s.columns])

    def extra_fraction(self):
        # an extra charge is anything but exactly 0; a missing value counts as charged
        out = fraction_where(self.clean(), F.col(self.c("extra")) != 0, null_as=True)
        return out.select(_r("percent", 2))

    # -- analysis II ------------------------------------------------------------------
    def passenger_tip_corr(self):
        p, t = self.c("passengers"), self.c("tip")
        out = correlation(self.clean(), p, t, where=(F.col(p) != 0) & (F.col(t) >= 0))
        return out.select(_r("corr", 4))

    def avg_tip_by_passengers(self):
        p = self.c("passengers")
        out = avg_by(self.clean(), p, self.c("tip"), where=F.col(p) != 0, name="average_tip")
        return out.select(p, _r("average_tip", 2)).orderBy(p)

    def tip_buckets(self):
        return count_by(self._tips().select(bucketize(self.c("tip"), self.tip_edges).alias("bucket")), "bucket")

    def tip_bucket_share(self):
        return bucket_share(self._tips(), self.c("tip"), self.tip_edges)

    def _speed_kw(self):
        return {"distance": self.c("distance"), "start": self.c("pickup"), "end": self.c("dropoff")}

    @staticmethod
    def _round_speed(df: DataFrame) -> DataFrame:
        return df.select(*[_r(c, 9) if c in ("avg_speed", "overall_speed", "diff") else F.col(c) for c in df.columns])

    def speed_by_month(self):
        return self._round_speed(avg_speed(self.clean(), F.month(self.c("pickup")).alias("month"), **self._speed_kw()))

    def speed_by_day(self):
        pick = self.c("pickup")
        starts = [dt.date(self.year, self.holiday_month, day) for day in self.holiday_days]
        holiday = in_periods(pick, [(d, d + dt.timedelta(days=1)) for d in starts])
        return self._round_speed(avg_speed(self.clean(), F.dayofmonth(pick).alias("day"), where=holiday, **self._speed_kw()))

    def speed_overall(self):
        return self._round_speed(avg_speed(self.clean(), **self._speed_kw()))

    def speed_vs_overall(self):
        return self._round_speed(avg_speed_vs_overall(self.clean(), F.month(self.c("pickup")).alias("month"), **self._speed_kw()))

    REPORTS = (
        "vendor_counts", "distinct_months", "distinct_years", "distinct_years_in_months",
        "distinct_dropoff_years", "distinct_dropoff_months", "distinct_rate_codes", "rule_counts",
        "rule_counts_by_vendor", "worst_vendor", "vendor_month_counts", "vendor_year_counts",
        "vendor_year_counts_in_months", "vendor_dropoff_year_counts", "vendor_dropoff_month_counts",
        "clean", "union_months", "avg_fare_by_month", "passenger_counts", "payment_counts", "top_payment",
        "tip_percentiles", "tip_percentiles_exact", "tip_percentiles_by_passengers", "tip_mean_vs_median", "extra_fraction",
        "passenger_tip_corr", "avg_tip_by_passengers", "tip_buckets", "tip_bucket_share",
        "speed_by_month", "speed_by_day", "speed_overall", "speed_vs_overall",
    )

    def reports(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name)() for name in self.REPORTS}


@dataclass
class ParkingStudy:
    """Examination and aggregation of one year's parking tickets."""

    tickets: DataFrame
    columns: dict = field(default_factory=lambda: dict(TICKET_COLUMNS))
    year: int = 2017
    date_format: str = "M/d/yyyy"
    top_n: int = 5
    top_k: int = 3
    common_per_group: int = 5
    compare_years: tuple = (2015, 2016, 2017)
    # the in-year tickets once written (``with_materialized_clean``); None: derived from ``tickets``
    clean_table: DataFrame | None = None

    def c(self, key: str) -> str:
        return self.columns[key]

    # -- dates ------------------------------------------------------------------------
    def issue(self) -> Column:
        """The issue date as a date/timestamp, parsing ``MM/dd/yyyy`` text when the column is text."""
        col = self.c("issue")
        if isinstance(self.tickets.schema[col].dataType, T.StringType):
            return F.try_to_date(F.col(col), self.date_format)
        return F.col(col)

    def in_year(self) -> DataFrame:
        col = self.c("issue")
        if isinstance(self.tickets.schema[col].dataType, T.StringType):
            return self.tickets.filter(F.year(self.issue()) == self.year)
        return clean_period(self.tickets, {col: year_ranges([self.year])})

    def clean(self) -> DataFrame:
        """The year's own tickets, from which every analysis starts; profiles and year comparisons see the whole file."""
        return self.in_year() if self.clean_table is None else self.clean_table

    def with_materialized_clean(self, path: str | None = None) -> "ParkingStudy":
        """Write the in-year tickets once (Parquet by issue year and month, in shared storage by default) and analyse that table.

        Years written to one path stay side by side, and a year that comes again replaces its own months.
        """
        issue = self.issue()
        staged = self.clean().withColumn("issue_year", F.year(issue)).withColumn("issue_month", F.month(issue))
        written = materialize(staged, path, partition_by=("issue_year", "issue_month"), name="clean-tickets")
        return replace(self, clean_table=written.filter(F.col("issue_year") == self.year))

    # -- examining ----------------------------------------------------------------------
    def ticket_count(self):
        return distinct_count(self.clean(), self.c("summons"))

    def ticket_count_in_year(self):
        return distinct_count(self.in_year(), self.c("summons"))

    def state_count(self):
        return distinct_count(self.clean(), self.c("state"))

    def state_count_with_null(self):
        return distinct_count(self.clean(), self.c("state"), include_null=True)

    def street_count_with_null(self):
        return distinct_count(self.clean(), self.c("street"), include_null=True)

    def out_of_year_count(self):
        col = self.c("issue")
        if isinstance(self.tickets.schema[col].dataType, T.StringType):
            d = self.issue()
            return self.tickets.agg(F.count_if(d.isNotNull() & (F.year(d) != self.year)).alias("n"))
        (lo, hi), = year_ranges([self.year])
        return out_of_period_count(self.tickets, col, lo, hi)

    def null_profile(self):
        return null_profile(self.tickets, [self.c(k) for k in ("house", "street", "cross", "body", "make")])

    def sentinel_profile(self):
        spec = {
            self.c("code"): ("0",),
            self.c("violation_precinct"): ("0",),
            self.c("issuer_precinct"): ("0",),
            self.c("street"): TEXT_SENTINELS,
            self.c("cross"): TEXT_SENTINELS,
        }
        return sentinel_profile(self.tickets, spec)

    def missing_address_any(self):
        return missing_address(self.clean(), [self.c("house"), self.c("street")], how="any")

    def missing_address_all(self):
        return missing_address(self.clean(), [self.c(k) for k in ("house", "street", "cross")], how="all", sentinels=TEXT_SENTINELS)

    # -- aggregation ----------------------------------------------------------------------
    def top_codes(self):
        return top_n(self.clean(), self.c("code"), self.top_n, exclude=(0, None))

    def top_body_types(self):
        return top_n(self.clean(), self.c("body"), self.top_n, exclude=(None,))

    def top_makes(self):
        return top_n(self.clean(), self.c("make"), self.top_n, exclude=(None,))

    def top_violation_precincts(self):
        return top_n(self.clean(), self.c("violation_precinct"), self.top_n, exclude=(0, None))

    def top_issuer_precincts(self):
        return top_n(self.clean(), self.c("issuer_precinct"), self.top_n, exclude=(0, None))

    def house_number_counts(self):
        # n(col) semantics: the NULL group is kept and counts 0 non-null values
        return count_by(self.clean(), self.c("house"), of=self.c("house"))

    def codes_in_top_precincts(self):
        return freq_within_top_groups(self.clean(), self.c("issuer_precinct"), self.c("code"), self.top_k)

    def codes_in_top_precincts_pooled(self):
        return freq_within_top_groups(self.clean(), self.c("issuer_precinct"), self.c("code"), self.top_k, pooled=True)

    def common_codes(self):
        return common_items(self.clean(), self.c("issuer_precinct"), self.c("code"), self.top_k, self.common_per_group)

    def stacked_precinct_codes(self):
        return stacked_counts(self.clean(), self.c("issuer_precinct"), self.c("code"), k=self.top_k)

    # -- time of day -----------------------------------------------------------------------
    def _hours(self, lenient: bool = False) -> DataFrame:
        with_hour = self.clean().withColumn("hour", parse_clock(self.c("time"), lenient=lenient))
        return drop_missing(with_hour, ["hour"])

    def clock_hours(self):
        return self._hours().select(self.c("summons"), self.c("code"), "hour")

    def clock_hours_lenient(self):
        return self._hours(lenient=True).select(self.c("summons"), self.c("code"), "hour")

    def clock_missing(self):
        return sentinel_profile(self.tickets, {self.c("time"): TEXT_SENTINELS})

    def binned(self, closed: str = "left", labels=None) -> DataFrame:
        return self._hours().select(self.c("code"), time_bin("hour", closed=closed, labels=labels).alias("bin"))

    def time_bin_left(self):
        return count_by(self.binned(), ["bin", self.c("code")])

    def time_bin_labelled(self):
        return count_by(self.binned(labels=True), ["bin", self.c("code")])

    def time_bin_right(self):
        return count_by(self.binned(closed="right"), ["bin", self.c("code")])

    def top_codes_per_bin(self):
        return top_k_per_group(self.binned(), "bin", self.c("code"), self.top_k)

    def top_bins_per_code(self, exclude=(0, None)):
        return top_bins_for_top_items(self.binned(), self.c("code"), "bin", self.top_k, self.top_k, exclude=exclude)

    # -- seasons ----------------------------------------------------------------------------
    def seasons(self, labels=None) -> DataFrame:
        return self.clean().select(self.c("code"), season(F.month(self.issue()), labels=labels).alias("season"))

    def season_counts(self):
        return count_by(self.seasons(), "season").orderBy("season")

    def season_counts_labelled(self):
        return count_by(self.seasons(labels=True), "season")

    def top_codes_per_season(self):
        return top_k_per_group(self.seasons(), "season", self.c("code"), self.top_k)

    def date_parts(self):
        col = self.c("issue")
        if isinstance(self.tickets.schema[col].dataType, T.StringType):
            return count_date_parts(self.tickets, col, self.date_format, year="issue_year", month="issue_month")
        d = self.tickets.select(F.year(col).alias("issue_year"), F.month(col).alias("issue_month"))
        return count_by(d, ["issue_year", "issue_month"])

    # -- revenue and years ---------------------------------------------------------------
    def revenue(self, fines: DataFrame) -> DataFrame:
        return fine_revenue(self.clean(), fines, self.c("code"), self.top_k)

    def fine_revenue(self, fines: DataFrame):
        r = self.revenue(fines)
        return r.select(self.c("code"), "tickets", _r("avg_fine", 2), _r("total", 2))

    def revenue_total(self, fines: DataFrame):
        return revenue_total(self.revenue(fines)).select(_r("total", 2), "tickets_without_fine")

    def top_revenue_code(self, fines: DataFrame):
        return top_revenue_code(self.revenue(fines), self.c("code")).select(self.c("code"), _r("total", 2))

    def yearly_comparison(self):
        counts = {"tickets": self.c("summons"), "states": self.c("state")}
        return compare_years(self.tickets, F.year(self.issue()), {}, distinct=counts)

    def yearly_code_comparison(self):
        code = self.c("code")
        t = exclude_values(self.tickets, code, (0, None))
        return compare_years(t, F.year(self.issue()), {"tickets": F.count(F.lit(1))}, by=code)

    def yearly_code_pivot(self):
        code = self.c("code")
        t = exclude_values(self.tickets, code, (0, None))
        return pivot_years(t, F.year(self.issue()), self.compare_years, code, F.count(F.lit(1)), fill=0)

    REPORTS = (
        "ticket_count", "ticket_count_in_year", "state_count", "state_count_with_null",
        "street_count_with_null", "out_of_year_count", "null_profile", "sentinel_profile",
        "missing_address_any", "missing_address_all", "top_codes", "top_body_types", "top_makes",
        "top_violation_precincts", "top_issuer_precincts", "house_number_counts", "codes_in_top_precincts",
        "codes_in_top_precincts_pooled", "common_codes", "stacked_precinct_codes", "clock_hours",
        "clock_hours_lenient", "clock_missing", "time_bin_left", "time_bin_labelled", "time_bin_right",
        "top_codes_per_bin", "top_bins_per_code", "season_counts", "season_counts_labelled",
        "top_codes_per_season", "date_parts", "yearly_comparison", "yearly_code_comparison", "yearly_code_pivot",
    )

    def reports(self, fines: DataFrame | None = None) -> dict[str, DataFrame]:
        out = {name: getattr(self, name)() for name in self.REPORTS}
        if fines is not None:
            out.update(
                fine_revenue=self.fine_revenue(fines),
                revenue_total=self.revenue_total(fines),
                top_revenue_code=self.top_revenue_code(fines),
            )
        return out
