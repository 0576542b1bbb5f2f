"""Column -> Column building blocks (all built-in Spark expressions, codegen'd)."""

from citylens.functions.bins import bucket_labels, bucketize, season, time_bin
from citylens.functions.clock import parse_clock
from citylens.functions.dates import (
    in_period,
    in_periods,
    month_ranges,
    parse_date,
    year_ranges,
)
from citylens.functions.epoch import from_epoch, to_epoch
from citylens.functions.missing import is_missing
from citylens.functions.speed import duration_seconds, speed_mph

__all__ = [
    "bucket_labels", "bucketize", "season", "time_bin", "parse_clock", "in_period",
    "in_periods", "month_ranges", "parse_date", "year_ranges", "is_missing",
    "duration_seconds", "speed_mph", "from_epoch", "to_epoch",
]
