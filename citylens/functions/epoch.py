"""Epoch seconds and text, as wall-clock times: the session's time zone plays no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citylens.functions._util import as_col

_START = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def to_epoch(col: Column | str, fmt: str = "M/d/yyyy") -> Column:
    """Seconds since 1970 of a date or time text; NULL (not an error) for text that does not parse."""
    at = F.try_to_timestamp(as_col(col), F.lit(fmt)).cast("timestamp_ntz")
    day = F.unix_date(F.to_date(at)).cast("bigint")
    return day * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def from_epoch(col: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Text of seconds since 1970, by default the date."""
    return F.date_format(F.expr(_START) + F.make_dt_interval(secs=as_col(col)), fmt)
