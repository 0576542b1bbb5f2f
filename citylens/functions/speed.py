"""Trip duration and speed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citylens.functions._util import as_col


def duration_seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from ``start`` to ``end`` (negative if ``end`` is earlier).

    Each side is taken as epoch seconds first, as ``unix_timestamp(end) -
    unix_timestamp(start)`` does; for ``TIMESTAMP_NTZ`` the result does not
    depend on the session time zone.
    """
    return F.unix_timestamp(as_col(end)) - F.unix_timestamp(as_col(start))


def speed_mph(distance: Column | str, start: Column | str, end: Column | str) -> Column:
    """Miles per hour; NULL for a zero-length interval instead of a division error."""
    hours = duration_seconds(start, end) / F.lit(3600.0)
    return F.try_divide(as_col(distance), hours)
