"""Period predicates and date parsing.

Periods are expressed as half-open timestamp ranges.  A range comparison
reaches the Parquet reader as a pushed filter (row groups outside the
period are skipped); ``year(ts) = 2017 AND month(ts) IN (11, 12)`` would
not.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from citylens.functions._util import as_col

Bound = str | dt.date | dt.datetime
Range = tuple[Bound, Bound]


def _text(b: Bound) -> str:
    if isinstance(b, dt.datetime):
        return b.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(b, dt.date):
        return b.strftime("%Y-%m-%d 00:00:00")
    return b if len(b) > 10 else f"{b} 00:00:00"


def in_period(col: Column | str, start: Bound | None, end: Bound | None) -> Column:
    """``start <= col < end``; either bound may be None (open)."""
    c = as_col(col)
    conds = []
    if start is not None:
        conds.append(c >= F.lit(_text(start)))
    if end is not None:
        conds.append(c < F.lit(_text(end)))
    if not conds:
        return c.isNotNull()
    out = conds[0]
    for extra in conds[1:]:
        out = out & extra
    return out


def in_periods(col: Column | str, ranges: Iterable[Range]) -> Column:
    """OR of half-open ranges."""
    out = None
    for start, end in ranges:
        cond = in_period(col, start, end)
        out = cond if out is None else (out | cond)
    if out is None:
        raise ValueError("need at least one range")
    return out


def _month_start(year: int, month: int) -> dt.date:
    return dt.date(year + (month - 1) // 12, (month - 1) % 12 + 1, 1)


def month_ranges(year: int, months: Sequence[int]) -> list[tuple[dt.date, dt.date]]:
    """Merge a month set of one year into contiguous ``[start, end)`` ranges.

    ``month_ranges(2017, [11, 12])`` -> ``[(2017-11-01, 2018-01-01)]``.
    """
    ms = sorted(set(months))
    if any(m < 1 or m > 12 for m in ms):
        raise ValueError("months are 1-12")
    out: list[tuple[dt.date, dt.date]] = []
    for m in ms:
        lo, hi = _month_start(year, m), _month_start(year, m + 1)
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def year_ranges(years: Sequence[int]) -> list[tuple[dt.date, dt.date]]:
    """Merge a year set into contiguous ``[start, end)`` ranges."""
    out: list[tuple[dt.date, dt.date]] = []
    for y in sorted(set(years)):
        lo, hi = dt.date(y, 1, 1), dt.date(y + 1, 1, 1)
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def parse_date(col: Column | str, fmt: str = "M/d/yyyy") -> Column:
    """Date from text; NULL (not an error) for text that does not parse.

    ``M/d`` also accepts zero-padded ``MM/dd`` text, while ``MM/dd`` would
    reject ``6/4/2015``.
    """
    return F.try_to_date(as_col(col), fmt)
