"""Discrete bins: time of day, season, numeric buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from citylens.functions._util import as_col

# Labels of the six four-hour bins of the day, in order.
TIME_BIN_LABELS = ["Late_Night", "Early_Morning", "Morning", "Afternoon", "Evening", "Night"]
# Season labels in order (1 = Dec-Feb, 2 = Mar-May, 3 = Jun-Aug, 4 = Sep-Nov).
SEASON_LABELS = ["Winter", "Spring", "Summer", "Autumn"]

_HOUR_EDGES = (4, 8, 12, 16, 20)


def _label(bin_no: Column, labels: Sequence[str] | None) -> Column:
    if labels is None:
        return bin_no
    out = F.lit(None).cast("string")
    expr = None
    for i, name in enumerate(labels, start=1):
        expr = (F.when(bin_no == i, F.lit(name))) if expr is None else expr.when(bin_no == i, F.lit(name))
    return expr.otherwise(out) if expr is not None else out


def time_bin(
    hour: Column | str,
    closed: str = "left",
    labels: Sequence[str] | bool | None = None,
    null_bin: int | None = None,
) -> Column:
    """Six bins of the day from an hour 0-23.

    closed="left":  0-3 -> 1, 4-7 -> 2, 8-11 -> 3, 12-15 -> 4, 16-19 -> 5, 20-23 -> 6.
    closed="right": <=4 -> 1, 5-8 -> 2, 9-12 -> 3, 13-16 -> 4, 17-20 -> 5, else 6.
    A NULL hour gives NULL unless ``null_bin`` names the bin it falls into.
    ``labels=True`` uses the fixed day-part names.
    """
    h = as_col(hour)
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    expr = None
    for i, edge in enumerate(_HOUR_EDGES, start=1):
        cond = (h < edge) if closed == "left" else (h <= edge)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    bin_no = F.when(h.isNull(), F.lit(null_bin).cast("int")).otherwise(expr.otherwise(F.lit(6)))
    if labels is True:
        labels = TIME_BIN_LABELS
    return _label(bin_no, labels or None)


def season(month: Column | str, labels: Sequence[str] | bool | None = None) -> Column:
    """Season number 1-4 (or label) from a month 1-12; NULL otherwise."""
    m = as_col(month)
    bin_no = (
        F.when(m.isin(12, 1, 2), F.lit(1))
        .when(m.isin(3, 4, 5), F.lit(2))
        .when(m.isin(6, 7, 8), F.lit(3))
        .when(m.isin(9, 10, 11), F.lit(4))
    )
    if labels is True:
        labels = SEASON_LABELS
    return _label(bin_no, labels or None)


def _fmt(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def bucket_labels(edges: Sequence[float]) -> list[str]:
    """``[a-b)`` for consecutive edges and ``>=last`` for the open end."""
    out = [f"[{_fmt(a)}-{_fmt(b)})" for a, b in zip(edges[:-1], edges[1:])]
    out.append(f">={_fmt(edges[-1])}")
    return out


def bucketize(col: Column | str, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Half-open numeric buckets ``[e0,e1) ... [e_{n-1}, inf)``; below ``e0`` or NULL -> NULL."""
    if len(edges) < 1 or list(edges) != sorted(edges):
        raise ValueError("edges must be ascending")
    names = list(labels) if labels is not None else bucket_labels(edges)
    if len(names) != len(edges):
        raise ValueError("need one label per edge")
    c = as_col(col)
    expr = None
    for (lo, hi), name in zip(zip(edges[:-1], edges[1:]), names):
        cond = (c >= lo) & (c < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    last = c >= edges[-1]
    expr = F.when(last, F.lit(names[-1])) if expr is None else expr.when(last, F.lit(names[-1]))
    return expr
