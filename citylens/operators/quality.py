"""Data-quality profiles, rule counts and period cleaning.

Where the case studies run one full scan per check, these operators put
all checks of a table into one aggregate (``count_if`` per rule) and turn
the single result row into long form with ``unpivot``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylens.functions.dates import Range, in_period, in_periods
from citylens.functions.missing import is_missing
from citylens.operators._common import as_list

_N = "__n_rows"


def _long_form(wide: DataFrame, ids: Sequence[str], names: Sequence[str], var: str, value: str) -> DataFrame:
    return wide.unpivot(list(ids), list(names), var, value)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column in one pass: (column, n_null, fraction)."""
    cols = list(cols or df.columns)
    return missing_profile(df, {c: () for c in cols}, value="n_null")


def sentinel_profile(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """Missing values per column, counting the given sentinels (e.g. ``"0"``) as missing."""
    return missing_profile(df, spec, value="n_missing")


def missing_profile(df: DataFrame, spec: Mapping[str, Sequence[str]], value: str = "n_missing") -> DataFrame:
    aggs = [F.count_if(is_missing(c, s)).alias(c) for c, s in spec.items()]
    wide = df.agg(F.count(F.lit(1)).alias(_N), *aggs)
    long = _long_form(wide, [_N], list(spec), "column", value)
    return long.select(
        "column",
        value,
        F.try_divide(F.col(value).cast("double"), F.col(_N).cast("double")).alias("fraction"),
    )


def trip_rules(
    distance: str = "trip_distance",
    passengers: str = "passenger_count",
    fare: str = "fare_amount",
    tip: str = "tip_amount",
    total: str = "total_amount",
    rate_code: str | None = None,
    bad_rate_code: int = 99,
) -> dict[str, Column]:
    """The trip sanity rules; a row violates a rule when its predicate is true (NULL is not a violation)."""
    rules = {
        "distance_zero": F.col(distance) == 0,
        "passengers_zero": F.col(passengers) == 0,
        "fare_negative": F.col(fare) < 0,
        "fare_zero": F.col(fare) == 0,
        "tip_negative": F.col(tip) < 0,
        "total_negative": F.col(total) < 0,
        "total_zero": F.col(total) == 0,
    }
    if rate_code is not None:
        rules["rate_code_invalid"] = F.col(rate_code) == bad_rate_code
    return rules


def rule_counts(df: DataFrame, rules: Mapping[str, Column], by: str | Sequence[str] | None = None) -> DataFrame:
    """Violations per rule in one scan: (rule, n_bad), or (by..., rule, n_bad) per group.

    Groups with no violation report 0 rather than being left out.
    """
    keys = as_list(by)
    aggs = [F.count_if(pred).alias(name) for name, pred in rules.items()]
    wide = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return _long_form(wide, keys, list(rules), "rule", "n_bad")


def worst_offender(df: DataFrame, rules: Mapping[str, Column], by: str, n: int = 1) -> DataFrame:
    """The group(s) with most rule violations in total: (by, n_bad), top ``n`` (ties cut by key)."""
    total = None
    for pred in rules.values():
        hit = F.when(pred, F.lit(1)).otherwise(F.lit(0))
        total = hit if total is None else total + hit
    agg = df.groupBy(by).agg(F.sum(total).alias("n_bad"))
    return agg.orderBy(F.desc("n_bad"), F.asc(by)).limit(n)


def distinct_values(df: DataFrame, expr: Column | str, name: str | None = None) -> DataFrame:
    """Distinct values of an expression (e.g. the months present)."""
    c = F.col(expr) if isinstance(expr, str) else expr
    return df.select(c.alias(name) if name else c).distinct()


def out_of_period_count(df: DataFrame, col: str, start, end, name: str = "n") -> DataFrame:
    """Rows whose ``col`` is outside ``[start, end)``; NULL dates are not counted."""
    outside = F.col(col).isNotNull() & ~in_period(col, start, end)
    return df.agg(F.count_if(outside).alias(name))


def clean_period(df: DataFrame, periods: Mapping[str, Range | Sequence[Range]]) -> DataFrame:
    """Keep rows whose timestamp columns fall in their periods (AND over columns, OR over ranges).

    Ranges are pushed to the Parquet scan as filters.
    """
    out = df
    for col, spec in periods.items():
        ranges = [spec] if isinstance(spec, tuple) and len(spec) == 2 and not isinstance(spec[0], tuple) else list(spec)
        out = out.filter(in_periods(col, ranges))
    return out


def missing_address(
    df: DataFrame, cols: Sequence[str], how: str = "any", sentinels: Iterable[str] = (), name: str = "n"
) -> DataFrame:
    """Rows missing any (``how="any"``) or all (``how="all"``) of the address parts."""
    preds = [is_missing(c, tuple(sentinels)) for c in cols]
    cond = preds[0]
    for p in preds[1:]:
        cond = (cond | p) if how == "any" else (cond & p)
    if how not in ("any", "all"):
        raise ValueError("how must be 'any' or 'all'")
    return df.agg(F.count_if(cond).alias(name))


def drop_missing(df: DataFrame, cols: Sequence[str], sentinels: Iterable[str] = ()) -> DataFrame:
    """Drop rows where any of ``cols`` is missing."""
    out = df
    for c in cols:
        out = out.filter(~is_missing(c, tuple(sentinels)))
    return out
