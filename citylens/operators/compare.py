"""Year-on-year comparison of metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citylens.operators._common import as_list


def stack_years(frames: Mapping[int, DataFrame], year_col: str = "year") -> DataFrame:
    """Union yearly frames (columns may drift) with a year literal."""
    out = None
    for year, frame in sorted(frames.items()):
        tagged = frame.withColumn(year_col, F.lit(int(year)))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames")
    return out


def compare_years(
    df: DataFrame, year: Column | str, metrics: Mapping[str, Column], by=None, year_col: str = "year",
    distinct: Mapping[str, str] | None = None,
) -> DataFrame:
    """Metrics per year (and group) with the change from the previous calendar year.

    Output: by..., year, metric..., ``<metric>_change`` (NULL when the
    previous year is absent, or the year is).  The data is aggregated once;
    the previous year's value is read with a ``RANGE BETWEEN 1 PRECEDING AND
    1 PRECEDING`` window over the aggregated rows (one row per group and
    year), partitioned by the groups.  ``distinct`` adds counts of distinct
    values: they start from the distinct rows of (keys, year, columns), so no
    row is expanded once per count.
    """
    keys, distinct = as_list(by), dict(distinct or {})
    y = F.col(year) if isinstance(year, str) else year
    agg = None
    if metrics or not distinct:
        agg = df.groupBy(*keys, y.alias(year_col)).agg(*[m.alias(n) for n, m in metrics.items()])
    if distinct:
        columns = list(dict.fromkeys(distinct.values()))
        reduced = df.select(*keys, y.alias(year_col), *columns).distinct()
        names = [c for c in reduced.columns if c not in columns]
        for name, column in distinct.items():
            values = reduced.select(*names, column).distinct().groupBy(*names).agg(F.count(column).alias(name))
            agg = values if agg is None else _join_on(agg, values, names)
    measures = [*metrics, *distinct]
    w = Window.partitionBy(*keys).orderBy(F.col(year_col)).rangeBetween(-1, -1)
    known = F.col(year_col).isNotNull()
    return agg.select(
        *keys,
        year_col,
        *measures,
        *[F.when(known, F.col(n) - F.max(n).over(w)).alias(f"{n}_change") for n in measures],
    )


def _join_on(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Join aggregated rows on columns that may hold NULL."""
    other = right.select(*[F.col(n).alias(f"__{n}") if n in names else F.col(n) for n in right.columns])
    same = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
    return left.join(other, same).drop(*[f"__{n}" for n in names])


def pivot_years(
    df: DataFrame, year: Column | str, years: Sequence[int], by, metric: Column, fill: int | float | None = None
) -> DataFrame:
    """One row per group, one column per year (``"2015"``, ``"2016"``, ...), holding ``metric``.

    Rows of a year outside the list are in ``other``, rows without a year in
    ``unknown``, so the columns together hold every row.  The year list is
    explicit, so Spark skips the extra job that would collect the distinct
    years; the pivot is a single aggregation keyed by the groups.  ``fill``
    replaces the NULL of a group absent in a year (e.g. 0 for counts).
    """
    keys = as_list(by)
    y = (F.col(year) if isinstance(year, str) else year).cast("int")
    listed = [int(v) for v in years]
    column = F.when(y.isin(listed), y.cast("string")).when(y.isNull(), F.lit("unknown")).otherwise(F.lit("other"))
    names = [*map(str, listed), "other", "unknown"]
    out = df.withColumn("__year", column).groupBy(*keys).pivot("__year", names).agg(metric)
    return out.na.fill(fill, subset=names) if fill is not None else out
