"""Column-level tidying: positional selection, name normalisation, sparse-column drop, shape."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.functions.dates import parse_date
from citylens.functions.missing import is_missing


def select_range(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Columns ``start`` (inclusive) to ``stop`` (exclusive) by position."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[start:stop]])


def normalize_name(name: str, lower: bool = False) -> str:
    """``"Days Parking In Effect    "`` -> ``"Days_Parking_In_Effect"``; ``?`` and other symbols removed."""
    out = re.sub(r"\s+", "_", name.strip())
    out = re.sub(r"[^0-9A-Za-z_]", "", out)
    return out.lower() if lower else out


def normalize_columns(df: DataFrame, lower: bool = False) -> DataFrame:
    """Rename every column with ``normalize_name`` (a metadata-only projection)."""
    names = [normalize_name(c, lower) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"normalised names collide: {names}")
    return df.toDF(*names)


def missing_fractions(df: DataFrame, sentinels: Sequence[str] = ()) -> dict[str, float]:
    """Fraction of missing values per column, from one aggregate row."""
    cols = df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(is_missing(F.col(f"`{c}`"), sentinels)).alias(f"m{i}") for i, c in enumerate(cols)],
    ).first()
    n = row["__n"] or 0
    return {c: (row[f"m{i}"] / n if n else 0.0) for i, c in enumerate(cols)}


def drop_sparse_columns(df: DataFrame, max_missing: float = 1.0, sentinels: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose missing fraction is >= ``max_missing`` (1.0 = entirely missing).

    Runs one aggregate job and reads its single row (one number per column).
    """
    fractions = missing_fractions(df, sentinels)
    keep = [c for c in df.columns if fractions[c] < max_missing or fractions[c] == 0.0]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def shape_report(df: DataFrame) -> DataFrame:
    """One row per column: (position, column, type, n_rows, n_cols).

    The column list comes from the schema (metadata); ``n_rows`` is a
    scalar subquery counting ``df`` on the executors.
    """
    spark = df.sparkSession
    meta = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    info = spark.createDataFrame(meta, "position int, column string, type string")
    n_rows = df.select(F.count(F.lit(1))).scalar()
    return info.withColumn("n_rows", n_rows).withColumn("n_cols", F.lit(len(meta)))


def with_date_parts(
    df: DataFrame, col: str, fmt: str = "M/d/yyyy", date: str | None = None, year: str = "year", month: str = "month"
) -> DataFrame:
    """Parse date text once (``MM/dd/yyyy`` by default, bad text -> NULL) and add its year and month.

    ``date`` names a column for the parsed date (omit to keep only the parts).
    """
    parsed = date or "__parsed"
    out = df.withColumn(parsed, parse_date(col, fmt))
    out = out.withColumns({year: F.year(parsed), month: F.month(parsed)})
    return out if date else out.drop(parsed)


def count_date_parts(
    df: DataFrame, col: str, fmt: str = "M/d/yyyy", year: str = "year", month: str = "month", name: str = "count"
) -> DataFrame:
    """Rows per year and month of date text: the rows are counted by text first, each distinct text is parsed once."""
    by_text = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    parts = with_date_parts(by_text, col, fmt, year=year, month=month)
    return parts.groupBy(year, month).agg(F.sum("__n").alias(name))
