from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def exclude_values(df: DataFrame, col: str, exclude: Iterable | None) -> DataFrame:
    """Drop rows whose ``col`` is one of ``exclude``; ``None`` in the list drops NULLs.

    On a text column the values are compared as text (``0`` matches ``"0"``),
    so the same exclusion works on typed and all-text files.
    """
    if not exclude:
        return df
    values = [v for v in exclude if v is not None]
    if values and isinstance(df.schema[col].dataType, StringType):
        values = [str(v) for v in values]
    out = df
    if any(v is None for v in exclude):
        out = out.filter(F.col(col).isNotNull())
    if values:
        out = out.filter(~F.col(col).isin(values))
    return out


def total_of(counts: DataFrame, col: str = "count") -> Column:
    """Scalar-subquery column holding ``sum(col)`` over an aggregated frame.

    Spark runs it once, as a partial + final aggregate, and reuses the
    shuffle of ``counts`` (``ReusedExchange``); no cross join, and no
    single-partition window over all groups.
    """
    return counts.select(F.sum(col)).scalar()
