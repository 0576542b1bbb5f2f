"""One notion of "missing": SQL NULL or a sentinel text such as ``""``, ``"NA"`` or ``"0"``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from citylens.functions._util import as_col

# Sentinels the parking files use for "no value".
TEXT_SENTINELS = ("", "NA")


def is_missing(col: Column | str, sentinels: Sequence[str] = ()) -> Column:
    """True when the value is NULL or, after trimming its text form, one of ``sentinels``."""
    c = as_col(col)
    if not sentinels:
        return c.isNull()
    return c.isNull() | F.trim(c.cast("string")).isin(list(sentinels))
