"""Reports that share one reduction: grouping sets over counts, distinct counts that merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylens.operators._common import as_list


def rollup_reports(
    df: DataFrame,
    keys: Mapping[str, Column],
    reports: Mapping[str, Sequence[str]],
    sums: Mapping[str, Column] | None = None,
    name: str = "n",
) -> DataFrame:
    """Several reports from one pass: ``(report, key..., n, sum...)``.

    The rows are reduced to one per combination of all keys first, with map-side partial sums; the reports are
    grouping sets over that small table, so a row of the input is neither read nor expanded once per report.  A
    key that is not in a report's list is NULL in its rows; a NULL key value is a group of its own.  ``sums`` adds up
    columns (a sum and a count make an average).  No rows give an empty result, also for a report without keys.
    """
    sums = dict(sums or {})
    unknown = {k for of in reports.values() for k in of} - set(keys)
    if unknown:
        raise ValueError(f"reports name unknown keys: {sorted(unknown)}")
    order = list(keys)
    reduced = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        F.count(F.lit(1)).alias(name), *[F.sum(c).alias(s) for s, c in sums.items()]
    )
    # equal key lists are one grouping set; the bits of the grouping id tell which
    sets = list(dict.fromkeys(tuple(k for k in order if k in of) for of in reports.values()))
    bit = {k: 1 << (len(order) - 1 - i) for i, k in enumerate(order)}
    number = {s: sum(bit[k] for k in order if k not in s) for s in sets}
    grouped = reduced.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in order]).agg(
        F.grouping_id().alias("__set"), F.sum(name).alias(name), *[F.sum(s).alias(s) for s in sums]
    )
    named = F.array(*[
        F.struct(F.lit(report).alias("report"), F.lit(number[tuple(k for k in order if k in of)]).cast("long").alias("of"))
        for report, of in reports.items()
    ])
    each = grouped.select("*", F.inline(F.filter(named, lambda r: r["of"] == F.col("__set"))))
    return each.select("report", *order, name, *sums)


def value_numbers(df: DataFrame, col: str, path: str) -> DataFrame:
    """``(value, number)``: a stored dictionary at ``path`` that numbers every value of ``col`` met so far.

    Values it does not hold yet are appended with numbers of their own; numbers never change, so bitmaps of earlier
    loads stay valid.  NULL has no number.
    """
    spark = df.sparkSession
    schema = f"value {df.schema[col].dataType.simpleString()}, number bigint"
    try:
        held = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], schema)
    first = (held.agg(F.max("number")).first()[0] or 0) + 1
    fresh = df.select(F.col(col).alias("value")).filter("value IS NOT NULL").distinct().join(held, "value", "left_anti")
    fresh.select("value", (F.lit(first) + F.monotonically_increasing_id()).alias("number")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def distinct_bitmaps(df: DataFrame, by, col: str) -> DataFrame:
    """``(by..., bucket, bits)``: the whole numbers of ``col`` per group, a bit each, in buckets of 32,768 bits.

    Bitmaps of the parts of a table merge (``merge_bitmaps``), so a distinct count over any union of parts comes from
    the stored bits instead of the rows, and stays exact.  Text is numbered first (``value_numbers``).  Partial
    bitmaps are combined before the shuffle; NULL sets no bit.
    """
    value = F.col(col).cast("bigint")
    some = df.filter(F.col(col).isNotNull())
    return some.groupBy(*as_list(by), F.bitmap_bucket_number(value).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")
    )


def merge_bitmaps(bitmaps: DataFrame, by=()) -> DataFrame:
    """The bitmaps of coarser groups."""
    return bitmaps.groupBy(*as_list(by), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bitmaps(bitmaps: DataFrame, by=(), name: str = "n") -> DataFrame:
    """Distinct values per group of stored bitmaps; without ``by`` one row (0 for none)."""
    merged = merge_bitmaps(bitmaps, by)
    total = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name)
    keys = as_list(by)
    return merged.groupBy(*keys).agg(total) if keys else merged.agg(total)
