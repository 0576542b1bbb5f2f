"""Fine revenue of the most frequent violation codes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citylens.operators.frequency import top_n

# Published fines per violation code, (code, high-density
# zone fine, other-areas fine, stated average).  Code 14 has only the
# average.
FINES = [
    (21, 65.0, 45.0, 55.0),
    (36, 50.0, 50.0, 50.0),
    (38, 65.0, 35.0, 50.0),
    (14, None, None, 115.0),
]


def fine_table(spark: SparkSession, rows=FINES) -> DataFrame:
    """The fine lookup table as a DataFrame (violation_code, fine_zone_a, fine_zone_b, average)."""
    return spark.createDataFrame(
        list(rows), "violation_code int, fine_zone_a double, fine_zone_b double, average double"
    )


def fine_revenue(
    df: DataFrame,
    fines: DataFrame,
    code: str = "violation_code",
    k: int = 3,
    exclude: Iterable | None = (0, None),
    zone_a: str = "fine_zone_a",
    zone_b: str = "fine_zone_b",
) -> DataFrame:
    """Tickets x average fine for the ``k`` most frequent codes: (code, tickets, avg_fine, total).

    A code without a fine stays, with NULL fine and total.  The tickets are
    aggregated before the lookup, so only ``k`` rows meet the fine table.
    """
    avg = (F.col(zone_a) + F.col(zone_b)) / F.lit(2.0)
    if "average" in fines.columns:
        avg = F.coalesce(avg, F.col("average"))
    lookup = fines.select(F.col(code), avg.alias("avg_fine"))
    top = top_n(df, code, k, exclude, name="tickets")
    return (
        top.join(lookup, on=code, how="left")
        .select(code, "tickets", "avg_fine", (F.col("tickets") * F.col("avg_fine")).alias("total"))
    )


def revenue_total(rev: DataFrame, name: str = "total") -> DataFrame:
    """The sum of the known totals, and the tickets whose code has no fine."""
    without = F.coalesce(F.sum(F.when(F.col("total").isNull(), F.col("tickets"))), F.lit(0))
    return rev.agg(F.sum("total").alias(name), without.alias("tickets_without_fine"))


def top_revenue_code(rev: DataFrame, code: str = "violation_code") -> DataFrame:
    """The code with the highest total (one row; a tie goes to the lower code)."""
    return rev.orderBy(F.desc_nulls_last("total"), F.asc(code)).limit(1).select(code, "total")


def fines_in_force(
    counts: DataFrame,
    fines: DataFrame,
    date: str,
    on: Sequence[str] = ("violation_code", "zone"),
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    fine: str = "fine",
) -> DataFrame:
    """``counts`` with the ``fine`` that was in force on their ``date``: that of the latest ``valid_from`` not after it.

    ``fines`` has a row per key and period; ``valid_to`` is the first day it no longer holds (NULL: open).  Days before the
    first period, in a gap, without a date or with a NULL key have NULL.  Two periods that start on one day: the
    higher fine holds.  Neither side is expanded by days nor joined by range: the changes of a key and its counts are
    put in order of time and each count takes the last change before it.  ``counts`` should be aggregated by day, so
    that a key has a row per day and not per ticket.
    """
    on = list(on)
    changes = fines.filter(F.col(valid_from).isNotNull()).select(
        *on, F.col(valid_from).cast("date").alias("__at"), F.lit(0).alias("__kind"), F.col(fine).cast("double").alias("__fine"),
        F.struct(F.col(fine).cast("double").alias("fine"), F.col(valid_to).cast("date").alias("until")).alias("__change"),
    )
    asked = counts.withColumns({"__at": F.col(date).cast("date"), "__kind": F.lit(1)})
    both = asked.unionByName(changes, allowMissingColumns=True)
    so_far = Window.partitionBy(*on).orderBy("__at", "__kind", "__fine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("__last", F.last("__change", ignorenulls=True).over(so_far)).filter("__kind = 1")
    known = F.col("__at").isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    holds = known & (F.col("__last.until").isNull() | (F.col("__at") < F.col("__last.until")))
    return placed.select(*counts.columns, F.when(holds, F.col("__last.fine")).alias(fine))


def fine_revenue_by_year(
    df: DataFrame,
    fines: DataFrame,
    code: str = "violation_code",
    date: str = "issue_ts",
    zone: Column | None = None,
    exclude: Iterable | None = (0, None),
) -> DataFrame:
    """``(year, code, zone, tickets, total, tickets_without_fine)``: every ticket at the fine of its day and zone.

    ``fines``: ``(violation_code, zone, valid_from, valid_to, fine)``; ``zone`` is the tickets' zone (by default one zone
    ``all``).  The tickets are counted per day first.  ``total`` is NULL where no ticket has a fine.
    """
    from citylens.operators._common import exclude_values

    kept = exclude_values(df, code, exclude)
    daily = kept.groupBy(
        F.col(code).alias("violation_code"), (F.lit("all") if zone is None else zone).alias("zone"), F.col(date).cast("date").alias("day")
    ).agg(F.count(F.lit(1)).alias("tickets"))
    priced = fines_in_force(daily, fines, "day")
    return priced.groupBy(F.year("day").alias("year"), F.col("violation_code").alias(code), "zone").agg(
        F.sum("tickets").alias("tickets"),
        F.sum(F.col("tickets") * F.col("fine")).alias("total"),
        F.coalesce(F.sum(F.when(F.col("fine").isNull(), F.col("tickets"))), F.lit(0)).alias("tickets_without_fine"),
    )
