"""Summary statistics: distinct counts, averages, percentiles, shares, correlation, speed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citylens.functions.speed import speed_mph
from citylens.operators._common import as_list
from citylens.sources.tables import materialize


def distinct_count(
    df: DataFrame, col: str, include_null: bool = False, approx: bool = False, name: str = "n"
) -> DataFrame:
    """One row with the number of distinct values of ``col``.

    NULL is not a value unless ``include_null=True`` (then it counts once,
    as ``select(col).distinct().count()`` would).  ``approx=True`` uses
    HyperLogLog++ (``approx_count_distinct``) for very large inputs.
    """
    c = F.col(col)
    n = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    if include_null:
        n = n + F.coalesce(F.max(F.when(c.isNull(), F.lit(1)).otherwise(F.lit(0))), F.lit(0))
    return df.agg(n.alias(name))


def avg_by(df: DataFrame, by, col: str | Column, where: Column | None = None, name: str = "avg") -> DataFrame:
    """Average of ``col`` per group (optionally on rows meeting ``where``)."""
    src = df if where is None else df.filter(where)
    return src.groupBy(*as_list(by)).agg(F.avg(col).alias(name))


def _pname(p: float) -> str:
    return "p" + (str(int(p * 100)) if float(p * 100).is_integer() else str(p * 100).replace(".", "_"))


def summary_percentiles(
    df: DataFrame,
    col: str,
    ps: Sequence[float] = (0.25, 0.5, 0.75),
    exact: bool = False,
    accuracy: int = 10000,
    by=None,
) -> DataFrame:
    """Average and percentiles of ``col`` in one row (or one row per group).

    Default: ``percentile_approx`` (a mergeable sketch with bounded memory,
    returns an actual element).  ``exact=True`` interpolates linearly like
    ``percentile``; it is worked out by ``exact_percentiles``, with ``by``
    by ``exact_percentiles_by``, so no task holds all values of a group.
    """
    c = F.col(col)
    ps = list(ps)
    keys = as_list(by)
    if exact and keys:
        return exact_percentiles_by(df, col, ps, keys)
    if exact:
        found = exact_percentiles(df, col, ps)
        one = df.agg(F.avg(c).alias("avg"))
        return one.select("avg", *[found.select(_pname(p)).scalar().alias(_pname(p)) for p in ps])
    agg = df.groupBy(*keys).agg(F.avg(c).alias("avg"), F.percentile_approx(c, ps, accuracy).alias("__q"))
    return agg.select(*keys, "avg", *[F.col("__q")[i].alias(_pname(p)) for i, p in enumerate(ps)])


def exact_percentiles(df: DataFrame, col: str, ps: Sequence[float]) -> DataFrame:
    """One row with a column per percentile, interpolated linearly like ``percentile``.

    Rows are counted per distinct value, the values dealt in ranges and
    written once; only one count per range is summed up in order, and each
    range finds its own ranks, so no task holds all values.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    values = materialize(ranged, name="value-counts")
    totals = values.groupBy("part").agg(F.sum("n").alias("size"))
    # one row per range
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    starts = totals.select(F.col("part").alias("of"), before.alias("before"))
    inside = Window.partitionBy("part").orderBy("v")
    ranked = values.join(starts, F.col("part") == F.col("of")).select(
        "v", (F.col("before") + F.sum("n").over(inside)).alias("upto"), "n"
    )
    total = totals.select(F.sum("size")).scalar()
    at = {p: (total - 1) * F.lit(float(p)) for p in ps}

    def value_at(rank):
        holds = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(holds, F.col("v")))

    ends = ranked.select("v", "n", "upto", *[at[p].alias(f"r{i}") for i, p in enumerate(ps)])
    picked = ends.agg(
        *[value_at(F.floor(f"r{i}")).alias(f"lo{i}") for i in range(len(ps))],
        *[value_at(F.ceil(f"r{i}")).alias(f"hi{i}") for i in range(len(ps))],
        *[F.max(F.col(f"r{i}") - F.floor(f"r{i}")).alias(f"f{i}") for i in range(len(ps))],
    )
    mixed = lambda i: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}")
    return picked.select(*[mixed(i).alias(_pname(p)) for i, p in enumerate(ps)])


def value_ranges(df: DataFrame, col: str, by) -> DataFrame:
    """``(by..., v, n, part)``: rows per group and distinct value, dealt by range of (group, value) and written once.

    A group with many values spans several ranges, so it is the work of several tasks; NULL values are left out.
    """
    keys = as_list(by)
    values = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("v"))
    counts = values.agg(F.count(F.lit(1)).alias("n"))
    names = [c for c in counts.columns if c not in ("v", "n")]
    ranged = counts.repartitionByRange(*names, "v").withColumn("part", F.spark_partition_id())
    return materialize(ranged, name="group-value-counts")


def exact_percentiles_by(df: DataFrame, col: str, ps: Sequence[float], by) -> DataFrame:
    """Per group: ``avg`` and a column per percentile, interpolated linearly like ``percentile``.

    Rows are counted per group and distinct value and dealt by range
    (``value_ranges``).  One row per group and range gives the ranks that
    lie in it; only the ranges that hold a wanted rank are read again, each
    summed up in order of its values.  A NULL key is a group; a group whose
    values are all NULL has NULL results.
    """
    keys = as_list(by)
    values = value_ranges(df, col, keys)
    names = [c for c in values.columns if c not in ("v", "n", "part")]
    sizes = values.groupBy(*names, "part").agg(F.sum("n").alias("size"), F.sum(F.col("v") * F.col("n")).alias("sum"))
    # one row per group and range
    group = Window.partitionBy(*names)
    before = F.sum("size").over(group.orderBy("part")) - F.col("size")
    total = F.sum("size").over(group)
    ranks = [(total - 1) * F.lit(float(p)) for p in ps]
    starts = sizes.select(
        *names, "part", "size", before.alias("before"),
        *[F.floor(r).alias(f"lo{i}") for i, r in enumerate(ranks)], *[F.ceil(r).alias(f"hi{i}") for i, r in enumerate(ranks)],
        *[(r - F.floor(r)).alias(f"f{i}") for i, r in enumerate(ranks)],
    )
    ends = [f"{side}{i}" for i in range(len(ps)) for side in ("lo", "hi")]
    holds = F.lit(False)
    for e in ends:
        holds = holds | ((F.col("before") <= F.col(e)) & (F.col(e) < F.col("before") + F.col("size")))
    # the range number alone does not tell groups apart, and keys may be NULL
    wanted = starts.filter(holds).select(*[F.col(c).alias(f"__{c}") for c in starts.columns])
    same = F.col("part") == F.col("__part")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = Window.partitionBy(*names, "part").orderBy("v")
    placed = values.join(wanted, same).withColumn("upto", F.col("__before") + F.sum("n").over(inside))
    at = lambda e: (F.col("upto") - F.col("n") <= F.col(f"__{e}")) & (F.col(f"__{e}") < F.col("upto"))
    picked = placed.groupBy(*names).agg(
        *[F.max(F.when(at(e), F.col("v"))).alias(e) for e in ends], *[F.max(f"__f{i}").alias(f"f{i}") for i in range(len(ps))]
    )
    mixed = [(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}")).alias(_pname(p)) for i, p in enumerate(ps)]
    averages = sizes.groupBy(*names).agg((F.sum("sum") / F.sum("size")).alias("avg"))
    # every group, also one without values
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).drop("__rows")
    out = groups
    for part in (averages, picked.select(*names, *mixed)):
        right = part.select(*[F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in part.columns])
        on = F.lit(True)
        for c in names:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        out = out.join(right, on, "left").drop(*[f"__{c}" for c in names])
    return out


def mean_vs_median(df: DataFrame, col: str, exact: bool = False, accuracy: int = 10000) -> DataFrame:
    """Is the mean representative?  (mean, median, ratio = mean / median).

    Default median: ``percentile_approx`` (bounded memory per group).
    ``exact=True`` interpolates like ``percentile`` (``exact_percentiles``).
    """
    c = F.col(col)
    if exact:
        median = exact_percentiles(df, col, [0.5]).scalar()
        one = df.agg(F.avg(c).alias("mean")).select("mean", median.alias("median"))
        return one.withColumn("ratio", F.try_divide(F.col("mean"), F.col("median")))
    med = F.percentile_approx(c, 0.5, accuracy)
    return df.agg(F.avg(c).alias("mean"), med.cast("double").alias("median")).withColumn(
        "ratio", F.try_divide(F.col("mean"), F.col("median"))
    )


def fraction_where(df: DataFrame, cond: Column, null_as: bool | None = None, name: str = "percent") -> DataFrame:
    """Percent (0-100) of rows meeting ``cond``; rows where ``cond`` is NULL count as ``null_as``."""
    c = cond if null_as is None else F.coalesce(cond, F.lit(bool(null_as)))
    return df.agg(
        (F.count_if(c).cast("double") * F.lit(100.0) / F.count(F.lit(1)).cast("double")).alias(name)
    )


def correlation(df: DataFrame, x: str, y: str, where: Column | None = None, name: str = "corr") -> DataFrame:
    """Pearson correlation of two columns (one pass, mergeable moments)."""
    src = df if where is None else df.filter(where)
    return src.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(name))


def _speed_rows(df: DataFrame, distance: str, start: str, end: str, where: Column | None, min_seconds):
    src = df.filter(F.col(distance) != 0)
    if where is not None:
        src = src.filter(where)
    if min_seconds is not None:
        src = src.filter(F.unix_timestamp(end) - F.unix_timestamp(start) >= min_seconds)
    return src


def avg_speed(
    df: DataFrame,
    by=None,
    distance: str = "trip_distance",
    start: str = "pickup_ts",
    end: str = "dropoff_ts",
    where: Column | None = None,
    min_seconds: int | None = None,
    name: str = "avg_speed",
) -> DataFrame:
    """Average speed in mph per group (or overall).

    Trips with distance 0 are left out; zero-length trips give NULL speed
    and are ignored by the average; negative durations are kept unless
    ``min_seconds`` is given.
    """
    src = _speed_rows(df, distance, start, end, where, min_seconds)
    keys = as_list(by)
    speed = F.avg(speed_mph(distance, start, end)).alias(name)
    return src.groupBy(*keys).agg(speed) if keys else src.agg(speed)


def avg_speed_vs_overall(
    df: DataFrame,
    by,
    distance: str = "trip_distance",
    start: str = "pickup_ts",
    end: str = "dropoff_ts",
    where: Column | None = None,
    min_seconds: int | None = None,
) -> DataFrame:
    """Per-group average speed next to the overall one: (by..., avg_speed, overall_speed, diff).

    One pass: per-group sums and counts of the speed; the overall average is
    a scalar subquery over those few aggregated rows (reusing their
    shuffle), so there is neither a second scan nor a cross join.
    """
    src = _speed_rows(df, distance, start, end, where, min_seconds)
    speed = speed_mph(distance, start, end)
    keys = as_list(by)
    parts = src.groupBy(*keys).agg(F.sum(speed).alias("__s"), F.count(speed).alias("__n"))
    out_keys = [c for c in parts.columns if c not in ("__s", "__n")]
    overall = parts.select(F.try_divide(F.sum("__s"), F.sum("__n").cast("double"))).scalar()
    avg = F.try_divide(F.col("__s"), F.col("__n").cast("double"))
    return parts.select(
        *out_keys,
        avg.alias("avg_speed"),
        overall.alias("overall_speed"),
        (avg - overall).alias("diff"),
    )
