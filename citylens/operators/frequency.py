"""Frequency tables, top-N, top-k per group, shares and busiest-group analysis.

Every operator aggregates first (partial aggregation before the shuffle,
so a hot key costs one row per map task, not one row per record) and
ranks or joins only the aggregated rows.  The only broadcast sides are
top-k tables whose size is bounded by ``k``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citylens.functions.bins import bucketize
from citylens.operators._common import as_list, exclude_values, total_of


def count_by(df: DataFrame, keys, of: str | Column | None = None, name: str = "count") -> DataFrame:
    """Rows per group (``of=None``) or non-NULL values of ``of`` per group.

    A NULL key stays a group; with ``of`` the NULL group counts 0 when
    ``of`` is the key itself.
    """
    measure = F.count(F.lit(1)) if of is None else F.count(of)
    return df.groupBy(*as_list(keys)).agg(measure.alias(name))


def top_n(
    df: DataFrame,
    col: str,
    n: int = 5,
    exclude: Iterable | None = (None,),
    name: str = "count",
) -> DataFrame:
    """The ``n`` most frequent values of ``col`` with their counts.

    Order: count descending, then value ascending, so ties are cut the same
    way on every run.  Plans to partial/final aggregate + ``TakeOrderedAndProject``.
    """
    counts = count_by(exclude_values(df, col, exclude), col, name=name)
    return counts.orderBy(F.desc(name), F.asc(col)).limit(n)


def top_n_bounded(
    df: DataFrame,
    col: str,
    n: int = 5,
    exclude: Iterable | None = (None,),
    name: str = "count",
    tracked: int = 10_000,
) -> DataFrame:
    """``top_n`` without a shuffle of all distinct values, where the counts allow a proof; otherwise ``top_n`` itself.

    A first pass keeps a frequent-items sketch of at most ``tracked`` counters per task (``approx_top_k``, mergeable)
    and gives candidates; a second counts the candidates exactly, so at most that many rows per task are shuffled.
    A value that is no candidate occurs at most ``candidate_bound`` times: if the ``n``-th candidate occurs more often,
    the candidates' ``n`` best are the table's, in the order of ``top_n``.  If the bound does not separate them (nearly
    equal counts, or fewer than ``n`` frequent values), the exact ``top_n`` is returned.
    """
    kept = exclude_values(df, col, exclude)
    most = min(4 * n + 20, tracked, 10_000)
    found = frequent_candidates(kept, col, tracked, most) if n <= most else None
    if found is not None:
        candidates, bound = found
        listed = df.sparkSession.createDataFrame([(v,) for v in candidates], f"__value {df.schema[col].dataType.simpleString()}")
        # at most 4 n + 20 rows
        matched = kept.join(F.broadcast(listed), F.col(col).eqNullSafe(F.col("__value")), "left_semi")
        best = count_by(matched, col, name=name).orderBy(F.desc(name), F.asc(col)).limit(n)
        rows = best.collect()
        if len(rows) == n and rows[-1][name] > bound:
            return df.sparkSession.createDataFrame(rows, best.schema).orderBy(F.desc(name), F.asc(col))
    return top_n(df, col, n, exclude, name)


def frequent_candidates(df: DataFrame, col: str, tracked: int, most: int) -> tuple[list, int] | None:
    """Up to ``most`` candidates for the frequent values of ``col`` and how often any other value can occur.

    A sketch of ``tracked`` counters is off by at most 3.5 / ``tracked`` of the rows; a value it does not return had a
    lower bound within that error, or an estimate no larger than the last one returned.  None without rows.
    """
    sketch = F.expr(f"approx_top_k(`{col}`, {int(most)}, {int(tracked)})")
    row = df.agg(F.count(F.lit(1)).alias("rows"), sketch.alias("items")).first()
    if not row["rows"]:
        return None
    items = row["items"] or []
    bound = 2 * -(-7 * row["rows"] // (2 * tracked))
    if len(items) >= most:
        bound = max(bound, items[-1]["count"])
    return [i["item"] for i in items], bound


def rank_within(
    counts: DataFrame, group: str | Sequence[str], k: int = 3, by: str = "count", rank: str = "rank"
) -> DataFrame:
    """Keep rows whose ``dense_rank`` by ``by`` (descending) within ``group`` is <= k.

    Ties share a rank, so a group may return more than ``k`` rows.  Spark
    plans this with a partial ``WindowGroupLimit`` before the shuffle.
    """
    w = Window.partitionBy(*as_list(group)).orderBy(F.desc(by))
    return counts.withColumn(rank, F.dense_rank().over(w)).filter(F.col(rank) <= k)


def top_k_per_group(
    df: DataFrame, group: str, item: str, k: int = 3, name: str = "count", rank: str = "rank"
) -> DataFrame:
    """Top-k items of every group by frequency, with ties (``dense_rank``).

    Output: group, item, count, rank.
    """
    return rank_within(count_by(df, [group, item], name=name), group, k, by=name, rank=rank)


def percent_share(df: DataFrame, col: str, name: str = "count", share: str = "share", digits: int | None = None) -> DataFrame:
    """Rows per value of ``col`` and their share of all rows in percent (0-100)."""
    counts = count_by(df, col, name=name)
    value = F.col(name).cast("double") * F.lit(100.0) / total_of(counts, name).cast("double")
    if digits is not None:
        value = F.round(value, digits)
    return counts.withColumn(share, value)


def bucket_share(
    df: DataFrame,
    col: str,
    edges: Sequence[float],
    labels: Sequence[str] | None = None,
    bucket: str = "bucket",
    digits: int | None = None,
) -> DataFrame:
    """Numeric buckets of ``col`` (``[a-b)`` ... ``>=last``) and each bucket's percent share."""
    return percent_share(df.select(bucketize(col, edges, labels).alias(bucket)), bucket, digits=digits)


def top_groups(df: DataFrame, group: str, k: int = 3, exclude: Iterable | None = (0, None)) -> DataFrame:
    """The ``k`` busiest groups (exactly ``k`` rows at most: ties cut by key)."""
    return top_n(df, group, k, exclude).select(group)


def pair_counts(df: DataFrame, group: str, item: str, name: str = "count") -> DataFrame:
    """Rows per (group, item): the one pass over the raw rows that the busiest-group operators share."""
    return count_by(df, [group, item], name=name)


def top_groups_of(pairs: DataFrame, group: str, k: int, name: str = "count") -> DataFrame:
    """The ``k`` busiest groups, from (group, item, count) rows instead of the raw rows."""
    totals = pairs.groupBy(group).agg(F.sum(name).alias(name))
    return totals.orderBy(F.desc(name), F.asc(group)).limit(k).select(group)


def _pairs_in_top_groups(pairs: DataFrame, group: str, k: int, name: str = "count") -> DataFrame:
    # The top table has at most k rows (a proven bound), so it is the broadcast side.  Both
    # branches read the same aggregated pairs -- excluded groups were dropped before counting,
    # so the two sub-plans are identical and Spark reuses their shuffle: the raw rows are
    # scanned once.  The top keys are unique, so an inner join keeps exactly the rows a semi
    # join would; unlike a semi join it is not pushed below the aggregate, which would turn
    # the reuse into a second scan.
    return pairs.join(F.broadcast(top_groups_of(pairs, group, k, name)), on=group, how="inner")


def freq_within_top_groups(
    df: DataFrame,
    group: str,
    item: str,
    k: int = 3,
    pooled: bool = False,
    exclude: Iterable | None = (0, None),
    name: str = "count",
) -> DataFrame:
    """Item frequencies inside the ``k`` busiest groups, per group or pooled."""
    pairs = pair_counts(exclude_values(df, group, exclude), group, item, name)
    inside = _pairs_in_top_groups(pairs, group, k, name)
    if pooled:
        return inside.groupBy(item).agg(F.sum(name).alias(name))
    return inside


def common_items(
    df: DataFrame,
    group: str,
    item: str,
    k: int = 3,
    per_group: int = 5,
    exclude: Iterable | None = (0, None),
) -> DataFrame:
    """Items ranked within the first ``per_group`` dense ranks of every one of the ``k`` busiest groups.

    Output: item, ``groups`` (= number of top groups), ``count`` (summed over them).
    """
    pairs = pair_counts(exclude_values(df, group, exclude), group, item)
    n_top = top_groups_of(pairs, group, k).select(F.count(F.lit(1))).scalar()
    ranked = rank_within(_pairs_in_top_groups(pairs, group, k), group, per_group)
    return (
        ranked.groupBy(item)
        .agg(F.count_distinct(group).alias("groups"), F.sum("count").alias("count"))
        .filter(F.col("groups") == n_top)
    )


def top_bins_for_top_items(
    df: DataFrame,
    item: str,
    bin_col: str,
    k: int = 3,
    per_item: int = 3,
    exclude: Iterable | None = (0, None),
) -> DataFrame:
    """For the ``k`` most frequent items, their ``per_item`` busiest bins (dense rank, ties kept).

    Output: item, bin, count, rank.
    """
    pairs = pair_counts(exclude_values(df, item, exclude), item, bin_col)
    return rank_within(_pairs_in_top_groups(pairs, item, k), item, per_item)


def stacked_counts(
    df: DataFrame,
    group: str,
    item: str,
    k: int | None = None,
    exclude: Iterable | None = (0, None),
    name: str = "count",
    share: str = "share",
) -> DataFrame:
    """Chart-ready stacked bars: count of each item within each group and its percent of the group.

    Replaces pulling raw rows to the client for plotting; only
    ``#groups x #items`` rows come out.  ``k`` keeps the ``k`` busiest
    groups only.
    """
    if k is None:
        counts = pair_counts(df, group, item, name)
    else:
        counts = _pairs_in_top_groups(pair_counts(exclude_values(df, group, exclude), group, item, name), group, k, name)
    w = Window.partitionBy(group)
    return counts.withColumn(share, F.col(name).cast("double") * F.lit(100.0) / F.sum(name).over(w).cast("double"))
