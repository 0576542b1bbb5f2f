"""Combining and materialising tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from citylens.session import scratch_path


def union_months(*frames: DataFrame) -> DataFrame:
    """UNION ALL of monthly frames by column name (duplicates kept)."""
    if not frames:
        raise ValueError("no frames")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_year_month(df: DataFrame, ts: str, year: str = "year", month: str = "month") -> DataFrame:
    return df.withColumn(year, F.year(ts)).withColumn(month, F.month(ts))


def materialize(
    df: DataFrame,
    path: str | None = None,
    partition_by: Sequence[str] = (),
    name: str = "table",
    table: str | None = None,
) -> DataFrame:
    """Write ``df`` once as Parquet and return a DataFrame reading it back.

    Cuts the lineage (later queries start from the written files, and a
    lost executor only re-reads them), and ``partition_by`` columns become
    directories that later period filters prune.  With ``partition_by`` only
    the partitions present in ``df`` are replaced, so months can be loaded
    one after the other into one folder, and rows are rebalanced by them:
    few files per partition, a heavy partition split over several tasks.
    Without ``path`` the table lands in a fresh folder below the session's
    checkpoint folder (shared storage on a cluster).  ``table`` registers it
    in the catalog.  A ``path`` that ``df`` itself reads is an error.
    """
    spark = df.sparkSession
    if path is not None and any(_below(f, path) for f in df.inputFiles()):
        raise ValueError(f"the table is read from {path}: write it elsewhere")
    target = path or scratch_path(spark, name)
    if partition_by:
        writer = df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by)
        writer = writer.option("partitionOverwriteMode", "dynamic")
    else:
        writer = df.write.mode("overwrite")
    if table:
        writer.option("path", target).saveAsTable(table)
        return spark.table(table)
    writer.parquet(target)
    return spark.read.parquet(target)


def materialize_audited(
    df: DataFrame,
    rules: Mapping[str, Column],
    keep: Column | None = None,
    path: str | None = None,
    partition_by: Sequence[str] = (),
    name: str = "audited",
) -> tuple[DataFrame, dict[str, int]]:
    """Write the rows that meet ``keep`` and count the rules in the same pass: ``(table, counts)``.

    ``counts`` has the rows met (``rows``), those written (``kept``), and per rule the rows that violate it: of all
    rows for a rule that is about what is left out, so ``keep`` and the rules are looked at before anything is dropped.
    The counts come from the tasks that write (``DataFrame.observe``); nothing is shuffled after them, so a task that
    is run again counts once.  A NULL ``keep`` leaves a row out.
    """
    for reserved in ("rows", "kept"):
        if reserved in rules:
            raise ValueError(f"{reserved} is no name for a rule")
    target = path or scratch_path(df.sparkSession, name)
    if any(_below(f, target) for f in df.inputFiles()):
        raise ValueError(f"the table is read from {target}: write it elsewhere")
    inside = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    seen = Observation()
    audited = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(inside).alias("kept"),
        *[F.count_if(predicate).alias(rule) for rule, predicate in rules.items()],
    )
    writer = audited.filter(inside).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(target)
    counts = {k: int(v) for k, v in seen.get.items()}
    return df.sparkSession.read.schema(df.schema).parquet(target), counts


def _below(file: str, folder: str) -> bool:
    """Whether a file's URL lies in a folder, whatever the spelling of the local scheme."""
    plain = lambda p: re.sub(r"^file:/+", "/", p).rstrip("/")
    return plain(file) == plain(folder) or plain(file).startswith(plain(folder) + "/")
