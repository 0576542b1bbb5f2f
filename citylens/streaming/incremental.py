"""Incremental audits over a stream of CSV files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.operators._common import as_list
from citylens.session import scratch_path
from citylens.sources.csv import TRIP_TIMESTAMP_FORMAT


def read_csv_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_bytes_per_trigger: str | None = None,
    timestamp_format: str = TRIP_TIMESTAMP_FORMAT,
) -> DataFrame:
    """A streaming DataFrame over header CSV files landing in ``path`` (declared schema, no inference).

    A micro-batch takes all files there are unless ``max_bytes_per_trigger``
    (such as ``"500g"``) bounds its size.  A file whose header differs from
    the schema, in names or order, ends the stream with an error.
    """
    reader = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("timestampFormat", timestamp_format)
        .option("timestampNTZFormat", timestamp_format)
    )
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.csv(path)


def incremental_rule_counts(stream: DataFrame, rules: Mapping[str, Column], by: str | Sequence[str] | None = None) -> DataFrame:
    """Running violation counts per rule (wide: one column per rule), kept in streaming state.

    Use ``citylens.operators.quality``'s long form on each emitted table
    (``run_available(..., finish=to_long)``) to get (by..., rule, n_bad).
    """
    keys = as_list(by)
    aggs = [F.count_if(pred).alias(name) for name, pred in rules.items()]
    return stream.groupBy(*keys).agg(*aggs) if keys else stream.groupBy().agg(*aggs)


def incremental_count_by(stream: DataFrame, keys, name: str = "count") -> DataFrame:
    """Running row counts per group."""
    return stream.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias(name))


def run_available(
    result: DataFrame,
    name: str = "stream",
    finish: Callable[[DataFrame], DataFrame] | None = None,
    output: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame | None:
    """Process every file available now (``availableNow`` trigger) and return the final table.

    The aggregation runs in complete mode; each micro-batch writes the Parquet
    table, optionally reshaped by ``finish``, to a folder of its own below
    ``output`` (by default ``table`` in the checkpoint folder), so a batch
    that dies half-way leaves the version before it whole.  The table is the
    newest version whose write was committed.  The streaming checkpoint
    (offsets + state) is on the same shared storage: a second call with a
    kept ``checkpoint`` resumes, and without new files returns the table as
    it was.  None is returned if no batch ever ran.
    """
    spark = result.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    out = output or f"{ckpt.rstrip('/')}/table"

    def write(batch: DataFrame, epoch: int) -> None:
        (finish(batch) if finish else batch).write.mode("overwrite").parquet(f"{out}/version={epoch}")
        # only after the whole version is written
        spark.range(epoch, epoch + 1).write.mode("append").parquet(f"{out}/committed")

    query = (
        result.writeStream.outputMode("complete")
        .option("checkpointLocation", ckpt)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    newest = newest_version(spark, out)
    return None if newest is None else spark.read.parquet(newest)


def newest_version(spark: SparkSession, out: str) -> str | None:
    """The folder of the newest committed version below ``out``."""
    try:
        newest = spark.read.schema("id long").parquet(f"{out}/committed").agg(F.max("id")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if newest is None else f"{out}/version={newest}"
