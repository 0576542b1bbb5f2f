"""CSV lines that do not fit their schema, kept apart with the reason instead of turned into NULLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.session import scratch_path
from citylens.sources.csv import TRIP_TIMESTAMP_FORMAT

_LINE, _EXTRA, _FILE, _BAD = "__line", "__extra", "__file", "__rejected"


@dataclass(frozen=True)
class Split:
    """``accepted``: typed rows.  ``rejected``: ``(file, line, column, reason)``, one row per rejected line."""

    accepted: DataFrame
    rejected: DataFrame


def _fault(schema: T.StructType, line: Column) -> Column:
    """``(column, reason)`` of the first fault of a rejected line.

    The line is split again into plain text, one field more than the schema has: a field that is there as text but
    not as a value is what did not fit.
    """
    names = [f"f{i}" for i in range(len(schema.fields))]
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _EXTRA]])
    raw = F.from_csv(line, text.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "PERMISSIVE"})
    spelled = lambda column, reason: F.struct(F.lit(column).alias("column"), F.lit(reason).alias("reason"))
    fault = None
    for name, field in zip(names, schema.fields):
        unfit = raw[name].isNotNull() & F.col(f"`{field.name}`").isNull()
        now = spelled(field.name, f"not {field.dataType.simpleString()}")
        fault = F.when(unfit, now) if fault is None else fault.when(unfit, now)
    fault = fault.when(raw[_EXTRA].isNotNull(), spelled(None, "too many fields"))
    return fault.otherwise(spelled(None, "too few fields"))


def split_rejects(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    output: str | None = None,
    timestamp_format: str = TRIP_TIMESTAMP_FORMAT,
    **options: str,
) -> Split:
    """Read header CSV once and write accepted and rejected lines to two folders of one table.

    A line is rejected if it has too few or too many fields or a field that does not fit its type; an empty field is
    missing, not wrong.  Accepted and rejected lines together are all lines but headers and blank ones.  ``output``
    defaults to a folder below the session's checkpoint folder.  A file whose header differs from the schema is an error.
    """
    full = T.StructType([*schema.fields, T.StructField(_LINE, T.StringType())])
    lines = (
        spark.read.schema(full)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _LINE)
        .option("timestampFormat", timestamp_format)
        .option("timestampNTZFormat", timestamp_format)
        .options(**options)
        .csv(path)
    )
    target = output or scratch_path(spark, "split-lines")
    kept = lines.select("*", F.col("_metadata.file_path").alias(_FILE), F.col(_LINE).isNotNull().alias(_BAD))
    # one pass over the files: all columns are written, so every field is parsed
    kept.write.mode("overwrite").partitionBy(_BAD).parquet(target)
    written = spark.read.schema(kept.schema).parquet(target)
    accepted = written.filter(~F.col(_BAD)).select(*[f"`{f.name}`" for f in schema.fields])
    rejected = written.filter(_BAD).select(F.col(_FILE).alias("file"), F.col(_LINE).alias("line"), _fault(schema, F.col(_LINE)).alias("fault"))
    return Split(accepted, rejected.select("file", "line", "fault.column", "fault.reason"))
