"""Typed CSV ingest of trip and ticket files (any Hadoop path: local, hdfs://, s3a://)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.schemas import TICKET_TYPES, TRIP_SCHEMA, ticket_schema

TRIP_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_trips(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = TRIP_SCHEMA,
    timestamp_format: str = TRIP_TIMESTAMP_FORMAT,
) -> DataFrame:
    """Monthly trip files with a declared schema.

    The header line is skipped and blank lines are dropped by the reader,
    so the "skip two header lines" table property needs no special case
    and a data row on line 2 is not lost.  Unparseable fields become NULL
    (PERMISSIVE mode) instead of failing the job; ``count_malformed`` counts
    their rows.  A file whose header differs from the schema, in names or
    order, is an error: values never shift into another column.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("sep", ",")
        .option("mode", "PERMISSIVE")
        .option("timestampFormat", timestamp_format)
        .option("timestampNTZFormat", timestamp_format)
        .csv(path)
    )


def read_tickets(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    typed: bool = True,
    schema: T.StructType | None = None,
    infer: bool = False,
) -> DataFrame:
    """A yearly ticket file with header.

    * ``columns`` (the header names, in order): the schema is declared up front.
    * no ``columns``: the header is read as is (so yearly files whose
      columns drift need no list) and, with ``typed=True``, the known
      numeric columns are converted with ``try_cast`` -- no inference pass,
      and a malformed value becomes NULL instead of failing the job.
    * ``typed=False`` keeps every column as text; ``infer=True`` uses
      Spark's type inference (an extra pass over the file).

    Every file of the path must have the same header (and that of the
    declared schema): one that differs is an error.  Files of other layouts
    are read apart and stacked by name (``read_ticket_years``).
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    if schema is None and columns is not None:
        schema = ticket_schema(columns, typed=typed)
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.csv(path)
    if not typed:
        return raw
    return raw.select(
        *[
            F.col(f"`{c}`").try_cast(TICKET_TYPES[c]).alias(c) if c in TICKET_TYPES else F.col(f"`{c}`")
            for c in raw.columns
        ]
    )


def read_ticket_years(
    spark: SparkSession,
    paths: Mapping[int, str | list[str]],
    keep: Sequence[str] | None = None,
    year_col: str = "year",
    lower: bool = False,
) -> DataFrame:
    """Yearly ticket files with drifting columns as one table.

    Each file is read with its own header, names are normalised
    (``Days Parking In Effect    `` -> ``Days_Parking_In_Effect``), the
    ``keep`` columns are projected (the common core; a column a year lacks
    becomes NULL) and the years are stacked by name with a ``year`` column.
    """
    from citylens.operators.columns import normalize_columns
    from citylens.operators.compare import stack_years

    frames = {}
    for year, path in paths.items():
        df = normalize_columns(read_tickets(spark, path), lower=lower)
        if keep is not None:
            df = df.select(*[c for c in keep if c in df.columns])
        frames[year] = df
    # unionByName fills a column a year lacks with NULL of the other years' type
    stacked = stack_years(frames, year_col)
    for c in keep or ():
        if c not in stacked.columns:
            stacked = stacked.withColumn(c, F.lit(None).cast("string"))
    return stacked.select(*(list(keep) + [year_col] if keep is not None else stacked.columns))


def count_malformed(spark: SparkSession, path: str | list[str], schema: T.StructType, **options: str) -> DataFrame:
    """One row ``(rows, malformed)``: how many lines have fields that do not fit the schema (PERMISSIVE makes them NULL).

    A file whose header differs from the schema is an error, as in ``read_trips``.
    """
    corrupt = "_malformed"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    reader = spark.read.schema(full).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
    lines = reader.option("columnNameOfCorruptRecord", corrupt).options(**options).csv(path)
    # all columns are used (any hash is below the bound), so that every field of a line is parsed
    parsed = F.xxhash64(*[F.col(f"`{f.name}`") for f in schema.fields]) <= F.lit(2**63 - 1)
    bad = F.count_if(parsed & F.col(corrupt).isNotNull())
    return lines.agg(F.count(F.lit(1)).alias("rows"), bad.alias("malformed"))


def write_csv(
    df: DataFrame, path: str, timestamp_format: str = TRIP_TIMESTAMP_FORMAT, partition_by: Sequence[str] = ()
) -> str:
    """Write ``df`` as header CSV (used to produce fixtures and exports); blanks in names and values are kept.

    The ``partition_by`` columns become folders and are left out of the files.
    """
    (
        df.write.mode("overwrite")
        .partitionBy(*partition_by)
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampFormat", timestamp_format)
        .option("timestampNTZFormat", timestamp_format)
        .csv(path)
    )
    return path
