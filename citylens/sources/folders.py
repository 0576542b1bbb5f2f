"""A folder of CSV files whose layouts drift, read as one table.

Yearly files differ in columns, in their order and in what the columns
hold.  The files are indexed by their header line; the files of one header
are one reader, so no value can shift into another column; a column that is
whole numbers in one layout and text in another becomes the narrowest type
that holds both, and the layouts are united by column name.
"""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citylens.operators.columns import normalize_name

#: From narrow to wide: every type holds the values of those before it.
LATTICE = ("int", "bigint", "double", "string")
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
#: Whole numbers from here on are not exact as double.
_EXACT = 2**53


def header_index(spark: SparkSession, path: str | list[str], glob: str = "*.csv*") -> DataFrame:
    """``(file, header)``: the first line of every file below the path; empty files have none.

    Lines are looked at in the first block of each file only, as plain text.  The first of many texts is found by
    sorting all lines of a block, the first of many numbers in place: so one pass keeps the hash of each file's first
    line, and a second the lines of that hash.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    first = lines.filter(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("header"),
        F.xxhash64("value").alias("hash"), F.length("value").alias("length"),
    )
    # a block is read by one task in order, so its first line is the file's
    heads = first.groupBy("file").agg(F.first("hash").alias("hash"), F.first("length").alias("length"))
    # one row per file is small enough for every task; a line that comes again is one row, so one per file is left
    return first.join(F.broadcast(heads), ["file", "hash", "length"]).select("file", "header").distinct()


def layouts(spark: SparkSession, path: str | list[str], glob: str = "*.csv*") -> dict[str, list[str]]:
    """The files of each header line (file names are metadata that the reader needs on the driver)."""
    out: dict[str, list[str]] = {}
    for row in header_index(spark, path, glob).orderBy("file").collect():
        out.setdefault(row["header"].lstrip("﻿"), []).append(unquote(row["file"]))
    return out


def type_level(value: Column) -> Column:
    """The place in ``LATTICE`` a text needs; NULL for NULL.

    A whole number needs ``int`` or, beyond its range, ``bigint``; one with a fraction or exponent ``double``; a longer whole
    number and any other text ``string``.
    """
    # casts only of what looks like a number (a failed cast is slow), and of short whole numbers not at all
    length = F.length(F.trim(value))
    exact = F.when(length <= 9, 0).when(value.try_cast("int").isNotNull(), 0).when(value.try_cast("bigint").isNotNull(), 1).otherwise(3)
    return (
        F.when(value.isNull(), None)
        .when(value.rlike(_WHOLE), exact)
        .when(value.rlike(_NUMBER) & (F.abs(value.try_cast("double")) < float("inf")), 2)
        .otherwise(3)
    )


def widest_types(df: DataFrame) -> dict[str, tuple[int | None, bool]]:
    """Per text column: the level its values need (None: no value) and whether some whole number is not exact as double.

    One pass, one row: a maximum per column.
    """
    if not df.columns:
        return {}
    quoted = [F.col(f"`{c}`") for c in df.columns]
    levels = [F.max(type_level(c)).alias(f"l{i}") for i, c in enumerate(quoted)]
    large = [
        F.max((F.length(c) > 15) & c.rlike(_WHOLE) & (F.abs(c.try_cast("decimal(38,0)")) > _EXACT)).alias(f"b{i}")
        for i, c in enumerate(quoted)
    ]
    row = df.agg(*levels, *large).first()
    return {c: (row[f"l{i}"], bool(row[f"b{i}"])) for i, c in enumerate(df.columns)}


def widen(seen: list[tuple[int | None, bool]]) -> str:
    """The narrowest type for a column from what each layout needs; text if no layout has a value."""
    levels = [level for level, _ in seen if level is not None]
    if not levels:
        return "string"
    widest = max(levels)
    # fractions beside whole numbers that a double would round: text loses nothing
    if widest == 2 and any(large for _, large in seen):
        widest = 3
    return LATTICE[widest]


def read_mixed_folder(
    spark: SparkSession,
    path: str | list[str],
    types: Mapping[str, str] | None = None,
    lower: bool = False,
    glob: str = "*.csv*",
    file_col: str | None = None,
) -> DataFrame:
    """All files below ``path``, whatever their layouts, as one table with normalised column names.

    A column a layout lacks is NULL there.  ``types`` gives the type of columns by their normalised name; the others
    are found in one pass per layout over the files (``widest_types``) and widened over the layouts.  A value that
    does not fit a given type is NULL.  ``file_col`` adds the file each row came from.  Two columns of one layout
    with the same normalised name, and a folder without any header, are errors.
    """
    types = dict(types or {})
    found = layouts(spark, path, glob)
    if not found:
        raise ValueError(f"no file with a header line below {path}")
    frames = []
    for files in found.values():
        reader = spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
        raw = reader.csv(files)
        names = [normalize_name(c, lower) for c in raw.columns]
        if len({n.lower() for n in names}) != len(names):
            raise ValueError(f"normalised names collide in {files[0]}: {names}")
        if file_col:
            raw = raw.select("*", F.col("_metadata.file_path").alias(file_col))
            names.append(file_col)
        frames.append(raw.toDF(*names))
    # names that differ in case only are one column, spelt as first seen
    spelt: dict[str, str] = {}
    for frame in frames:
        for c in frame.columns:
            spelt.setdefault(c.lower(), c)
    frames = [f.toDF(*[spelt[c.lower()] for c in f.columns]) for f in frames]
    given = {c.lower() for c in types} | ({file_col.lower()} if file_col else set())
    seen: dict[str, list] = {}
    for frame in frames:
        for c, need in widest_types(frame.select(*[f"`{c}`" for c in frame.columns if c.lower() not in given])).items():
            seen.setdefault(c, []).append(need)
    final = {c: widen(needs) for c, needs in seen.items()} | {spelt.get(c.lower(), c): t for c, t in types.items()}
    out = None
    for frame in frames:
        typed = frame.select(*[
            F.col(f"`{c}`").try_cast(final[c]).alias(c) if final.get(c, "string") != "string" else F.col(f"`{c}`")
            for c in frame.columns
        ])
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    return out
