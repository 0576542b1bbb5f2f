"""Frames that every operator must take: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def frame(spark, rows):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{int(vocabulary * draw.random() ** 2)}" for _ in range(n))


def odd_rows():
    long = prose(5, 30_000)
    return [
        (1, "Plain text here, with a few words."),
        (2, None),
        (3, ""),
        (4, "   \t\n "),
        (5, long),
        (6, "Plain text here, with a few words."),
        (6, "Plain text here, with a few words."),
        (None, "no id at all but text"),
        (None, None),
        (7, "日本語 😀 é\u0000 x" + "y" * 5000),
        (8, "equal", None),
        (9, "equal", None),
    ]


def odd_frame(spark):
    """The odd rows, with more columns whose names clash with those the operators add."""
    df = frame(spark, odd_rows())
    for name in ("ids", "size", "copies", "fingerprint", "score", "block", "row", "tf", "key", "word", "decoded",
                 "held_out", "component_id", "spans", "__utf8", "a", "b", "target", "extra", "pi", "bucket", "batch"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)


def write_tables(tmp_path, **frames) -> str:
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
