"""Intermediate tables and small text expressions shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citylens.session import scratch_path

# The characters that separate words: space, and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to shared scratch storage and read it back (cuts the lineage; survives lost executors)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_workers_import(spark: SparkSession) -> None:
    """Put this package on the import path of local Python workers.

    A cluster gets the package from the launcher (``--py-files`` or its image).
    """
    context = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if context.master.startswith("local") and root not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([root, *[p for p in paths if p]])


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text with NULL read as empty."""
    col = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit(""))


def bytes_of(column: str | Column) -> Column:
    return text_of(column).cast("binary")


def words_of(column: Column) -> Column:
    """Lower-cased words (A-Z only) of a text column, natively."""
    lowered = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, SPACE_CLASS + "+"), lambda w: w != "")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, so that what is built from one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return shift + np.arange(ends[-1] if len(ends) else 0)


class WordIndex(dict):
    """Numbers the distinct words of a task in order of appearance.

    ``fresh`` lists the words numbered since it was last emptied, for
    whatever the caller keeps per word.
    """

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class WordTable:
    """Reads texts as the values of their white-space words; the values of a distinct word are worked out once.

    ``values_of`` gives the list of integers of each of some words, or all as
    bytes: little-endian 32-bit integers.  When more than ``limit`` words are
    numbered, those met once are forgotten.
    """

    def __init__(self, values_of: Callable[[list[bytes]], list], limit: int = 300_000) -> None:
        self.values_of, self.limit = values_of, limit
        self.index = WordIndex()
        self.flat = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int64)

    def _forget(self) -> None:
        kept = np.flatnonzero(self.used > 1)
        if len(kept) > self.limit // 2:
            kept = np.argsort(-self.used, kind="stable")[: self.limit // 2]
        names = list(self.index)
        self.index = WordIndex()
        self.index.update((names[i], n) for n, i in enumerate(kept.tolist()))
        self.flat = self.flat[ragged(self.starts[kept], self.lengths[kept])]
        self.lengths, self.used = self.lengths[kept], self.used[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _learn(self) -> None:
        values = self.values_of(self.index.fresh)
        self.index.fresh = []
        lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
        if isinstance(values[0], bytes):
            lengths //= 4
            flat = np.frombuffer(b"".join(values), dtype="<u4").astype(np.int64)
        else:
            flat = np.fromiter(chain.from_iterable(values), dtype=np.int64, count=int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.zeros(len(values), dtype=np.int64)])
        self.flat = np.concatenate([self.flat, flat])

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all texts in a row, and the number of the text each belongs to."""
        if len(self.index) > self.limit:
            self._forget()
        numbers = [self.index.number(t.split()) for t in texts]
        if self.index.fresh:
            self._learn()
        words = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        self.used += np.bincount(words, minlength=len(self.used))
        owner = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
        lengths = self.lengths[words]
        return self.flat[ragged(self.starts[words], lengths)], np.repeat(owner, lengths)


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``keys``.

    Each table holds one or more complete groups (the rows of one batch plus
    what was carried over); memory is that of a batch and the longest group.
    """
    carry: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != v for c, v in zip(columns, last))
        last = [c[-1] for c in columns]
        cuts = np.flatnonzero(change)
        if len(cuts):
            cut = int(cuts[-1])
            carry.append(batch.slice(0, cut))
            yield pa.Table.from_batches([b for b in carry if b.num_rows] or carry[:1])
            carry = [batch.slice(cut)]
        else:
            carry.append(batch)
    if carry:
        yield pa.Table.from_batches(carry)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
