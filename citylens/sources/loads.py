"""Monthly files loaded once each: a manifest of what was loaded, committed after the data is written.

The same file again, under any name, adds nothing; a load that dies half-way
leaves rows that no manifest names and that nobody reads.  A file whose
content changed under the same name replaces the rows it gave before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citylens.sources.ledger import file_index

_MANIFEST = "load bigint, id string, path string, length bigint, modified timestamp, checksum string, data string"
#: Columns added to the loaded rows: the load and the file they came with.
LOAD_COL, FILE_COL = "_load", "_file"


def file_checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, checksum)`` of text files: number, length and two sums of hashes of their lines (a pass over the text)."""
    lines = spark.read.text(paths)
    h = F.xxhash64("value")
    by_file = lines.groupBy(F.col("_metadata.file_path").alias("path"))
    return by_file.agg(
        F.concat_ws(":", F.count(F.lit(1)), F.sum(F.length("value")), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).alias("checksum")
    )


@dataclass
class LoadedTable:
    """A table at ``root`` (``data`` and ``manifest`` below it) filled from files."""

    spark: SparkSession
    root: str

    def manifest(self) -> DataFrame:
        """Every file met: ``data`` is the load that holds its rows."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def current(self) -> DataFrame:
        """``(path, data, source)``: per file name the newest content, and the file and load whose rows stand for it."""
        newest = Window.partitionBy("path").orderBy(F.desc("load"))
        last = self.manifest().withColumn("r", F.row_number().over(newest)).filter("r = 1")
        return last.select("path", "checksum", "data")

    def load(self, source: str, read: Callable[[list[str]], DataFrame], glob: str = "*.csv") -> list[str]:
        """Load the files below ``source`` that are new; returns their paths.

        ``read`` makes a DataFrame of a list of files.  Files the manifest knows by name, size and time are not looked
        at; of the others a checksum tells whether their content was loaded before.  The rows are written first, then
        the manifest, in one append.  One load at a time.
        """
        known = self.manifest()
        files = file_index(self.spark, source, glob).join(known.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
        unseen = {r["path"]: r for r in files.collect()}  # metadata: a row per file
        if not unseen:
            return []
        sums = {_plain(r["path"]): r["checksum"] for r in file_checksums(self.spark, sorted(unseen)).collect()}
        held = {r["checksum"]: r["data"] for r in known.join(
            self.spark.createDataFrame([(c,) for c in set(sums.values())], "checksum string"), "checksum", "left_semi"
        ).select("checksum", "data").distinct().collect()} if sums else {}
        last = known.agg(F.max("load")).first()[0]
        number, load_id = (last or 0) + 1, uuid.uuid4().hex
        fresh, entries = {}, []
        for path in sorted(unseen):
            checksum = sums.get(_plain(path), "empty")
            if checksum not in held and checksum not in fresh and checksum != "empty":
                fresh[checksum] = path
            data = held.get(checksum, f"{number}-{load_id}")
            entries.append((number, load_id, path, unseen[path]["length"], unseen[path]["modified"], checksum, data))
        if fresh:
            rows = read(sorted(fresh.values()))
            rows = rows.select("*", F.col("_metadata.file_path").alias(FILE_COL))
            rows.write.parquet(f"{self.root}/data/{LOAD_COL}={number}-{load_id}")
        # the commit: until now nothing names the new rows
        entry = self.spark.createDataFrame(entries, _MANIFEST)
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return sorted(fresh.values())

    def table(self) -> DataFrame:
        """The rows of the newest content of every file, each content once."""
        named = [r["data"] for r in self.current().filter("checksum <> 'empty'").select("data").distinct().collect()]
        if not named:
            raise ValueError(f"nothing is loaded at {self.root}")
        folders = [f"{self.root}/data/{LOAD_COL}={d}" for d in sorted(named)]
        rows = self.spark.read.option("basePath", f"{self.root}/data").parquet(*folders)
        first = self._first_files()
        # one row per file and load: rows of a content that no file has any more are left out
        spelt = F.regexp_replace(F.url_decode(F.replace(F.col(FILE_COL), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
        kept = rows.withColumn("__file", spelt).join(
            first.select(F.col("data").alias("__data"), F.col("first").alias("__first")),
            (F.col(LOAD_COL) == F.col("__data")) & (F.col("__file") == F.col("__first")), "left_semi",
        )
        return kept.drop("__file", LOAD_COL, FILE_COL)

    def _first_files(self) -> DataFrame:
        """``(data, first)``: the file of a load whose rows hold each current content."""
        wanted = self.current().select("checksum", "data").distinct()
        order = Window.partitionBy("checksum", "data").orderBy("load", "path")
        held = self.manifest().withColumn("r", F.row_number().over(order)).filter("r = 1").select("checksum", "data", F.col("path").alias("first"))
        spelt = F.regexp_replace("first", "^file:/+", "file:/")
        return wanted.join(held, ["checksum", "data"]).select("data", spelt.alias("first"))


def _plain(path: str) -> str:
    """A file's name without URL escapes and with one spelling of the local scheme."""
    out = unquote(path)
    return "file:/" + out.split(":", 1)[1].lstrip("/") if out.startswith("file:") else out
