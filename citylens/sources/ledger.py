"""A stored ledger of audit counts per partition of a table, rule and rule version.

A table that grows by months need not be audited as a whole after each
load.  The ledger keeps the counts of every (partition, content, rule,
version); an update lists the partitions, compares the fingerprint of each
one's files with the ledger, and scans only those that are new or replaced,
and for a changed rule only that rule's columns.  It is append-only: counts
of replaced contents and old versions stay behind and are no longer read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.operators._common import as_list


@dataclass(frozen=True)
class Rule:
    """A predicate a bad row meets (NULL is not a violation) and its version: a new version is counted anew."""

    predicate: Column
    version: int = 1


def file_index(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """``(path, length, modified)`` of the files below a folder; their contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def partition_fingerprints(spark: SparkSession, path: str, partition_by: Sequence[str]) -> DataFrame:
    """``(partition..., content)`` of a table partitioned into folders: the content changes if any file does."""
    files = file_index(spark, path)
    # folder names are escaped like URLs, but for the plus sign
    unescaped = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = lambda name: unescaped(F.regexp_extract("path", f"/{name}=([^/]+)/", 1))
    one = F.xxhash64("path", "length", "modified")
    grouped = files.groupBy(*[folder(c).alias(c) for c in partition_by])
    return grouped.agg(
        F.concat_ws(":", F.count(F.lit(1)), F.sum("length"), F.bit_xor(one), F.sum(F.shiftright(one, 24))).alias("content")
    )


@dataclass
class AuditLedger:
    """The ledger at ``path`` of the Parquet table at ``table``, which is partitioned by ``partition_by``."""

    spark: SparkSession
    table: str
    path: str
    partition_by: Sequence[str] = ("year", "month")
    by: Sequence[str] | str | None = None

    def _schema(self) -> T.StructType:
        columns = self.spark.read.parquet(self.table).schema
        text = [T.StructField(f"part_{c}", T.StringType()) for c in self.partition_by]
        keys = [T.StructField(c, columns[c].dataType) for c in as_list(self.by)]
        fixed = T._parse_datatype_string("content string, rule string, version int, n_bad bigint").fields
        return T.StructType([*text, *keys, *fixed])

    def stored(self) -> DataFrame:
        """Everything ever counted."""
        schema = self._schema()
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _wanted(self, rules: Mapping[str, Rule]) -> DataFrame:
        """``(part..., content, rule, version)`` that the counts of the present table are made of."""
        parts = partition_fingerprints(self.spark, self.table, self.partition_by)
        parts = parts.toDF(*[f"part_{c}" for c in self.partition_by], "content")
        each = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(r.version).alias("version")) for n, r in rules.items()])
        return parts.select("*", F.inline(each))

    @property
    def _key(self) -> list[str]:
        return [*[f"part_{c}" for c in self.partition_by], "content", "rule", "version"]

    def pending(self, rules: Mapping[str, Rule]) -> DataFrame:
        """The (partition, rule) pairs the ledger does not hold yet."""
        return self._wanted(rules).join(self.stored().select(*self._key).distinct(), self._key, "left_anti")

    def update(self, rules: Mapping[str, Rule]) -> list[dict]:
        """Count what is pending; returns the (partition, rule) pairs that were counted.

        Pairs are metadata: a row per partition and rule.  Partitions that lack the same rules are read together, in
        one scan with one aggregate, and only their folders are read.  The counts are appended at once, when all are
        written; an update that dies leaves the ledger as it was.
        """
        pairs = [r.asDict() for r in self.pending(rules).collect()]
        lacking: dict[tuple, list] = {}
        for pair in pairs:
            lacking.setdefault(tuple(pair[f"part_{c}"] for c in self.partition_by) + (pair["content"],), []).append(pair["rule"])
        together: dict[tuple, list] = {}
        for part, names in lacking.items():
            together.setdefault(tuple(sorted(names)), []).append(part)
        counted = None
        for names, parts in together.items():
            one = self._count({n: rules[n] for n in names}, parts)
            counted = one if counted is None else counted.unionByName(one)
        if counted is not None:
            counted.write.mode("append").parquet(self.path)
        return pairs

    def _count(self, rules: Mapping[str, Rule], parts: list[tuple]) -> DataFrame:
        table = self.spark.read.parquet(self.table)
        keys = as_list(self.by)
        text = [F.col(c).cast("string") for c in self.partition_by]
        # the values are compared in the column's own type, so that the folders are pruned
        null = "__HIVE_DEFAULT_PARTITION__"
        chosen = F.lit(False)
        for part in parts:
            this = F.lit(True)
            for c, value in zip(self.partition_by, part):
                same = F.col(c).isNull() if value == null else F.col(c) == F.lit(value).cast(table.schema[c].dataType)
                this = this & same
            chosen = chosen | this
        contents = self.spark.createDataFrame(parts, T.StructType(
            [T.StructField(f"part_{c}", T.StringType()) for c in self.partition_by] + [T.StructField("content", T.StringType())]
        ))
        sums = table.filter(chosen).groupBy(
            *[F.coalesce(t, F.lit(null)).alias(f"part_{c}") for t, c in zip(text, self.partition_by)], *keys
        ).agg(*[F.count_if(r.predicate).alias(n) for n, r in rules.items()])
        names = [f"part_{c}" for c in self.partition_by]
        long = sums.unpivot([*names, *keys], list(rules), "rule", "n_bad")
        versions = F.create_map(*[x for n, r in rules.items() for x in (F.lit(n), F.lit(r.version))])
        # content is the fingerprint the pair was listed with: a partition replaced meanwhile is pending again
        return long.join(contents, names).withColumn("version", versions[F.col("rule")]).select(
            *names, *keys, "content", "rule", "version", "n_bad"
        )

    def counts(self, rules: Mapping[str, Rule]) -> DataFrame:
        """``(partition..., by..., rule, n_bad)`` of the present table, from the ledger alone (after ``update``)."""
        held = self.stored().dropDuplicates([*self._key, *as_list(self.by)])
        held = held.join(self._wanted(rules), self._key)
        types = self.spark.read.parquet(self.table).schema
        null = "__HIVE_DEFAULT_PARTITION__"
        parts = [F.nullif(F.col(f"part_{c}"), F.lit(null)).cast(types[c].dataType).alias(c) for c in self.partition_by]
        return held.select(*parts, *as_list(self.by), "rule", "n_bad")
