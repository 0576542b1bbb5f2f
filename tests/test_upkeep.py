"""Grouped percentiles, audit ledger, mixed folders, rejected lines, audits while writing."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.operators import exact_percentiles_by, summary_percentiles
from citylens.operators.stats import value_ranges
from citylens.sources import count_malformed, materialize, materialize_audited, split_rejects
from citylens.sources.folders import header_index, layouts, read_mixed_folder, type_level, widen
from citylens.sources.ledger import AuditLedger, Rule
from citylens.streaming import incremental_count_by, read_csv_stream, run_available


# -- percentiles per group ----------------------------------------------------------

def _grouped(seed=1):
    draw = random.Random(seed)
    rows = [("hot", float(draw.randint(0, 5000))) for _ in range(6000)]
    rows += [(draw.choice(["a", "b", None]), draw.choice([draw.random() * 9, None, 3.5])) for _ in range(300)]
    return rows + [("one", 7.25), ("none", None)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_exact_percentiles_by_group(spark, adaptive):
    rows, ps = _grouped(), (0.0, 0.1, 0.5, 0.77, 0.99, 1.0)
    df = spark.createDataFrame(rows, "k string, v double")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = {r.k: r for r in exact_percentiles_by(df, "v", ps, "k").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert set(got) == {"hot", "a", "b", None, "one", "none"}
    for k, r in got.items():
        values = [v for key, v in rows if key == k and v is not None]
        if not values:
            assert r[1:] == (None,) * 7
            continue
        assert r.avg == pytest.approx(np.mean(values))
        assert list(r[2:]) == pytest.approx(list(np.quantile(values, ps)))


def test_a_hot_group_is_the_work_of_several_tasks(spark):
    df = spark.createDataFrame(_grouped(), "k string, v double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = value_ranges(df, "v", "k").filter("k = 'hot'").select("part").distinct().count()
        plan = summary_percentiles(df, "v", exact=True, by="k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 3
    assert "percentile" not in plan and "collect_list" not in plan


def test_exact_percentiles_by_two_keys_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 4), (1, None, 9)], "a int, b string, v int")
    got = sorted(map(tuple, exact_percentiles_by(df, "v", [0.5], ["a", "b"]).collect()), key=str)
    assert got == [(1, "x", 2.5, 2.5), (1, None, 9.0, 9.0)] or got == [(1, None, 9.0, 9.0), (1, "x", 2.5, 2.5)]
    assert exact_percentiles_by(df.limit(0), "v", [0.5], "a").collect() == []


# -- audit ledger ------------------------------------------------------------------------

def _ledger(spark, tmp_path, rows):
    table = f"{tmp_path}/t"
    df = spark.createDataFrame(rows, "year int, month int, vendor string, v int")
    materialize(df, table, partition_by=("year", "month"))
    return AuditLedger(spark, table, f"{tmp_path}/ledger", by="vendor"), table


def _full(spark, table, rules):
    df = spark.read.parquet(table)
    sums = df.groupBy("year", "month", "vendor").agg(*[F.count_if(r.predicate).alias(n) for n, r in rules.items()])
    return sorted(map(tuple, sums.unpivot(["year", "month", "vendor"], list(rules), "rule", "n_bad").collect()), key=str)


def _of(ledger, rules):
    return sorted(map(tuple, ledger.counts(rules).select("year", "month", "vendor", "rule", "n_bad").collect()), key=str)


def test_ledger_follows_loads_reloads_and_rule_changes(spark, tmp_path):
    draw = random.Random(2)
    rows = [(2017, draw.choice([9, 10, 11, 12]), draw.choice(["1", "2", None]), draw.randint(-3, 3)) for _ in range(400)]
    rows += [(None, 1, "1", -1)]
    ledger, table = _ledger(spark, tmp_path, rows)
    rules = {"negative": Rule(F.col("v") < 0), "zero": Rule(F.col("v") == 0)}
    assert len(ledger.update(rules)) == 5 * 2
    assert _of(ledger, rules) == _full(spark, table, rules)
    assert ledger.update(rules) == []
    # a new month: only that is read
    materialize(spark.createDataFrame([(2018, 1, "1", 0)], "year int, month int, vendor string, v int"), table, partition_by=("year", "month"))
    assert {(p["part_year"], p["part_month"]) for p in ledger.update(rules)} == {("2018", "1")}
    # a month comes again: its counts are replaced
    materialize(spark.createDataFrame([(2017, 10, "9", -5)] * 3, "year int, month int, vendor string, v int"), table, partition_by=("year", "month"))
    assert [(p["part_year"], p["part_month"]) for p in ledger.update(rules)] == [("2017", "10")] * 2
    assert _of(ledger, rules) == _full(spark, table, rules)
    # a rule changes: all months, that rule alone
    changed = {**rules, "zero": Rule(F.abs("v") <= 1, version=2)}
    counted = ledger.update(changed)
    assert len(counted) == 6 and {p["rule"] for p in counted} == {"zero"}
    assert _of(ledger, changed) == _full(spark, table, changed)
    assert _of(ledger, rules) == _full(spark, table, rules)  # the old version is still held


def test_ledger_reads_only_the_partitions_it_lacks(spark, tmp_path):
    ledger, _ = _ledger(spark, tmp_path, [(2017, m, "1", m - 5) for m in range(1, 13)])
    rules = {"negative": Rule(F.col("v") < 0)}
    counts = ledger._count(rules, [("2017", "3", "c")])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(month" in plan
    assert {r.part_month for r in counts.collect()} == {"3"}


def test_an_update_that_fails_leaves_the_ledger_as_it_was(spark, tmp_path):
    ledger, table = _ledger(spark, tmp_path, [(2017, m, "1", m - 5) for m in range(1, 4)])
    good = {"negative": Rule(F.col("v") < 0)}
    with pytest.raises(Exception):
        ledger.update({**good, "broken": Rule(F.expr("v / (v - v) > 0"))})
    assert ledger.stored().count() == 0
    assert len(ledger.update(good)) == 3 and _of(ledger, good) == _full(spark, table, good)


# -- mixed folders ------------------------------------------------------------------

def _files(tmp_path, **texts):
    root = tmp_path / uuid.uuid4().hex
    for name, text in texts.items():
        (root / name).mkdir(parents=True)
        (root / name / "part 1.csv").write_text(text, encoding="utf-8")
    return str(root)


def test_mixed_folder(spark, tmp_path):
    root = _files(
        tmp_path,
        y2015='Id,"Street, Name ",Fine,House\n1,Main,10,12\n2,,20,\n',
        y2016="﻿House,Id,Fine\n7B,3000000001,12.5\n",
        y2017='Id,"Street, Name ",Fine,House\n3,"Oak, East",,14\n',
        bad="",
    )
    assert sorted(len(f) for f in layouts(spark, root).values()) == [1, 2]
    assert header_index(spark, root).count() == 3
    df = read_mixed_folder(spark, root, lower=True, file_col="file")
    assert dict(df.dtypes) == {"id": "bigint", "street_name": "string", "fine": "double", "house": "string", "file": "string"}
    got = sorted((r.id, r.street_name, r.fine, r.house) for r in df.collect())
    assert got == [(1, "Main", 10.0, "12"), (2, None, 20.0, None), (3, "Oak, East", None, "14"), (3000000001, None, 12.5, "7B")]
    assert {r.file.split("/")[-2] for r in df.collect()} == {"y2015", "y2016", "y2017"}
    given = read_mixed_folder(spark, root, types={"House": "int"})
    assert dict(given.dtypes)["House"] == "int" and given.filter("House IS NULL").count() == 2


def test_headers_are_found_without_sorting_the_lines(spark, tmp_path):
    root = _files(tmp_path, a="x,y\n1,2\nx,y\n1,2\n", b="\nx,y\n1,2\n", c="y,x\r\n2,1\r\n", bad="")
    found = header_index(spark, root)
    assert sorted((r.file.split("/")[-2], r.header) for r in found.collect()) == [("a", "x,y"), ("b", ""), ("c", "y,x")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "HashAggregate" in plan


def test_mixed_folder_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="collide"):
        read_mixed_folder(spark, _files(tmp_path, a="A b,A  b\n1,2\n"))
    with pytest.raises(ValueError, match="no file"):
        read_mixed_folder(spark, _files(tmp_path, a=""))
    # a layout without rows still gives its columns
    df = read_mixed_folder(spark, _files(tmp_path, a="x,y\n", b="X,z\n1,2\n"))
    assert df.columns == ["x", "y", "z"] and [tuple(r) for r in df.collect()] == [(1, None, 2)]


@pytest.mark.parametrize(
    "values, want",
    [
        (["1", " -7 ", None], "int"), (["1", "2147483648"], "bigint"), (["1", "2.5", "1e3", ".5"], "double"),
        (["1", "x"], "string"), (["12D"], "string"), (["NaN"], "string"), (["99999999999999999999"], "string"),
        (["9007199254740993", "0.5"], "string"), (["1e999"], "string"), ([None], "string"), ([""], "string"),
    ],
)
def test_widening(spark, values, want):
    from citylens.sources.folders import widest_types

    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert widen([widest_types(df)["c"]]) == want
    # the same, one layout per value
    alone = [widest_types(df.filter(F.col("c").eqNullSafe(v)))["c"] for v in values]
    assert widen(alone) == want
    assert df.select(type_level(F.col("c"))).count() == len(values)


# -- rejected lines -----------------------------------------------------------------

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("t", T.TimestampNTZType())])


def test_rejected_lines_are_kept_with_their_reason(spark, tmp_path):
    root = _files(
        tmp_path,
        one="a,b,t\n\n1,x,2017-11-01 00:00:00\n,,\nsix,x,2017-11-01 00:00:00\n2,y\n3,y,2017-11-01 00:00:00,more\n",
        two='a,b,t\n4,"q,r",not a time\n5,"q,r",2017-11-01 00:00:01\n2147483648,z,\n',
    )
    split = split_rejects(spark, f"{root}/*/", SCHEMA)
    accepted = {tuple(r)[:2] for r in split.accepted.collect()}
    assert accepted == {(1, "x"), (None, None), (5, "q,r")}
    rejected = {(r.file.split("/")[-2], r.line, r.column, r.reason) for r in split.rejected.collect()}
    assert rejected == {
        ("one", "six,x,2017-11-01 00:00:00", "a", "not int"),
        ("one", "2,y", None, "too few fields"),
        ("one", "3,y,2017-11-01 00:00:00,more", None, "too many fields"),
        ("two", '4,"q,r",not a time', "t", "not timestamp_ntz"),
        ("two", "2147483648,z,", "a", "not int"),
    }


def test_readers_refuse_other_headers(spark, tmp_path):
    root = _files(tmp_path, one="a,b\n1,2\n", two="b,a\n3,4\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    for read in (
        lambda: count_malformed(spark, f"{root}/*/", schema).collect(),
        lambda: split_rejects(spark, f"{root}/*/", schema),
        lambda: run_available(incremental_count_by(read_csv_stream(spark, f"{root}/*/", schema), "a")),
    ):
        with pytest.raises(Exception, match="(?i)header"):
            read()
    good = _files(tmp_path, one="a,b\n1,2\n", two="a,b\nx,4\n")
    assert tuple(count_malformed(spark, f"{good}/*/", schema).first()) == (2, 1)
    assert run_available(incremental_count_by(read_csv_stream(spark, f"{good}/*/", schema), "a")).count() == 2


# -- audits while writing ------------------------------------------------------------

def test_audit_while_writing(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.createDataFrame([(i, i % 7 - 2, i % 3) for i in range(1000)] + [(None, None, None)], "id int, v int, m int").write.parquet(src)
    df = spark.read.parquet(src)
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        table, counts = materialize_audited(df, {"negative": F.col("v") < 0, "late": F.col("id") >= 900}, keep=F.col("id") < 900,
                                            path=f"{tmp_path}/out", partition_by=("m",))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # one job writes and counts
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    assert counts == {"rows": 1001, "kept": 900, "negative": df.filter("v < 0").count(), "late": 100}
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.filter("id < 900").collect()))
    empty, none = materialize_audited(df.limit(0), {"negative": F.col("v") < 0})
    assert empty.count() == 0 and none == {"rows": 0, "kept": 0, "negative": 0}
    with pytest.raises(ValueError):
        materialize_audited(df, {}, path=src)
    with pytest.raises(ValueError):
        materialize_audited(df, {"rows": F.lit(True)})
