import os
import tempfile

from pyspark.sql import types as T

from citylens.operators import trip_rules
from citylens.operators.quality import _long_form
from citylens.streaming import incremental_count_by, incremental_rule_counts, read_csv_stream, run_available

SCHEMA = T.StructType(
    [
        T.StructField("vendor_id", T.StringType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("passenger_count", T.IntegerType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
    ]
)
HEADER = "vendor_id,trip_distance,passenger_count,fare_amount,tip_amount,total_amount\n"


def _land(folder, name, rows):
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(HEADER + "".join(",".join(map(str, r)) + "\n" for r in rows))


def test_incremental_audit_over_monthly_files(spark):
    folder = tempfile.mkdtemp(prefix="citylens-stream-")
    _land(folder, "2017-11.csv", [("1", 0.0, 1, 5.0, 1.0, 6.0), ("2", 1.0, 0, -2.0, 0.0, -2.0)])
    _land(folder, "2017-12.csv", [("1", 2.0, 2, 0.0, -1.0, 0.0), ("1", 0.0, 0, 3.0, 0.0, 3.0)])
    _land(folder, "2018-01.csv", [("2", 3.0, 1, 9.0, 1.0, 10.0)])
    stream = read_csv_stream(spark, folder, SCHEMA)
    rules = trip_rules()
    out = run_available(
        incremental_rule_counts(stream, rules, by="vendor_id"),
        "test-rules",
        finish=lambda b: _long_form(b, ["vendor_id"], list(rules), "rule", "n_bad"),
    )
    got = {(r.vendor_id, r.rule): r.n_bad for r in out.collect()}
    assert got[("1", "distance_zero")] == 2 and got[("1", "passengers_zero")] == 1
    assert got[("2", "fare_negative")] == 1 and got[("1", "tip_negative")] == 1
    assert got[("1", "total_zero")] == 1 and got[("2", "distance_zero")] == 0
    counts = {r.vendor_id: r["count"] for r in run_available(incremental_count_by(stream, "vendor_id"), "test-counts").collect()}
    assert counts == {"1": 3, "2": 2}


def test_a_kept_checkpoint_resumes(spark):
    folder, kept = tempfile.mkdtemp(prefix="citylens-stream-"), tempfile.mkdtemp(prefix="citylens-ckpt-")
    _land(folder, "2017-11.csv", [("1", 0.0, 1, 5.0, 1.0, 6.0)])

    def counts():
        stream = read_csv_stream(spark, folder, SCHEMA)
        out = run_available(incremental_count_by(stream, "vendor_id"), checkpoint=f"{kept}/c")
        return {r.vendor_id: r["count"] for r in out.collect()}

    assert counts() == {"1": 1}
    assert counts() == {"1": 1}  # no new file
    _land(folder, "2017-12.csv", [("1", 2.0, 2, 0.0, -1.0, 0.0), ("2", 2.0, 2, 0.0, -1.0, 0.0)])
    assert counts() == {"1": 2, "2": 1}  # the first file is not read again
    assert counts() == {"1": 2, "2": 1}


def test_no_file_at_all(spark):
    folder = tempfile.mkdtemp(prefix="citylens-stream-")
    assert run_available(incremental_count_by(read_csv_stream(spark, folder, SCHEMA), "vendor_id")) is None
