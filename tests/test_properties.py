"""Property tests: operators against brute-force Python on random small inputs."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from citylens.functions import bucketize, time_bin
from citylens.operators import percent_share, top_k_per_group, top_n

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

keys = st.lists(st.one_of(st.none(), st.integers(min_value=0, max_value=6)), min_size=1, max_size=60)


@SETTINGS
@given(values=keys, n=st.integers(min_value=1, max_value=4))
def test_top_n_matches_counter(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "k int")
    got = [(r.k, r["count"]) for r in top_n(df, "k", n, exclude=(0, None)).collect()]
    counts = Counter(v for v in values if v not in (0, None))
    want = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:n]
    assert got == want


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), min_size=1, max_size=80), k=st.integers(1, 3))
def test_top_k_per_group_matches_dense_rank(spark, rows, k):
    df = spark.createDataFrame(rows, "g int, i int")
    got = sorted((r.g, r.i, r["count"], r["rank"]) for r in top_k_per_group(df, "g", "i", k).collect())
    want = []
    for g in {g for g, _ in rows}:
        c = Counter(i for gg, i in rows if gg == g)
        distinct = sorted(set(c.values()), reverse=True)
        for i, n in c.items():
            rank = distinct.index(n) + 1
            if rank <= k:
                want.append((g, i, n, rank))
    assert got == sorted(want)
    # every group keeps at least min(k, #items) rows: a superset of row_number() <= k
    for g in {g for g, _ in rows}:
        n_items = len({i for gg, i in rows if gg == g})
        assert sum(1 for r in got if r[0] == g) >= min(k, n_items)


@SETTINGS
@given(values=keys)
def test_percent_share_sums_to_100_and_counts_to_total(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k int")
    rows = percent_share(df, "k").collect()
    assert sum(r["count"] for r in rows) == len(values)
    assert abs(sum(r.share for r in rows) - 100.0) < 1e-9


@SETTINGS
@given(values=st.lists(st.one_of(st.none(), st.floats(min_value=-5, max_value=40, allow_nan=False)), min_size=1, max_size=40))
def test_bucketize_matches_python(spark, values):
    edges = [0, 5, 10, 15, 20]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.b for r in df.select(bucketize("x", edges).alias("b")).collect()]

    def py(v):
        if v is None or v < 0:
            return None
        if v >= 20:
            return ">=20"
        lo = [e for e in edges if e <= v][-1]
        return f"[{lo}-{lo + 5})"

    assert got == [py(v) for v in values]


@SETTINGS
@given(hours=st.lists(st.one_of(st.none(), st.integers(0, 23)), min_size=1, max_size=30))
def test_time_bin_matches_python(spark, hours):
    df = spark.createDataFrame([(h,) for h in hours], "h int")
    rows = df.select(time_bin("h").alias("l"), time_bin("h", closed="right").alias("r")).collect()
    for h, r in zip(hours, rows):
        if h is None:
            assert (r.l, r.r) == (None, None)
        else:
            assert r.l == h // 4 + 1
            assert r.r == (1 if h <= 4 else min(6, (h - 1) // 4 + 1) if h <= 20 else 6)


def _lenient_py(t):
    """The lenient contract: hh (0-23), mm (0-59), A/P; P and hh < 12 -> +12; A and hh == 12 -> 0."""
    if t is None:
        return None
    s = t.strip().upper()
    if len(s) != 5 or not s[:4].isdigit() or s[4] not in "AP":
        return None
    hh, mm = int(s[:2]), int(s[2:4])
    if hh > 23 or mm > 59:
        return None
    if s[4] == "P" and hh < 12:
        return hh + 12
    if s[4] == "A" and hh == 12:
        return 0
    return hh


@SETTINGS
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="0123456789AaPpM :", min_size=0, max_size=7)), min_size=1, max_size=40))
def test_lenient_clock_matches_contract(spark, texts):
    from citylens.functions import parse_clock

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.h for r in df.select(parse_clock("t", lenient=True).alias("h")).collect()]
    assert got == [_lenient_py(t) for t in texts]
