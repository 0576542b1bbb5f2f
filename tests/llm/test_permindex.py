import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citylens.llm import permindex as P
from tests.conftest import SF01, SF001

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, n string, bytes string"


def usable(rows):
    return [
        (i, np.array(v, dtype=np.float32).astype(np.float64))
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]


def plain(rows, k, every=20):
    """Per query row: ``(query, [(score, vec_id), ...])`` over every other row."""
    rows = usable(rows)
    width = max((len(v) for _, v in rows), default=1)
    ids = np.array([i for i, _ in rows])
    x = np.zeros((len(rows), width))
    for j, (_, v) in enumerate(rows):
        x[j, : len(v)] = v
    out = []
    for j in np.flatnonzero(ids % every == 0):
        scores = (x * x[j]).sum(axis=1)
        others = [o for o in np.lexsort((ids, -scores)) if o != j][:k]
        out.append((int(ids[j]), [(float(scores[o]), int(ids[o])) for o in others]))
    return out


def run(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame([(i, v, "x", 0, "n", "b") for i, v in rows], schema)
    return P.nearest(df, F.col("vec_id") % 20 == 0, **options).collect()


def lists(found):
    """The lists of all query rows: rows of one id have as many entries of each rank."""
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)


def flat(wanted):
    return sorted((q, rank, i, s) for q, entries in wanted for rank, (s, i) in enumerate(entries, 1))


def vectors(n, dim, seed=1, spread=1.0):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in draw.normal(size=dim) * np.exp(spread * draw.normal())]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"cell_vectors": 40, "cell_queries": 3}])
def test_fitted_on_every_query_it_is_exact(spark, options):
    # vectors of very different length: the inner product is not the angle
    rows = vectors(900, 8)
    assert lists(run(spark, rows, k=7, recall=1.0, **options)) == flat(plain(rows, 7))


def test_copies_and_repeated_ids(spark):
    base = vectors(300, 6, seed=2)
    hot = base[5][1]
    # one vector holds a third of the rows; ids that occur twice, with equal and with other vectors
    rows = base + [(1000 + i, hot) for i in range(200)] + [(0, hot), (0, hot), (40, base[3][1]), (40, base[40][1])]
    got = run(spark, rows, k=20, recall=1.0, cell_vectors=64)
    assert lists(got) == flat(plain(rows, 20))


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, -0.0]),
        (20, [0.1, -0.2]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 0.5, 9.0]), (9, [1e30, 0.0]), (10, [-0.0, 2.0]), (11, [0.0, 2.0]),
    ]
    assert lists(run(spark, rows, k=20)) == flat(plain(rows, 20))
    assert lists(run(spark, rows, k=2)) == flat(plain(rows, 2))


def test_few_rows_and_no_rows(spark):
    assert lists(run(spark, [(0, [3.0])])) == []
    assert lists(run(spark, [(0, [3.0]), (1, [2.0])])) == [(0, 1, 1, 6.0)]
    assert run(spark, [(1, [3.0]), (2, [2.0])]) == []
    empty = run(spark, [])
    assert empty == []
    doubles = SCHEMA.replace("float", "double")
    assert lists(run(spark, [(0, [1e-9, 1.0]), (3, [1e9, 1e-9])], doubles)) == [(0, 1, 3, 1.000000001)]


def test_queries_that_find_too_few_open_every_file(spark, monkeypatch):
    rows = vectors(400, 5, seed=3, spread=0.0)
    fitted = P.fit

    def narrow(*args):
        index = fitted(*args)
        index.visits, index.agreement = 1, 10**6
        return index

    monkeypatch.setattr(P, "fit", narrow)
    got = run(spark, rows, k=300, cell_vectors=50)
    assert lists(got) == flat(plain(rows, 300))
    assert {r.query_id for r in run(spark, rows, k=3)} == {i for i, _ in rows if i % 20 == 0}


def test_agreement_is_the_complement_of_the_footrule():
    draw = random.Random(5)
    pivots, places = 12, 5
    orders = np.array([draw.sample(range(pivots), pivots) for _ in range(40)])
    for q, agreed in zip(orders, P.agreements(orders, orders, places)):
        for o, a in zip(orders, agreed):
            at = lambda order, p: min(order.tolist().index(p), places)
            footrule = sum(abs(at(q, p) - at(o, p)) for p in range(pivots))
            assert footrule == places * (places + 1) - 2 * a


def test_cosines_of_lifted_vectors_order_as_inner_products():
    x = np.random.default_rng(1).normal(size=(50, 4)) * 10.0 ** np.random.default_rng(2).integers(-3, 4, (50, 1))
    index = P.Index("<f8", 4, float(np.linalg.norm(x, axis=1).max()), np.zeros((1, 5)), 1)
    assert np.allclose(np.linalg.norm(index.lifted(x, query=False), axis=1), 1.0)
    assert np.allclose(index.lifted(x, query=False) @ index.lifted(x, query=True).T * index.largest, x @ (x / np.linalg.norm(x, axis=1)[:, None]).T)


@pytest.mark.parametrize("sf", [SF001, SF01, "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    wanted = plain(rows, 20)
    got = P.op13_permutation_index(spark, sf).collect()
    found = {(r.query_id, r.vec_id): r for r in got}
    assert len(got) == len(found) == 20 * len(wanted)
    hits = sum((q, i) in found for q, entries in wanted for _, i in entries)
    assert hits / (20 * len(wanted)) >= 0.93
    vector = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, _ in wanted:
        entries = sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [e[0] for e in entries] == list(range(1, 21)) and entries == sorted(entries, key=lambda e: e[1:])
        assert all(abs(-s - vector[q] @ vector[i]) < 1e-12 for _, s, i in entries)
