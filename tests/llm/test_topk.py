import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citylens.llm import topk as K


def plain(rows, k=5, every=50):
    usable = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, qv in usable:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in usable if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int")
    return sorted(map(tuple, K.exact_top_k(df, F.col("vec_id") % 50 == 0, **options).collect()))


def vectors(n, dim, seed=1):
    import random

    draw = random.Random(seed)
    # few distinct values: many ties and zeros
    return [(i, [draw.choice([-0.5, 0.0, 0.0, 0.25, 0.5]) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"query_block": 2, "candidate_block": 60}])
def test_against_brute_force(spark, blocks):
    rows = vectors(400, 6)
    assert run(spark, [(*r, "x", 0) for r in rows], **blocks) == plain(rows)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
        (50, [0.1, -0.2]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 0.5, 9.0]), (9, [-1e30, 0.0]),
    ]
    # four candidates of a query score better than the huge one
    assert run(spark, [(*r, "x", 0) for r in rows], k=3) == plain(rows, k=3)


def test_fewer_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0], "x", 0), (1, [2.0], "x", 0)]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(1, [2.0], "x", 0)]) == []
    assert run(spark, []) == []


def test_large_components_and_repeated_ids(spark):
    rows = [(0, [2.0, 1.0]), (1, [4e9, 1.0]), (2, [-4e6, 0.5]), (3, [1.0, 1.0])]
    assert run(spark, [(*r, "x", 0) for r in rows]) == plain(rows)
    twice = [(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, [3.0])]
    got = run(spark, [(*r, "x", 0) for r in twice], k=2)
    assert sorted(s for _, _, _, s in got) == sorted(x * 65536 for x in (2, 3, 2, 6))
    with pytest.raises(Exception, match="does not fit"):
        run(spark, [(0, [1e12], "x", 0), (1, [1e12], "x", 0)])


def test_only_returned_scores_have_to_fit(spark):
    # the query's product with itself does not fit; its candidates' scores do
    rows = [(0, [1.0, 2.0]), (1, [2.0, -1.0]), (100, [1e9, 1e9])]
    assert run(spark, [(*r, "x", 0) for r in rows]) == plain(rows)
    # large products that cancel, and a candidate far below the others
    rows = [(0, [1e9, 1.0, 1e9]), (1, [1e9, 3.0, -1e9]), (2, [1.0, 1.0, 1.0]), (3, [-1e30, 0.0, 0.0]), (4, [0.5, 0.0, 0.0])]
    assert run(spark, [(*r, "x", 0) for r in rows], k=3) == plain(rows, k=3)
    with pytest.raises(Exception, match="does not fit"):
        run(spark, [(*r, "x", 0) for r in rows], k=4)


def test_components_of_any_size():
    rows = K._Rows([np.array([1e300, -1e306, 0.3, -0.3]).tobytes()], 256)
    assert rows.exact(0) == [int(1e300) * 256, int(-1e306) * 256, 76, -77]
    assert rows.weights.tolist() == [[0, 0, 76, -77]]
