import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citylens.llm import quality as Q
from tests.conftest import SF01
from tests.llm.helpers import empty_frame, frame, odd_frame, odd_rows, prose


def test_tokens_are_cut_once_and_in_order():
    tokens = Q.Tokens(1 << 10)
    flat, owner = tokens.read([b"ab,  cd ab,", b"", b"x1!!"])
    number = lambda w: Q.xxhash.xxh32_intdigest(w) % (1 << 10)
    assert flat.tolist() == [number(w) for w in (b"ab", b",", b"cd", b"ab", b",", b"x", b"1", b"!!")]
    assert owner.tolist() == [0] * 5 + [2] * 3


def test_context_sums_by_brute_force():
    draw = np.random.default_rng(1)
    tokens, owner = draw.integers(0, 20, 200).astype(np.int32), np.sort(draw.integers(0, 5, 200))
    places, signs = Q.index_vectors(20, 8)
    index = np.zeros((20, 8))
    for b in range(20):
        for p, s in zip(places[b], signs[b]):
            index[b, p] += s
    want = np.zeros((20, 8))
    for i in range(200):
        for j in range(200):
            if i != j and abs(i - j) <= 2 and owner[i] == owner[j]:
                want[tokens[i]] += index[tokens[j]]
    assert np.array_equal(Q.context_sums(tokens, owner, places, signs, 8), want)


def test_word_vectors_do_not_depend_on_partitions(spark):
    texts = [prose(i, 60, 200) for i in range(40)]
    df = frame(spark, list(enumerate(texts)))
    a, b = Q.word_vectors(df, "text", 256, 8), Q.word_vectors(df.repartition(7), "text", 256, 8)
    tokens, (places, signs) = Q.Tokens(256), Q.index_vectors(256, 8)
    flat, owner = tokens.read([t.encode() for t in texts])
    assert np.array_equal(a[0], Q.context_sums(flat, owner, places, signs, 8))
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_network_learns_and_temperature_calibrates():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 6))
    p = 1 / (1 + np.exp(-2 * np.where(x[:, 0] * x[:, 1] > 0, 1, -1)))  # not linear
    y = (draw.random(3000) < p).astype(float)
    aside = np.arange(3000) % 5 == 0
    net = Q.fit_network(x, y, aside, epochs=80)
    got = net.probability(x[aside])
    assert ((got > 0.5) == (p[aside] > 0.5)).mean() > 0.9
    loss = lambda t: np.logaddexp(0, -(2 * y[aside] - 1) * net.logits(x[aside]) / t).mean()
    assert loss(net.temperature) <= min(loss(1.0), loss(net.temperature * 1.2), loss(net.temperature / 1.2)) + 1e-9


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in Q.op1_quality(spark, SF01).collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_labels_are_not_read(spark):
    draw = random.Random(3)
    rows = [(i, prose(i, 30) + (" @@ !!" * 10 if i % 3 == 0 else "")) for i in range(300)]
    df = frame(spark, rows)
    labels = [(i, int(i % 3 != 0)) for i, _ in rows]
    other = [(i, q if zlib.crc32(str(i).encode()) % 5 else draw.randint(0, 1)) for i, q in labels]
    scores = []
    for table in (labels, other):
        model = Q.fit_quality(df, spark.createDataFrame(table, "doc_id long, quality int"), ~Q.is_held_out())
        scores.append(sorted((r.doc_id, r.score) for r in Q.score_quality(df, model).select("doc_id", "score").collect()))
    assert scores[0] == scores[1]


def test_odd_rows(spark):
    df = odd_frame(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 0), (5, 1), (6, None), (None, 1)], "doc_id long, quality int")
    model = Q.fit_quality(df, labels, ~Q.is_held_out())
    out = Q.score_quality(df, model)
    assert out.columns == [c for c in df.columns if c != "score"] + ["score"]
    assert out.count() == len(odd_rows())
    assert out.filter(F.col("score").isNull() | ~F.col("score").between(0, 1)).count() == 0
    assert Q.keep_good(df, labels).columns == df.columns


@pytest.mark.parametrize("with_documents", [True, False])
def test_nothing_to_learn_from(spark, with_documents):
    df = odd_frame(spark) if with_documents else empty_frame(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    scores = [r.score for r in Q.score_quality(df, Q.fit_quality(df, labels, ~Q.is_held_out())).collect()]
    assert scores == [0.5] * (len(odd_rows()) if with_documents else 0)


def test_sample_is_bounded(spark):
    rows = [(i % 50, prose(i, 10)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    model = Q.fit_quality(frame(spark, rows), labels, F.lit(True), max_labelled=20)
    assert model.network.mean.shape == (Q.DIMENSIONS + 2,)
