import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citylens.llm import lm as L
from tests.conftest import SF001
from tests.llm.helpers import empty_frame, frame, odd_frame, odd_rows, prose

PIECES = [b" ", b"a", b"b", b"c", b" a", b"ab", b"bc", b"abc", b" ab", b"cab"]


def segmentations(text, logs):
    if not text:
        return [((), 0.0)]
    out = []
    for k, p in enumerate(PIECES):
        if text.startswith(p):
            out += [((k, *rest), logs[k] + q) for rest, q in segmentations(text[len(p) :], logs)]
    return out


def test_lattice_sums_all_segmentations():
    draw = random.Random(2)
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(len(PIECES))))
    lattice = L.Lattice(PIECES)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 9))).encode() for _ in range(60)]
    got = lattice.log_marginals(words, logs)
    counts = np.arange(1.0, len(words) + 1)
    uses = np.zeros(len(PIECES))
    for word, c, value in zip(words, counts, got):
        paths = segmentations(b" " + word, logs)
        total = math.log(sum(math.exp(p) for _, p in paths))
        assert value == pytest.approx(total)
        for path, p in paths:
            for k in path:
                uses[k] += c * math.exp(p - total)
    assert lattice.expected(words, lambda rows: counts[rows], logs) == pytest.approx(uses)


def test_long_word_and_vocabulary():
    pieces = L.vocabulary()
    assert all(bytes([b]) in set(pieces) for b in range(256) if bytes([b]).lower().strip() == bytes([b]))
    logs = np.full(len(pieces), -math.log(len(pieces)))
    value = L.Lattice(pieces).log_marginals([b"x" * 3000, b"y"], logs)
    assert np.isfinite(value).all()


def plain_base(rows, learn):
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    counts = Counter(w for (d, _), ws in zip(rows, tokens) if learn(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    score = lambda ws: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    return n, [(len(ws), sum(counts[w] > 0 for w in ws), score(ws)) for ws in tokens]


def check(got, rows, learn):
    n, want = plain_base(rows, learn)
    assert all(r.train_tokens == n for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[3], 6))
    left = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    right = sorted(((d, *w) for (d, _), w in zip(rows, want)), key=key)
    assert [r[:3] for r in left] == [r[:3] for r in right]
    assert [r[3] for r in left] == pytest.approx([r[3] for r in right])


def held(d, m):
    return zlib.crc32(("" if d is None else str(d)).encode()) % m == 0


@pytest.mark.parametrize("hot_share", [L.HOT_SHARE, 1])  # all words in the dictionary; none but the end
def test_base_scores(spark, hot_share):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows = rows[:60] + rows[:3]
    got = L.score_texts(frame(spark, rows), L.remainder("doc_id", 10) != 0, rounds=1, hot_share=hot_share).collect()
    check(got, rows, lambda d: not held(d, 10))


def test_both_paths_give_the_same_scores(spark):
    df = frame(spark, [(i, prose(i, 50, 300)) for i in range(60)])
    a = {r.doc_id: r.score for r in L.score_texts(df, L.remainder("doc_id", 10) != 0).collect()}
    b = {r.doc_id: r.score for r in L.score_texts(df, L.remainder("doc_id", 10) != 0, hot_share=1).collect()}
    assert a == pytest.approx(b)


def test_score_is_the_sum_over_words(spark):
    rows = [(i, prose(i, 30, 100)) for i in range(40)]
    df = frame(spark, rows)
    counts = L.word_counts(df, "text", F.lit(True))
    table = {bytes(r.word): r.c for r in counts.collect()}
    pieces = L.vocabulary()
    model = L.fit_model(counts, pieces, 2)
    assert table[b""] == 40
    # the pieces share all of their mass, and so do the end and the words
    assert np.exp(model.log_probs).sum() == pytest.approx(1.0)
    assert math.exp(model.log_end) + math.exp(model.log_word) == pytest.approx(1.0)
    lattice = L.Lattice(pieces)
    got = {r.doc_id: r.score for r in L.score_texts(df, F.lit(True), rounds=2).collect()}
    for d, text in rows:
        words = text.encode().split()
        logs = lattice.log_marginals(words, model.log_probs)
        assert got[d] == pytest.approx((logs.sum() + len(words) * model.log_word + model.log_end) / math.log(10))


def test_odd_rows(spark):
    got = L.score_texts(odd_frame(spark), L.remainder("doc_id", 10) != 0, rounds=1).collect()
    check(got, [r[:2] for r in odd_rows()], lambda d: not held(d, 10))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert L.score_texts(empty_frame(spark), F.lit(True)).count() == 0
    untrained = L.score_texts(frame(spark, [(1, "some text"), (2, None)]), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in untrained} == {(0, 0)}


def test_prose_scores_above_shuffled_letters(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").filter("lang='en'").collect()]
    draw = random.Random(1)
    noise = []
    for d, text in rows[:40]:
        words = text.split()
        noise.append((10_000 + d, " ".join("".join(draw.sample(w, len(w))) for w in words)))
    got = L.score_texts(frame(spark, rows + noise), F.col("doc_id") < 10_000, rounds=2)
    score = {r.doc_id: r.score for r in got.collect()}
    assert all(score[d] > score[10_000 + d] for d, text in rows[:40] if len(text) > 200)


def plain_marginal(word: bytes, probs: dict[bytes, float]) -> float:
    """The sum over all segmentations of a word with its leading space, by the plain forward recursion."""
    text = b" " + word
    alpha = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        alpha[j] = sum(alpha[i] * probs[text[i:j]] for i in range(j) if text[i:j] in probs)
    return alpha[-1]


def test_a_known_word_scores_its_marginal_over_segmentations(spark):
    """However often a word was seen, its probability is that of its segmentations into vocabulary pieces."""
    df = frame(spark, [(i, "same same same same rareword") for i in range(30)])
    counts = L.word_counts(df, "text", F.lit(True))
    pieces = L.vocabulary()
    model = L.fit_model(counts, pieces, 2)
    probs = dict(zip(pieces, np.exp(model.log_probs)))
    scored = {bytes(r.word): r.lm for r in L.word_scores(counts, pieces, model).collect()}
    for word in (b"same", b"rareword"):
        assert scored[word] == pytest.approx(math.log10(plain_marginal(word, probs) * math.exp(model.log_word)))
    assert scored[b""] == pytest.approx(model.log_end / math.log(10))
