import random
from collections import defaultdict

import pytest

from citylens.llm import mixture as M
from tests.conftest import SF01
from tests.llm.helpers import empty_frame, frame, odd_frame, odd_rows, prose


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; whoever is above ``most`` times its size stops there and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else weight[s] * left / share for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    draw = random.Random(seed)
    names = ["b", "a", None, "é", "Z", "zz", "", "k"]
    sizes = {s: draw.choice([0, 1, 3, 10, 1000, 5000]) + 1 for s in names}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def mixed(df, **options):
    return M.mix_sources(df, **options).collect()


def balance(rows, source_of):
    taken, target, counts = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = source_of[r.doc_id]
        taken[s] += r.size * r.copies
        counts[s] += r.copies
        target[s] = r.target
    return taken, target, counts


def test_words_and_documents_are_balanced(spark):
    draw = random.Random(8)
    rows = [(i, prose(i, draw.randint(5, 60)), f"s{i % 4 if i % 3 else 0}") for i in range(3000)]
    source_of = {i: s for i, _, s in rows}
    for block_rows in (4096, 64):  # one level and several levels of blocks
        out = mixed(frame(spark, rows), block_rows=block_rows)
        assert len(out) == len(rows)
        taken, target, counts = balance(out, source_of)
        size = {r.doc_id: r.source_size for r in out}
        for s, words in taken.items():
            one = next(size[i] for i, t in source_of.items() if t == s)
            planned = sum(1 for t in source_of.values() if t == s) * target[s] / one
            assert abs(words - target[s]) <= 120
            assert abs(counts[s] - planned) <= 3
        assert all(0 <= r.copies <= 3 for r in out)


def test_reruns_and_partitions_agree(spark):
    rows = [(i, prose(i, 5 + i % 50), f"s{i % 3}") for i in range(700)]
    df = frame(spark, rows)
    once = sorted(map(tuple, mixed(df, block_rows=50)))
    assert once == sorted(map(tuple, mixed(df.repartition(13), block_rows=50)))


def test_odd_rows(spark):
    out = mixed(odd_frame(spark))
    assert len(out) == len(odd_rows())
    assert all(r.copies is not None and 0 <= r.copies <= 3 for r in out)
    assert mixed(empty_frame(spark)) == []
    nothing = mixed(frame(spark, [(1, None), (2, "")]))
    assert [(r.size, r.target, r.copies) for r in nothing] == [(0, 0.0, 0)] * 2


def test_copies_follow_the_draw(spark):
    df = frame(spark, [(i, prose(i, 20), f"s{i % 2}") for i in range(200)])
    copies = {r.doc_id: r.copies for r in mixed(df) if r.copies}
    for keep in (True, False):
        assert {r.doc_id: r.copies for r in mixed(df, carry=df.columns, keep_sizes=keep) if r.copies} == copies
    taken = M.take_copies(df)
    assert taken.columns == df.columns
    assert {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()} == copies
    odd = odd_frame(spark)
    assert M.take_copies(odd).columns == odd.columns
    assert M.take_copies(empty_frame(spark)).count() == 0


def test_query(spark):
    out = M.op8_cube_mixture(spark, SF01).collect()
    documents = {r.doc_id: r.source for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    words, target = defaultdict(int), {}
    for r in out:
        words[documents[r.doc_id]] += r.taken
        target[documents[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(words[s] - target[s]) <= 0.02 * target[s] for s in target)


def flown(sizes, chance, seed):
    flight, taken = M._Flight(seed), []
    for i, n in enumerate(sizes):
        taken += flight.add(i, float(n), chance)
    taken += flight.land()
    assert sorted(i for i, _ in taken) == list(range(len(sizes)))
    return dict(taken)


def test_a_large_document_is_made_up_for():
    draw = random.Random(3)
    for share in (0.05, 0.2, 0.3):
        sizes = [draw.randint(20, 600) for _ in range(400)]
        sizes = sorted([*sizes, int(sum(sizes) * share / (1 - share))], reverse=True)
        for seed in range(6):
            taken = flown(sizes, 0.35, seed)
            assert abs(sum(n * taken[i] for i, n in enumerate(sizes)) - 0.35 * sum(sizes)) <= 0.005 * sum(sizes)


def test_chances_are_kept():
    sizes = [400, 380, 350, 300, 300, 280, 250, 250, 120, 60, 60, 30, 8, 0, 0]
    n = 2000
    taken = [0] * len(sizes)
    for seed in range(n):
        for i, extra in flown(sizes, 0.5, seed).items():
            taken[i] += extra
    assert all(abs(t / n - 0.5) < 0.05 for t in taken)


def test_equal_empty_and_single_documents():
    for sizes in ([], [7], [0], [0, 0, 0], [5] * 40, [9, 5, 5, 5, 5], [9, 0, 0, 0]):
        for seed in range(5):
            taken = flown(sizes, 0.5, seed)
            planned = sum(sizes) / 2
            assert abs(sum(n * taken[i] for i, n in enumerate(sizes)) - planned) <= max(sizes, default=0)
    assert sum(flown([5] * 40, 0.5, 1).values()) == 20
    assert flown([4, 3], 0.0, 1) == {0: 0, 1: 0} and flown([4, 3], 1.0, 1) == {0: 1, 1: 1}
