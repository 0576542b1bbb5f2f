import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citylens.llm import spelling as S
from tests.conftest import SF001
from tests.llm.helpers import empty_frame, frame, odd_frame


def within_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[first + 1 :] == b[first + 1 :] if len(a) == len(b) else a[first:] == b[first + 1 :]


def plain(words: dict[str, int], ratio=10):
    near = {w: [v for v in words if within_one(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, words: dict[str, int], **options):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(map(tuple, S.variant_groups(df, **options).collect()))


def test_against_brute_force(spark):
    draw = random.Random(3)
    # few letters, runs of equal letters, and letters beyond ASCII: many pairs that meet in several groups
    words = {"".join(draw.choice("aabé") for _ in range(draw.randint(1, 6))): 10 ** draw.randint(0, 5) for _ in range(700)}
    assert run(spark, words) == plain(words)
    assert run(spark, words, ratio=3) == plain(words, 3)


def test_long_words(spark):
    draw = random.Random(4)
    words = {}
    for length in (S.LONG - 1, S.LONG, S.LONG + 1, S.LONG + 2, 400):
        base = "".join(draw.choice("ab") for _ in range(length))
        words[base] = 1000
        for _ in range(6):
            i = draw.randrange(length)
            words[base[:i] + draw.choice("abc") + base[i + 1 :]] = draw.randint(1, 200)
            words[base[:i] + base[i + 1 :]] = draw.randint(1, 200)
            words[base[:i] + draw.choice("abc") + base[i:]] = draw.randint(1, 200)
    assert run(spark, words) == plain(words)
    giant = "ab" * 50_000
    got = run(spark, {giant: 50, giant[:-1]: 2, giant[1:]: 2, "ba" * 50_000: 3})
    assert {(r[0] == giant, r[4]) for r in got} >= {(True, 2)} and sum(r[1] == giant for r in got) == 2


@settings(max_examples=60, deadline=None)
@given(st.text("abé", min_size=1, max_size=5), st.text("abé", min_size=1, max_size=5))
def test_keys_pair_exactly_the_near_words(a, b):
    """Two words share a key once (counted once) if and only if they are near."""
    if a == b:
        return
    left, right = ({k: (whole, joins) for k, whole, joins in S.rotation_keys(w)} for w in (a, b))
    counted = 0
    for key in left.keys() & right.keys():
        (whole_a, joins_a), (whole_b, joins_b) = left[key], right[key]
        if whole_a and whole_b:
            assert a == b
        elif whole_a or whole_b:
            counted += joins_b if whole_a else joins_a
        else:
            counted += 1
    assert counted == (1 if within_one(a, b) else 0)


def plain_words(rows, least, slip):
    import re

    out = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slip and h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                out[word] += 1
    return dict(out)


@pytest.mark.parametrize("held", [3, 200_000])
def test_words(spark, monkeypatch, held):
    monkeypatch.setattr(S, "WORDS_HELD", held)
    draw = random.Random(6)
    rows = [(i % 40, " ".join("".join(draw.choice("abÉé") for _ in range(draw.randint(2, 6))) for _ in range(30))) for i in range(60)]
    rows += [(None, "Straße naïve ÀÉ×÷ÿ"), (1, None), (2, ""), (3, "x1abc_def")]
    for slip in (None, 5):
        got = {r.word: r.n for r in S.corpus_words(frame(spark, rows), least_length=3, slip=slip).collect()}
        assert got == plain_words(rows, 3, slip)


def test_pieces_cut_no_word():
    text = " ".join("a" * (i % 50) for i in range(2000)) + "é" * 3000
    parts = list(S.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 100
    count = lambda t: Counter(t.split())
    assert sum(map(count, parts), Counter()) == count(text)


def test_odd_rows(spark):
    out = S.variant_groups(S.corpus_words(odd_frame(spark), slip=31).filter("n >= 2")).collect()
    assert all(r.root and r.n >= 2 for r in out) and "y" * 5000 not in {r.word for r in out}
    assert S.variant_groups(S.corpus_words(empty_frame(spark))).collect() == []
    with pytest.raises(ValueError):
        S.variant_groups(S.corpus_words(empty_frame(spark)), ratio=1)


def test_chains_lead_to_the_last(spark):
    words = {"a" * (9 + i): 10**i for i in range(7)}
    got = {r[0]: r for r in run(spark, words)}
    assert {r[2] for r in got.values()} == {"a" * 15}
    assert got["a" * 9][1] == "a" * 10


def test_query(spark):
    got = S.op11_spelling(spark, SF001).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    words = {w: n for w, n in plain_words(rows, 7, 31).items() if n >= 2}
    assert {r.word: r.n for r in got} == words
    buckets = defaultdict(list)
    for w in words:
        buckets[len(w)].append(w)
    for r in random.Random(1).sample(got, 150):
        near = [v for k in (-1, 0, 1) for v in buckets[len(r.word) + k] if within_one(r.word, v)]
        assert r.n_near == len(near)
