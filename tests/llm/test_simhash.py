import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citylens.llm import simhash as S
from tests.conftest import SF001
from tests.llm.helpers import empty_frame, frame, odd_frame, odd_rows, prose


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance=3):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def check(spark, rows, **options):
    got = S.near_duplicates(frame(spark, rows), **options).select("doc_id", "fingerprint", "component_id").collect()
    prints = [plain_print(r[1]) for r in rows]
    want = plain_components([r[0] for r in rows], prints)
    key = lambda r: tuple((x is None, x) for x in r)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert sorted(map(tuple, got), key=key) == sorted(zip([r[0] for r in rows], signed, want), key=key)


def test_rows_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    check(spark, rows)


def test_near_copies_and_chains(spark):
    draw = random.Random(3)
    rows = []
    for d in range(12):
        words = prose(d, 400).split()
        for c in range(6):
            for _ in range(c):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
            rows.append((d * 10 + c, " ".join(words)))
    check(spark, rows)
    check(spark, rows, group_rows=4)  # every group is cut into chunks: the same links


def test_odd_rows(spark):
    check(spark, odd_rows())
    clash = S.near_duplicates(odd_frame(spark))
    assert clash.count() == len(odd_rows())
    assert S.near_duplicates(empty_frame(spark)).count() == 0


def test_links_equal_brute_force_components(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(b) ^ sum(1 << int(k) for k in draw.choice(64, n, replace=False)) for b in base for n in range(5)]
    prints = sorted(set(p - (1 << 64) if p >> 63 else p for p in prints))
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    want = plain_components(prints, [p % (1 << 64) for p in prints])
    for group_rows in (4, 4096):
        roots = {r.node: r.root for r in S.components(S.links(df, group_rows=group_rows)).collect()}
        assert [roots.get(p, p) for p in prints] == want


def test_keep_first(spark):
    kept = S.keep_first(odd_frame(spark))
    assert kept.columns == odd_frame(spark).columns
    found = sorted((r.doc_id, r.text) for r in kept.filter("doc_id is not null").collect())
    # 1 and both 6 are equal; 2, 3, 4 and the NULL text have no words; 8 and 9 are equal
    assert [d for d, _ in found] == [1, 2, 5, 7, 8]
    assert kept.filter("doc_id is null").count() == 1
    assert S.keep_first(empty_frame(spark)).count() == 0


def test_distance_must_be_below_blocks():
    with pytest.raises(ValueError):
        S._masks(5, 5)


def test_query_hex(spark):
    out = S.op7_simhash(spark, SF001)
    assert out.filter(F.length("fingerprint") != 16).count() == 0
