import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citylens.llm import idfile as I
from tests.conftest import SF001
from tests.llm.helpers import empty_frame, frame, odd_frame, odd_rows, prose


def huffman_size(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    size = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        size += both
        heapq.heappush(heap, both)
    return size


@pytest.mark.parametrize("seed", range(5))
def test_lengths_are_optimal_and_limited(seed):
    draw = np.random.default_rng(seed)
    counts = (draw.pareto(0.7, 500) * 10).astype(np.int64)
    free = I.code_lengths(counts, 40)
    assert (counts * free).sum() == huffman_size(counts)
    limited = I.code_lengths(counts, 10)
    assert limited.max() <= 10 and ((limited > 0) == (counts > 0)).all()
    assert (0.5 ** limited[limited > 0]).sum() <= 1
    assert (counts * limited).sum() >= (counts * free).sum()


def best_limited(counts, limit):
    """Least size over all length vectors that satisfy Kraft's inequality (tiny alphabets)."""
    from itertools import product

    sizes = [
        sum(c * n for c, n in zip(counts, lengths))
        for lengths in product(range(1, limit + 1), repeat=len(counts))
        if sum(2 ** (limit - n) for n in lengths) <= 2**limit
    ]
    return min(sizes)


def test_package_merge_against_all_codes():
    for counts in ([1, 1, 2, 3, 5, 8], [1, 1, 1, 1, 100], [7], [3, 0, 9]):
        used = [c for c in counts if c]
        lengths = I.code_lengths(np.array(counts), 3)
        got = sum(c * n for c, n in zip(counts, lengths))
        assert got == (best_limited(used, 3) if len(used) > 1 else used[0])


def test_limit_is_raised_where_it_cannot_hold_the_symbols():
    assert I.code_lengths(np.ones(1000, dtype=np.int64), 4).max() == 10


@pytest.mark.parametrize("sizes", [[1], [2, 1, 1], [127, 128, 129], [5000], [300] * 40, [1] * 50])
def test_block_round_trip(sizes):
    sizes, draw = np.array(sizes), np.random.default_rng(len(sizes))
    ids = np.minimum(draw.geometric(0.02, sizes.sum()), 900)
    counts = np.bincount(np.append(ids, np.arange(901)), minlength=901)
    lengths = I.code_lengths(counts, 18)
    code = I.Code(np.flatnonzero(lengths), lengths[lengths > 0])
    payloads, checkpoints = code.encode(ids, sizes)
    ends = np.cumsum(sizes)
    assert [len(p) for p in payloads] == [(int(lengths[ids[a:e]].sum()) + 7) // 8 for a, e in zip(ends - sizes, ends)]
    assert np.array_equal(code.decode(b"".join(payloads), b"".join(checkpoints), sizes), ids)
    # bit by bit, with nothing but the canonical codes
    table = {f"{int(code.code[s]):0{int(code.length[s])}b}": s for s in code.symbols.tolist()}
    for payload, a, e in zip(payloads, ends - sizes, ends):
        bits, out, at = "".join(f"{b:08b}" for b in payload), [], 0
        while len(out) < min(e - a, 200):
            end = at + 1
            while bits[at:end] not in table:
                end += 1
            out.append(table[bits[at:end]])
            at = end
        assert out == ids[a : a + len(out)].tolist()


def library_ids(text):
    if not hasattr(library_ids, "t"):
        library_ids.t = Tokenizer.from_file(I.TOKENIZER)
        library_ids.t.encode_special_tokens = True
    return library_ids.t.encode(text or "", add_special_tokens=False).ids + [2]


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = {}, 0
    for d, text in ordered:
        ids = library_ids(text)
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        out.setdefault(d, []).append((start, len(ids), crc))
        start += len(ids)
    return out, start


def read(spark, df, path, **options):
    back = I.read_ids(spark, I.write_ids(df, str(path), **options))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()


def test_words_equal_the_library():
    words = I.LibraryWords(open(I.TOKENIZER, encoding="utf-8").read())
    texts = ["It's a test, isn't it? x2 <|endoftext|> I.", "ÀÉî, ǅ İstanbul naïve ΑΣ ΣΑΣ. ﬁn", "日本 ﷺ áb ́ e f g", ""]
    for text in texts:
        flat = [i for ids in words.values_of(text.encode().split()) for i in ids] if text else []
        assert flat + [2] == library_ids(text)


def test_words_are_learnt_packed():
    words = I.LibraryWords(open(I.TOKENIZER, encoding="utf-8").read())
    table = I.WordTable(words.packed_of, 3)  # forgets words between the calls
    for text in ["Is it it's 4.5 x2, isn't it? foo-bar", "it is. 日本 Naïve \u00a0, --", "", "It IS. 4.5"]:
        flat, owner = table.read([text.encode(), b"", text.encode()])
        one = library_ids(text)[:-1]
        assert flat.tolist() == one * 2 and owner.tolist() == [0] * len(one) + [2] * len(one)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want, _ = expected(rows)
    got = I.op4_id_files(spark, SF001).collect()
    assert {r.doc_id: [(r.start, r.n_tokens, r.ids_crc32)] for r in got} == want


def test_small_ranges_and_blocks(spark, tmp_path):
    draw = random.Random(1)
    rows = [(i * 7 % 1009, prose(i, draw.randint(0, 60))) for i in range(300)]
    want, _ = expected(rows)
    got = read(spark, frame(spark, rows), tmp_path / "f", per_bucket=20, block_ids=64)
    assert {r.doc_id: [(r.start, r.n_tokens, r.crc)] for r in got} == want


def test_odd_rows(spark, tmp_path):
    rows = [r[:2] for r in odd_rows()]
    want, total = expected(rows)
    got = read(spark, odd_frame(spark), tmp_path / "f")
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.crc))
    assert {d: sorted(v) for d, v in found.items()} == {d: sorted(x[1:] for x in v) for d, v in want.items()}
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
    assert sum(n for _, n in spans) == total
    assert read(spark, empty_frame(spark), tmp_path / "e") == []


def test_one_id_that_fills_several_ranges(spark, tmp_path):
    rows = [(5, prose(i, 10)) for i in range(80)] + [(i, prose(1000 + i, 10)) for i in range(10)]
    got = read(spark, frame(spark, rows), tmp_path / "f", per_bucket=8)
    spans = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert [s[0] for s in spans] == [sum(n for _, n, _ in spans[:i]) for i in range(len(spans))]
    assert [s[2] for s in spans] == sorted(d for d, _ in rows)
