import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from citylens.llm import bpe as B
from tests.conftest import SF001
from tests.llm.helpers import empty_frame, odd_frame, odd_rows


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(B.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary():
    return B.ByteBpe(B._read(B.RANKS), public_tokenizers.PATTERN)


def test_equals_the_library_on_random_text():
    own, want, draw = vocabulary(), library(), random.Random(4)
    for letters in ("ab", "etaoin shrdlu", "aA '.", "日本語é😀 a", ".-=_ \n\t", "x1 2"):
        for _ in range(400):
            text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 50)))
            assert own.encode(text) == want.encode_ordinary(text)


def test_long_pieces():
    own, want, draw = vocabulary(), library(), random.Random(5)
    for text in ("a" * 20_000, "-" * 9_000 + " " * 9_000, "".join(draw.choice("abcdefgh") for _ in range(20_000))):
        assert own.encode(text) == want.encode_ordinary(text)


def test_any_bytes():
    own, want, draw = vocabulary(), library(), random.Random(6)
    for _ in range(500):
        piece = bytes(draw.randrange(256) for _ in range(draw.randint(1, 24)))
        assert list(own.encode_piece(piece)) == want._encode_single_piece(piece)
        assert own.decode(own.encode_piece(piece)) == piece


def test_every_token_encodes_to_itself_from_its_parts():
    own = vocabulary()
    for i in range(0, len(own.tokens), 37):
        parts = own.parts(i)
        assert parts is None or own.tokens[parts[0]] + own.tokens[parts[1]] == own.tokens[i]


def test_query_digests(spark):
    want = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = B.op3_byte_bpe(spark, SF001).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = want.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    own, df = vocabulary(), odd_frame(spark)
    out = B.decode_ids(B.encode_texts(df))
    assert sorted(out.columns) == sorted(df.columns)
    got = sorted(((r.doc_id or 0), list(r.ids), bytes(r.decoded)) for r in out.collect())
    assert got == sorted(((d or 0), own.encode(t or ""), (t or "").encode()) for d, t, *_ in odd_rows())
    assert B.decode_ids(df.withColumn("ids", F.lit(None).cast("array<int>"))).filter("length(decoded) > 0").count() == 0
    assert B.digest(empty_frame(spark)).count() == 0
