"""Byte-level BPE by backtracking over longest matches, and decoding.

The bytes of a piece are mapped to Latin-1 so that an Aho-Corasick
automaton finds every vocabulary token at every position.  Encoding walks
from left to right taking the longest token that is compatible with the one
before it (the merges of their joined bytes would keep them apart), and
steps back where no token fits; positions found to be dead ends are not
entered again, so the walk is linear.  Compatibility of two tokens is
memoised.  The result equals applying the merges in rank order.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.llm._tables import bytes_of, documents, fresh, slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Positions of a piece whose matches are held at once; pieces of a generation of the memo, pairs memoised per worker.
WINDOW = 4096
GENERATION = 150_000
MEMO = 250_000


class _Pieces(dict):
    """Memo of encoded pieces; long ones are encoded anew each time.

    A full memo becomes the generation before; pieces that are met again are taken over from it, so those in use stay
    and those met once are forgotten.
    """

    def __init__(self, bpe: "ByteBpe") -> None:
        super().__init__()
        self.bpe, self.before = bpe, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.bpe.encode_piece(piece.encode())
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > GENERATION:
            self.before = dict(self)
            self.clear()


class ByteBpe:
    """The vocabulary of a rank file (lines of base64 token and rank)."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.ids = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        # per token: its length, and its longest proper prefix that is a token (-1: none)
        slots = max(self.tokens) + 1
        self.size, self.shorter = [0] * slots, [-1] * slots
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, i))
            self.size[i] = len(token)
            self.shorter[i] = next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1)
        self.automaton.make_automaton()
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, bytes, float]]] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._pieces = _Pieces(self)

    # -- compatibility ------------------------------------------------------------

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self._parts:
            symbols = [self.ids[bytes([b])] for b in self.tokens[token]]
            while len(symbols) > 2:
                merges = [
                    (rank, i)
                    for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
                    if (rank := self.ids.get(self.tokens[a] + self.tokens[b], token)) < token
                ]
                if not merges:
                    break
                rank, i = min(merges)
                symbols[i : i + 2] = [rank]
            self._parts[token] = (symbols[0], symbols[1]) if len(symbols) == 2 else None
        return self._parts[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, bytes, float]]:
        """The tokens along one edge of the merge tree with their bytes and the rank of the merge that consumes each."""
        start = (token, side)
        edge = self._edges.get(start)
        if edge is None:
            edge, consumer = self._edges.setdefault(start, []), float("inf")
            while True:
                edge.append((token, self.tokens[token], consumer))
                parts = self.parts(token)
                if parts is None:
                    break
                consumer, token = token, parts[side]
        return edge

    def keeps_apart(self, left: int, right: int) -> bool:
        """Whether the merges of ``left + right`` give back exactly these two tokens.

        A merge across the border happens if its rank comes before the merges
        that consume its two sides; of equal ranks the leftmost goes first.
        """
        pair = (left, right)
        known = self._apart.get(pair)
        if known is None:
            known = True
            for x, bytes_x, consumer_x in self._edge(left, 1):
                for y, bytes_y, consumer_y in self._edge(right, 0):
                    merged = self.ids.get(bytes_x + bytes_y)
                    if merged is not None and self.parts(merged) == (x, y) and merged < consumer_x and merged <= consumer_y:
                        known = False
            if len(self._apart) >= MEMO:
                self._apart.clear()
            self._apart[pair] = known
        return known

    # -- encoding -----------------------------------------------------------------

    def _longest(self, text: str) -> list[int]:
        """Per position the longest token that starts there."""
        found = [-1] * len(text)
        # matches come by their end, so of one start the longest comes last
        for end, (before, i) in self.automaton.iter(text):
            found[end - before] = i
        return found

    def _windowed(self, text: str) -> Callable[[int], int]:
        """``_longest`` by position for a long piece, a few windows held at a time."""
        windows: dict[int, list[int]] = {}

        def at(position: int) -> int:
            number, offset = divmod(position, WINDOW)
            if number not in windows:
                if len(windows) > 2:
                    windows.clear()
                start = number * WINDOW
                windows[number] = self._longest(text[start : start + WINDOW + self.longest])[:WINDOW]
            return windows[number][offset]

        return at

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one match of the pattern."""
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        text, n = piece.decode("latin-1"), len(piece)
        at = self._longest(text).__getitem__ if n <= WINDOW else self._windowed(text)
        size, shorter, apart = self.size, self.shorter, self._apart
        ids: list[int] = []
        dead: set[int] = set()
        position, token = 0, at(0)
        while True:
            last = ids[-1] if ids else None
            # from the longest token on, each next one is the longest token that is its prefix
            while token >= 0:
                if position + size[token] not in dead and (
                    last is None or (apart[last, token] if (last, token) in apart else self.keeps_apart(last, token))
                ):
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                position += size[token]
                if position == n:
                    return tuple(ids)
                token = at(position)
            else:
                dead.add(position)
                token = ids.pop()
                position -= size[token]
                token = shorter[token]

    def encode(self, text: str) -> list[int]:
        self._pieces.age()
        return list(chain.from_iterable(map(self._pieces.__getitem__, self.pattern.findall(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _vocabulary(ranks: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _shared(df: DataFrame, ranks_file: str) -> Broadcast:
    """The rank file's bytes (under 1 MB), read on the driver and sent to the workers once."""
    return df.sparkSession.sparkContext.broadcast(_read(ranks_file))


def encode_texts(
    df: DataFrame, text_col: str = "text", ids_col: str = "ids", ranks_file: str = RANKS,
    pattern: str = public_tokenizers.PATTERN, keep: Sequence[str] | None = None, bytes_col: str | None = None,
) -> DataFrame:
    """The ``keep`` columns (all) plus ``ids_col``: the token ids of each whole text (NULL or empty: no ids).

    With ``bytes_col`` the bytes decoded from the ids come along, from the
    same worker (a vocabulary in memory once instead of twice per task).
    Columns named like the new ones are replaced.  No special tokens.
    """
    ranks = _shared(df, ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(ranks.value, pattern)
        for batch in slices(batches, 256):
            sizes, flat, back = [0], [], []
            for text in batch.column(batch.num_columns - 1):
                found = bpe.encode(text.as_py().decode("utf-8", "replace"))
                flat.append(np.array(found, dtype=np.int32))
                sizes.append(len(found))
                if bytes_col is not None:
                    back.append(bpe.decode(found))
            offsets = pa.array(np.cumsum(sizes), pa.int32())
            made = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat)))]
            if bytes_col is not None:
                made.append(pa.array(back, pa.binary()))
            old = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*old, *made], names=schema.names)

    kept = [c for c in (df.columns if keep is None else keep) if c not in (ids_col, bytes_col)]
    schema = T.StructType([df.schema[c] for c in kept]).add(ids_col, T.ArrayType(T.IntegerType()))
    if bytes_col is not None:
        schema = schema.add(bytes_col, T.BinaryType())
    return df.select(*[f"`{c}`" for c in kept], bytes_of(text_col).alias(fresh(df, "__utf8"))).mapInArrow(run, schema)


def decode_ids(
    df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", ranks_file: str = RANKS
) -> DataFrame:
    """``df`` plus ``bytes_col``: the bytes of each id list (NULL: none); an id out of the vocabulary is an error.

    A column named like ``bytes_col`` is replaced.
    """
    ranks = _shared(df, ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(ranks.value, public_tokenizers.PATTERN)
        for batch in slices(batches, 256):
            column = batch.column(batch.num_columns - 1)
            offsets, values = np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False).tolist()
            decoded = pa.array([bpe.decode(values[a:b]) for a, b in zip(offsets, offsets[1:])], pa.binary())
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, decoded], names=[*batch.schema.names[:-1], bytes_col])

    kept = [c for c in df.columns if c != bytes_col]
    schema = T.StructType([df.schema[c] for c in kept]).add(bytes_col, T.BinaryType())
    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))
    return df.select(*[f"`{c}`" for c in kept], ids.alias(fresh(df, "__ids"))).mapInArrow(run, schema)


def digest(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id`` with the number and digest of the ids and the digest of the bytes decoded from them."""
    decoded = encode_texts(df, text_col, keep=["doc_id"], bytes_col="decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir):
    return digest(documents(spark, sf_dir))
