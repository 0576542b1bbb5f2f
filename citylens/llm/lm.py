"""Language-model scores: marginal probability of a text over all its subword segmentations.

The pieces are those of an existing byte-level vocabulary; their unigram
scores are estimated from the training documents by expectation
maximisation over the table of distinct training words (every word, with
its count).  A text is a sequence of words, each written with a leading
space, and one end; no piece reaches across a space, so its lattice falls
apart into the lattices of its words and the forward recursion runs once per
distinct word, in log space, over all words of one length at a time.  A
word's score is its marginal over all segmentations into these pieces, seen
or not; nothing else makes up a word's probability.

Counts, pieces' expectations and word scores are tables.  Words that make up
at least 1 / ``HOT_SHARE`` of all training tokens (so at most ``HOT_SHARE``
of them, each at most ``HOT_BYTES`` long) go to every task as a dictionary;
all others meet their counts in a join of (document, word, times) rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylens.llm._tables import WordIndex, bytes_of, documents, slices, stored, text_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMOOTHING = 0.1
ROUNDS = 2
#: Words up to this length keep their lattice edges between the forward and the backward pass.
KEEP_EDGES = 1024
HOT_SHARE = 1 << 20
HOT_BYTES = 48
#: Distinct words a task numbers before it starts over.
INDEX_WORDS = 300_000
END = b""  # stands for the end of a text in the tables; no word is empty
LN10 = math.log(10.0)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hash


class Lattice:
    """All segmentations of words into the pieces of a vocabulary."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        powers = np.ones(self.longest + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, len(powers)):
                powers[i] = powers[i - 1] * _BASE
        self.powers = powers
        keys = np.zeros(len(pieces), dtype=np.uint64)
        lengths = np.array(list(map(len, pieces)))
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            codes = np.frombuffer(b"".join(pieces[i] for i in rows), dtype=np.uint8).reshape(len(rows), n)
            keys[rows] = self._prefixes(codes)[:, n]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("pieces repeat or their hashes collide")
        self._build_table(keys)

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        """Rolling hash of every prefix of the rows."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(codes.shape[1]):
                out[:, i + 1] = out[:, i] * _BASE + (codes[:, i] + np.uint64(1))
        return out

    def _build_table(self, keys: np.ndarray) -> None:
        """Open addressing with linear probing, sparse enough for a few probes."""
        bits = max(10, int(np.ceil(np.log2(len(keys) * 8))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.keys, self.probes = np.zeros(1 << bits, dtype=np.uint64), 1
        with np.errstate(over="ignore"):
            home = ((keys * _BASE) >> self.shift).astype(np.int64)
        for i, slot in enumerate(home.tolist()):
            probe = 1
            while self.slots[slot] >= 0:
                slot, probe = (slot + 1) & self.mask, probe + 1
            self.slots[slot], self.keys[slot] = i, keys[i]
            self.probes = max(self.probes, probe)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        with np.errstate(over="ignore"):
            slot = ((keys * _BASE) >> self.shift).astype(np.int64)
        found = np.where(self.keys[slot] == keys, self.slots[slot], -1)
        # a slot taken by another piece: probe on, for those few only
        where = np.nonzero((found < 0) & (self.slots[slot] >= 0))
        slot, wanted = slot[where], keys[where]
        for _ in range(self.probes - 1):
            slot = (slot + 1) & self.mask
            hit = self.keys[slot] == wanted
            found[tuple(w[hit] for w in where)] = self.slots[slot[hit]]
        return found

    def _edges(self, prefixes: np.ndarray, j: int) -> tuple[int, np.ndarray]:
        """Pieces that end at position ``j``: the first start looked at, and per start the piece or -1."""
        first = max(0, j - self.longest)
        with np.errstate(over="ignore"):
            keys = prefixes[:, j, None] - prefixes[:, first:j] * self.powers[j - first : 0 : -1]
        return first, self._lookup(keys)

    @staticmethod
    def _groups(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length at a time, in bounded numbers: (their places, their codes with the leading space)."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            n = int(lengths[rows[0]]) + 1
            step = max(1, (1 << 16) // n)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                joined = b"".join(b" " + words[i] for i in part)
                yield part, np.frombuffer(joined, dtype=np.uint8).reshape(len(part), n)

    def _forward(self, codes: np.ndarray, logs: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Prefix hashes and the log probability of every prefix; ``seen`` collects the edges by end.

        ``logs`` ends with -inf for "no piece".
        """
        prefixes = self._prefixes(codes)
        alpha = np.full(prefixes.shape, -np.inf)
        alpha[:, 0] = 0.0
        for j in range(1, prefixes.shape[1]):
            first, pieces = self._edges(prefixes, j)
            if seen is not None:
                seen.append((first, pieces))
            terms = alpha[:, first:j] + logs[pieces]
            top = terms.max(axis=1)
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                alpha[:, j] = safe + np.log(np.exp(terms - safe[:, None]).sum(axis=1))
        return prefixes, alpha

    def log_marginals(self, words: list[bytes], log_probs: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, summed over its segmentations."""
        logs = np.append(log_probs, -np.inf)
        out = np.zeros(len(words))
        for rows, codes in self._groups(words):
            out[rows] = self._forward(codes, logs)[1][:, -1]
        return out

    def expected(
        self, words: list[bytes], weigh: Callable[[np.ndarray], np.ndarray], log_probs: np.ndarray
    ) -> np.ndarray:
        """Expected number of uses of every piece over the posterior segmentations of the words.

        ``weigh(places)`` says how often each of some words occurs.
        """
        logs = np.append(log_probs, -np.inf)
        uses = np.zeros(len(logs))
        for rows, codes in self._groups(words):
            n = codes.shape[1]
            edges: list | None = [] if n <= KEEP_EDGES else None
            prefixes, alpha = self._forward(codes, logs, edges)
            total = alpha[:, -1]
            weight = np.where(np.isfinite(total), weigh(rows), 0.0)
            total = np.where(np.isfinite(total), total, 0.0)
            log_beta = np.full(alpha.shape, -np.inf)
            log_beta[:, n] = 0.0
            for j in range(n, 0, -1):
                first, pieces = self._edges(prefixes, j) if edges is None else edges[j - 1]
                through = logs[pieces] + log_beta[:, j, None]
                share = np.exp(alpha[:, first:j] + through - total[:, None]) * weight[:, None]
                uses += np.bincount(pieces.ravel() % len(logs), weights=share.ravel(), minlength=len(logs))
                log_beta[:, first:j] = np.logaddexp(log_beta[:, first:j], through)
        return uses[:-1]


def vocabulary(ranks_file: str = RANKS) -> list[bytes]:
    """The pieces of a rank file that can occur in lower-cased words with a leading space."""
    with open(ranks_file, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    inner = lambda t: len((b"." + t[1:] + b".").split()) == 1  # noqa: E731  no white space after the first byte
    return [t for t in tokens if t == t.lower() and inner(t) and (t[:1] == b" " or t.strip())]


def word_counts(df: DataFrame, text_col: str, train: Column) -> DataFrame:
    """``(word, c)`` for every distinct word of all texts, ``c`` counted in training texts; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts = WordIndex(), np.zeros(0, dtype=np.int64)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(index), pa.binary()), pa.array(counts[: len(index)])], names=["word", "c"]
            )

        for batch in slices(batches):
            numbers, weights = [], []
            for text, learn in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist()):
                words = text.lower().split()
                words.append(END)
                numbers.append(index.number(words))
                weights.append(np.full(len(words), int(learn)))
            counts = np.concatenate([counts, np.zeros(len(index) - len(counts), dtype=np.int64)])
            counts += np.bincount(
                np.concatenate(numbers), weights=np.concatenate(weights), minlength=len(index)
            ).astype(np.int64)
            if len(index) > INDEX_WORDS:
                yield table()
                index, counts = WordIndex(), np.zeros(0, dtype=np.int64)
        if index:
            yield table()

    rows = df.select(F.coalesce(train, F.lit(False)).alias("train"), bytes_of(text_col).alias("text"))
    return rows.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Model:
    """Natural logs: of the pieces' probabilities, of the end, and of a token being a word."""

    log_probs: np.ndarray
    log_end: float
    log_word: float

    def word_logs(self, marginals: np.ndarray) -> np.ndarray:
        return self.log_word + marginals


def _model(log_probs: np.ndarray, tokens: int, ends: int) -> Model:
    log_end = math.log(ends + SMOOTHING) - math.log(tokens + 2 * SMOOTHING)
    return Model(log_probs, log_end, math.log1p(-math.exp(log_end)))


def fit_model(counts: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Pieces' scores by EM over all counted training words: every occurrence spreads over its word's segmentations.

    Only one number per piece comes to the driver in each round.
    """
    vocabulary_of = counts.sparkSession.sparkContext.broadcast(pieces)
    words = counts.filter((F.col("c") > 0) & (F.col("word") != F.lit(END)))
    is_end = F.col("word") == F.lit(END)
    tokens, ends = counts.agg(F.sum("c"), F.sum(F.when(is_end, F.col("c")))).first()
    tokens, ends = tokens or 0, ends or 0
    model = _model(np.full(len(pieces), -math.log(len(pieces))), tokens, ends)
    for _ in range(rounds if tokens > ends else 0):

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            lattice, uses = Lattice(vocabulary_of.value), np.zeros(len(model.log_probs))
            for batch in slices(batches, 8192):
                c = batch.column("c").to_numpy().astype(np.float64)
                uses += lattice.expected(batch.column("word").to_pylist(), lambda rows: c[rows], model.log_probs)
            some = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(uses[some])], names=["piece", "uses"])

        total = np.zeros(len(pieces))
        for row in words.mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses")).collect():
            total[row[0]] = row[1]
        model = _model(np.log(total + SMOOTHING) - math.log(total.sum() + SMOOTHING * len(pieces)), tokens, ends)
    return model


def word_scores(counts: DataFrame, pieces: list[bytes], model: Model) -> DataFrame:
    """``(word, c, lm)``: the log10 marginal probability of every word and of the end."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, model = shared.value
        lattice = Lattice(pieces)
        for batch in slices(batches, 8192):
            words = batch.column("word").to_pylist()
            logs = model.word_logs(lattice.log_marginals(words, model.log_probs))
            logs[[i for i, w in enumerate(words) if w == END]] = model.log_end
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(logs / LN10)], names=["word", "c", "lm"]
            )

    return counts.mapInArrow(score, "word binary, c long, lm double")


_ROW = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.binary()), ("tf", pa.int64()),
     ("copies", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lm", pa.float64())]
)


def _document_rows(df: DataFrame, hot: "dict[bytes, tuple[bool, float, float]]") -> DataFrame:
    """Per document one row with the sums over hot words, and a ``(key, tf)`` row for each other distinct word."""
    shared = df.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        index, scores, names = WordIndex(), np.zeros((0, 4)), []
        for batch in slices(batches, 512):
            if len(index) > INDEX_WORDS:
                index, scores, names = WordIndex(), np.zeros((0, 4)), []
            numbers = []
            for text in batch.column("text"):
                words = text.as_py().lower().split()
                words.append(END)
                numbers.append(index.number(words))
            # per fresh word: whether it is hot, known, its base and model scores
            fresh = np.array([(1.0, *table[w]) if w in table else (0.0,) * 4 for w in index.fresh], dtype=np.float64)
            scores = np.concatenate([scores, fresh.reshape(-1, 4)])
            names += index.fresh
            index.fresh = []
            n, lengths = batch.num_rows, np.array(list(map(len, numbers)))
            flat, owner = np.concatenate(numbers), np.repeat(np.arange(n), lengths)
            sums = [np.bincount(owner, weights=scores[flat, k], minlength=n) for k in (1, 2, 3)]
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            marks = [b" " + h.to_bytes(8, "big", signed=True) for h in hashes.to_pylist()]
            ones = np.ones(n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, hashes, pa.array(marks, pa.binary()), pa.array(0 * ones), pa.array(ones), pa.array(lengths),
                 pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=_ROW
            )
            rare = scores[flat, 0] == 0
            pairs, times = np.unique(owner[rare] * len(names) + flat[rare], return_counts=True)
            docs, words = np.divmod(pairs, max(1, len(names)))
            if len(pairs):
                none = pa.nulls(len(pairs))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(docs)), hashes.take(pa.array(docs)),
                     pa.array([names[w] for w in words.tolist()], pa.binary()), pa.array(times),
                     *[none.cast(f.type) for f in list(_ROW)[4:]]], schema=_ROW
                )

    schema = ("doc_id long, text_hash long, key binary, tf long, copies long, tokens long, known long, "
              "base double, lm double")
    return df.mapInArrow(run, schema)


def score_texts(
    df: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_file: str = RANKS,
    rounds: int = ROUNDS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """One row per input row: its id, token counts, ``base_score`` and ``score`` (log10 probabilities).

    ``train`` marks the rows to learn from (NULL: not).  NULL text is empty:
    one token, the end.  Without training rows the counts are zero and both
    models are uniform.  Equal rows get equal scores, each its own row.
    """
    counts = stored(word_counts(df, text_col, train), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    pieces = vocabulary(ranks_file)
    lexicon = stored(word_scores(counts, pieces, fit_model(counts, pieces, rounds)), "lm-lexicon")
    floor = math.log10(n + SMOOTHING * (v + 1))
    hot = {
        bytes(r.word): (r.c > 0, math.log10(r.c + SMOOTHING) - floor, r.lm)
        for r in lexicon.filter((F.length("word") <= HOT_BYTES) & (F.col("c") * hot_share >= n) & (F.col("c") > 0)).collect()
    }
    narrow = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.xxhash64(text_of(text_col)).alias("text_hash"),
        bytes_of(text_col).alias("text"),
    )
    rows = _document_rows(narrow, hot)
    words = lexicon.select(
        F.col("word").alias("key"),
        (F.col("c") > 0).cast("long").alias("w_known"),
        (F.log10(F.col("c") + SMOOTHING) - F.lit(floor)).alias("w_base"),
        F.col("lm").alias("w_lm"),
    )
    zero = F.lit(0)
    met = rows.join(words, "key", "left").select(
        "doc_id", "text_hash", "copies", "tokens",
        F.coalesce("known", F.col("tf") * F.col("w_known"), zero).alias("known"),
        F.coalesce("base", F.col("tf") * F.col("w_base"), zero).alias("base"),
        F.coalesce("lm", F.col("tf") * F.col("w_lm"), zero).alias("lm"),
    )
    sums = met.groupBy("doc_id", "text_hash").agg(
        *[F.sum(c).alias(c) for c in ("copies", "tokens", "known", "base", "lm")]
    )
    # equal rows (same id and text) were summed together: share out and repeat
    each = sums.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id",
        (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("lm") / F.col("copies")).alias("score"),
    )


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def op2_lattice_lm(spark, sf_dir):
    scored = score_texts(documents(spark, sf_dir), remainder("doc_id", 10) != 0)
    return scored.select(
        "doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )
