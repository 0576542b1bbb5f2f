"""Spelling variant grouping by permuterm rotations.

A word that ends in a terminator is rotated to every position.  A word
``u c v`` has the rotation ``v$u c``: without its last character, the one an
edit would change, it is the prefix ``v$u`` that all replacements of ``c``
share, and the whole rotation of the word ``u v`` in which ``c`` is left
out.  So rotations sorted by that prefix put all words within one edit next
to each other.  Every group is scanned once and gives each of its words one
row: how many neighbours it meets there and the most frequent of them.  The
words of a group differ in one character, so an alphabet bounds the group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citylens.llm._tables import bytes_of, documents, slices, stored

TERMINATOR = "$"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_OTHER = re.compile(r"[^a-zÀ-ÿ]")
#: Characters of a text read at a time, words a task counts before it hands them on, rotations of one batch.
PIECE = 1 << 20
WORDS_HELD = 200_000
ROTATIONS = 65_536
#: Words longer than this are keyed by two polynomial hashes of each side of the skipped character, so that the
#: rotations of a word of a million characters take memory in proportion to it.
LONG = 64
_HASHES = ((2147483647, 1_000_003), (2147483629, 69_621))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``size`` characters; no run of letters is cut."""
    start = 0
    while len(text) - start > size:
        cut = _OTHER.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def corpus_words(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, slip: int | None = None
) -> DataFrame:
    """``(word, n)``: the words of all texts and how often they occur.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF of at least
    ``least_length`` characters; only A-Z are lower-cased.  With ``slip``, a run
    whose ``crc32("<id>:<run>")`` it divides loses the character at that number
    modulo the length (before the length is looked at).  NULL texts have no
    words, a NULL id is written as empty text, rows of one id count each.
    """
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return out

        for batch in slices(batches, 256):
            for doc_id, raw in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                text = raw.translate(_LOWER).decode("utf-8", "replace")
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in pieces(text):
                    for word, n in Counter(run.findall(piece)).items():
                        if slip:
                            h = zlib.crc32(word.encode(), start)
                            if h % slip == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                        held[word] += n
                    if len(held) > WORDS_HELD:
                        yield flush()
        if held:
            yield flush()

    texts = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), bytes_of(text_col).alias("text"))
    counted = texts.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _powers(base: int, count: int, prime: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < count:
        step = int(out[-1]) * base % prime
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
    return out[:count]


def _side_hashes(word: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per hash: that of every start ``word[:i]`` and every end ``word[i:]``."""
    codes = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    zero = np.zeros(1, dtype=np.uint64)
    out = []
    for prime, base in _HASHES:
        p = np.uint64(prime)
        power = _powers(base, len(codes), prime)
        starts = np.concatenate([zero, np.cumsum(codes * power % p) % p])
        # aligned at the end of the word, so equal ends of words of any length hash alike
        ends = np.concatenate([np.cumsum((codes * power[::-1] % p)[::-1])[::-1] % p, zero])
        out.append((starts, ends))
    return out


def rotation_keys(word: str) -> Iterator[tuple[str, bool, bool]]:
    """``(key, whole, joins)`` of every rotation of a word.

    ``whole``: the rotation is the key, so it is the word that lacks a character.  Otherwise the key lacks the
    rotation's last character, and ``joins`` says whether that differs from the one before it in the word: of the
    equal characters of a run, any one left out gives the same word, so only the first counts as that pair.
    """
    n = len(word)
    if n <= LONG:
        for i in range(n):
            end, start = word[i + 1 :], word[:i]
            yield end + TERMINATOR + start, False, i == 0 or word[i] != word[i - 1]
        for i in range(n + 1):
            yield word[i:] + TERMINATOR + word[:i], True, False
        return
    (s1, e1), (s2, e2) = _side_hashes(word)
    for i in range(n):
        key = f"#{n - i - 1}:{e1[i + 1]:x}:{e2[i + 1]:x}{TERMINATOR}{i}:{s1[i]:x}:{s2[i]:x}"
        yield key, False, i == 0 or word[i] != word[i - 1]
    for i in range(n + 1):
        yield f"#{n - i}:{e1[i]:x}:{e2[i]:x}{TERMINATOR}{i}:{s1[i]:x}:{s2[i]:x}", True, False


def rotations(words: DataFrame) -> DataFrame:
    """``(key, id, n, whole, joins)`` for every rotation of the words ``(id, word, n)``."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, ...] = ([], [], [], [], [])

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            out = pa.RecordBatch.from_arrays(
                [pa.array(r, k) for r, k in zip(rows, kinds)], names=["key", "id", "n", "whole", "joins"]
            )
            for r in rows:
                r.clear()
            return out

        for batch in batches:
            for number, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n"))):
                for key, whole, joins in _all_keys(word):
                    for column, value in zip(rows, (key, number, n, whole, joins)):
                        column.append(value)
                    if len(rows[0]) >= ROTATIONS:
                        yield flush()
        if rows[0]:
            yield flush()

    return words.select("id", "word", "n").mapInArrow(rotate, "key string, id long, n long, whole boolean, joins boolean")


def _all_keys(word: str) -> Iterator[tuple[str, bool, bool]]:
    yield from rotation_keys(word)
    if len(word) == LONG:
        # one character longer words are keyed by hashes: this word's whole rotations meet them there
        (s1, e1), (s2, e2) = _side_hashes(word)
        for i in range(LONG + 1):
            yield f"#{LONG - i}:{e1[i]:x}:{e2[i]:x}{TERMINATOR}{i}:{s1[i]:x}:{s2[i]:x}", True, False


def near_words(words: DataFrame) -> DataFrame:
    """``(id, n_near, best_n, best)`` of the words ``(id, word, n)`` that have a word within one edit.

    ``best`` is the number of the near word of largest ``n``; numbers follow code-point order, ties go to the
    smaller.  One sort by key; a group has at most one word per letter and the word that lacks it.
    """
    group = Window.partitionBy("key")
    order = group.orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = group.orderBy(F.desc("n"), "id")
    seen = F.struct("n", "id")
    scanned = rotations(words).select(
        "key", "id", "n", "whole", "joins",
        F.row_number().over(place).alias("place"),
        F.count(F.lit(1)).over(order).alias("size"),
        F.count_if(~F.col("whole")).over(order).alias("replaced"),
        F.count_if(F.col("joins")).over(order).alias("joined"),
        F.max("whole").over(order).alias("lacking"),
        F.first(seen).over(order).alias("first"),
        F.nth_value(seen, 2).over(order).alias("second"),
    )
    met = scanned.filter("size > 1").select(
        "id",
        F.when(F.col("whole"), F.col("joined"))
        .otherwise(F.col("replaced") - 1 + (F.col("joins") & F.col("lacking")).cast("long"))
        .alias("near"),
        F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("first")).alias("other"),
    )
    # a pair may meet in several groups: its count is taken in one of them, the best of the groups is the same
    best = F.max(F.struct(F.col("other.n").alias("n"), (-F.col("other.id")).alias("minus")))
    summed = met.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return summed.select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.minus")).alias("best"))


def variant_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for a table of distinct words ``(word, n)``.

    Two words are near if one character put in, left out or replaced turns one into the other.  A word's form is its
    near word of largest ``n`` (ties: smallest in code-point order) if that ``n`` is at least ``ratio`` (2 or more)
    times its own; its root is where the forms lead, itself without one.  No words: an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: forms have to grow")
    # numbered in code-point order, so that numbers break ties
    ordered = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    table = stored(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    near = stored(near_words(table), "spelling-near")
    joined = table.select("id", "n").join(near, "id")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    links = stored(
        joined.filter(exact("best_n") >= exact("n") * ratio).select("id", F.col("best").alias("form")), "spelling-forms"
    )
    # every step multiplies n, so the longest chain is short and known
    most = table.agg(F.max("n")).first()[0] or 1
    least = table.agg(F.min("n")).first()[0] or 1
    steps, reach = 0, max(least, 1)
    while reach * ratio <= most:
        reach, steps = reach * ratio, steps + 1
    roots = links.select("id", F.col("form").alias("root"))
    onward = links.select(F.col("id").alias("at"), F.col("form").alias("further"))
    for _ in range(max(steps - 1, 0)):
        roots = roots.join(onward, F.col("root") == F.col("at"), "left").select(
            "id", F.coalesce("further", "root").alias("root")
        )
    names = table.select(F.col("id").alias("number"), F.col("word").alias("name"), F.col("n").alias("name_n"))
    named = (
        links.join(names, F.col("form") == F.col("number"))
        .select("id", F.col("name").alias("form"), F.col("name_n").alias("form_n"))
        .join(roots, "id")
        .join(names, F.col("root") == F.col("number"))
        .select("id", "form", "form_n", F.col("name").alias("root"))
    )
    return (
        table.join(near.select("id", "n_near"), "id", "left")
        .join(named, "id", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
        )
    )


def op11_spelling(spark, sf_dir):
    words = corpus_words(documents(spark, sf_dir), least_length=7, slip=31)
    return variant_groups(words.filter("n >= 2"), ratio=10)


ORACLE = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hexed AS (SELECT run, n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS hx FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda k: CAST('0x' || substr(hx, 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM hexed, crc),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_max(other, (other_n, rank)) AS other, max(other_n) AS other_n
  FROM (SELECT *, -row_number() OVER (ORDER BY other) AS rank FROM near) GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS reached, 0 AS step FROM formed
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN formed f ON c.reached = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word) r USING (word)
"""
