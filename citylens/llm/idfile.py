"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

Documents are encoded by a tokenizer, every one is closed by an end id, and
the ids lie in ascending order of the documents' ids.  The format is a
folder of three Parquet tables, so that it can be written and read wherever
Spark can:

``code``    (id, length): the code lengths, limited to a number of bits,
            from the counts of all ids; codes are canonical, so the lengths
            are enough.
``blocks``  (bucket, number, before, n_ids, doc_ids, doc_lengths, payload,
            checkpoints): whole documents, at least ``BLOCK_IDS`` ids where
            there are so many.  ``payload`` is the bit stream, in which every
            document starts at a byte; ``checkpoints`` holds the bits of each
            run of ``CHECK_IDS`` ids of a document (little-endian 32-bit), so
            a reader can start at any run and a block is decoded with all its
            runs in step by one table lookup per id.  ``before`` counts the
            ids of the bucket before it.
``buckets`` (bucket, first): the ids before each bucket; buckets are ranges
            of document ids.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citylens.llm._tables import WordTable, bytes_of, documents, ragged, slices, stored, text_of
from citylens.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
MAX_BITS = 18
BLOCK_IDS = 65_536
CHECK_IDS = 128
#: Blocks decoded in step by a reader.
READ_BLOCKS = 8
#: Documents per range of ids; ranges are the unit of sorting.
BUCKET_DOCUMENTS = 8192


# -- Huffman code ---------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length per symbol (0 for a count of 0) of least total size, none above ``max_bits`` (package-merge).

    The limit is raised where it cannot hold all symbols.
    """
    lengths = np.zeros(len(counts), dtype=np.int64)
    symbols = np.flatnonzero(counts)
    n = len(symbols)
    if n <= 1:
        lengths[symbols] = 1
        return lengths
    limit = max(max_bits, int(n - 1).bit_length())
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[symbols].astype(np.int64)
    items, leaf_marks = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        items = merged[order]
        leaf_marks.append(order < n)
    take = 2 * n - 2
    for marks in reversed(leaf_marks):
        used = int(marks[:take].sum())
        lengths[symbols[:used]] += 1
        take = 2 * (take - used)
    return lengths


class Code:
    """Canonical codes: shorter first, then smaller ids."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.symbols, sorted_lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(sorted_lengths[-1]) if len(order) else 1
        if self.bits > 25:
            raise ValueError("codes longer than 25 bits cannot be looked up in a 32-bit window")
        spans = np.int64(1) << (self.bits - sorted_lengths)
        firsts = np.cumsum(spans) - spans  # left-aligned codes
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        self.code[self.symbols] = (firsts >> (self.bits - sorted_lengths)).astype(np.uint64)
        self.length[self.symbols] = sorted_lengths
        self.table_symbol = np.zeros(1 << self.bits, dtype=np.int64)
        self.table_length = np.ones(1 << self.bits, dtype=np.int64)
        filled = int(spans.sum())
        self.table_symbol[:filled] = np.repeat(self.symbols, spans)
        self.table_length[:filled] = np.repeat(sorted_lengths, spans)

    def encode(self, ids: np.ndarray, doc_lengths: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Payload and checkpoints of each of some documents (every one of at least one id); ``ids`` are all theirs."""
        lengths = self.length[ids]
        ends = np.cumsum(doc_lengths)
        begins, bits = ends - doc_lengths, np.add.reduceat(lengths, ends - doc_lengths)
        size = (bits + 7) >> 3
        at = np.cumsum(size) - size  # bytes before each document
        before = np.cumsum(lengths) - lengths
        starts = before + np.repeat(at * 8 - before[begins], doc_lengths)
        word, shift = starts >> 5, (64 - lengths - (starts & 31)).astype(np.uint64)
        windows = self.code[ids] << shift  # 64 bits from the start of the 32-bit word
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        stream = np.zeros((int(size.sum()) >> 2) + 2, dtype=np.uint64)
        stream[word[heads]] += np.add.reduceat(windows >> np.uint64(32), heads)
        stream[word[heads] + 1] += np.add.reduceat(windows & np.uint64(0xFFFFFFFF), heads)
        whole = stream.astype(">u4").tobytes()
        n_runs = -(-doc_lengths // CHECK_IDS)
        marks = ragged(np.zeros(len(n_runs), dtype=np.int64), n_runs) * CHECK_IDS + np.repeat(begins, n_runs)
        runs = np.add.reduceat(lengths, marks).astype("<u4").tobytes()
        last = np.cumsum(n_runs)
        payloads = [whole[a:e] for a, e in zip(at.tolist(), (at + size).tolist())]
        return payloads, [runs[4 * a : 4 * e] for a, e in zip((last - n_runs).tolist(), last.tolist())]

    def decode(self, payload: bytes, checkpoints: bytes, doc_lengths: np.ndarray) -> np.ndarray:
        """The ids of a block: all runs advance together, one table lookup per id."""
        runs = np.frombuffer(checkpoints, dtype="<u4").astype(np.int64)
        n_runs = -(-doc_lengths // CHECK_IDS)
        nth = ragged(np.zeros(len(n_runs), dtype=np.int64), n_runs)
        owner = np.repeat(np.arange(len(n_runs)), n_runs)
        firsts = np.cumsum(n_runs) - n_runs
        size = (np.add.reduceat(runs, firsts) + 7) >> 3
        before = np.cumsum(runs) - runs
        position = before + ((np.cumsum(size) - size) * 8 - before[firsts])[owner]
        place = (np.cumsum(doc_lengths) - doc_lengths)[owner] + nth * CHECK_IDS
        left = np.minimum(CHECK_IDS, doc_lengths[owner] - nth * CHECK_IDS)
        order = np.argsort(-left, kind="stable")  # longer runs first, so those still going are a prefix
        position, place, left = position[order], place[order], left[order]
        stream = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        windows = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]
        out, drop = np.zeros(int(doc_lengths.sum()), dtype=np.int64), np.uint32(32 - self.bits)
        for k in range(int(left[0])):
            going = int(np.searchsorted(-left, -k, "left"))
            position = position[:going]
            looked = (windows[position >> 3] << (position & 7).astype(np.uint32)) >> drop
            out[place[:going] + k] = self.table_symbol[looked]
            position = position + self.table_length[looked]
        return out


# -- tokenizing -----------------------------------------------------------------------


class Memo:
    """Values by key; of two generations, the elder goes when the younger is full, so what is in use stays."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.young: dict[bytes, bytes | None] = {}
        self.old: dict[bytes, bytes | None] = {}

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """The keys without a value; those that have one are in the younger generation afterwards."""
        if len(self.young) > self.limit // 2:
            self.young, self.old = {}, self.young
        absent = keys - self.young.keys()
        again = absent & self.old.keys()
        self.young.update((key, self.old[key]) for key in again)
        return list(absent - again)


class LibraryWords:
    """Ids of white-space words by the tokenizers library.

    White space always separates the library's pre-tokens, so a text's ids are
    those of its words.  A word that is one run of letters, one of marks, or
    both in this order is one or two pre-tokens, whose ids are kept: a word
    shares them with the same word before a comma or, if the library
    lower-cases, at the start of a sentence.  Unknown ones go to the library
    many at a time and are told apart by the word-end marks.  All other words
    go one by one.
    """

    CHUNK = 1000
    #: Kept pre-tokens.
    LIMIT = 800_000
    #: Without the apostrophe, which may open a pre-token of its own.
    MARKS = "".join(c for c in string.punctuation if c != "'").encode()

    def __init__(self, data: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # equal ids of single letters could be those of an unknown one, so pairs are asked as well
        upper = [a + b for a in string.ascii_uppercase for b in ("", "e", "N")]
        self.lowers = self._each(upper) == self._each([w.lower() for w in upper])
        self.memo = Memo(self.LIMIT)

    def _each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Keep the ids of pre-tokens, packed as 32-bit integers; None for what may be several or part of one."""
        known = self.memo.young
        whole = []
        for piece in pieces:
            if piece.decode("utf-8", "replace").isalpha() or not piece.strip(self.MARKS):
                whole.append(piece)
            else:
                known[piece] = None
        for start in range(0, len(whole), self.CHUNK):
            chunk = whole[start : start + self.CHUNK]
            ids = np.array(self._each([b" ".join(chunk).decode()])[0], dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            # each is at least one pre-token, so as many ends mean one each
            if len(ends) == len(chunk):
                packed, cuts = ids.tobytes(), (4 * ends).tolist()
                found = [packed[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]
            else:
                found = [np.array(one, dtype="<u4").tobytes() for one in self._each([p.decode() for p in chunk])]
            known.update(zip(chunk, found))

    def packed_of(self, raw: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        bare = [w.rstrip(self.MARKS) for w in raw]
        marks = [w[len(b) :] for w, b in zip(raw, bare)]
        keys = [b.lower() for b in bare] if self.lowers else bare  # bytes lower-case A-Z only
        self._learn(self.memo.missing({*keys, *marks} - {b""}))
        known = self.memo.young
        known[b""] = b""
        rest = [i for i, key in enumerate(keys) if known[key] is None]
        for i in rest:
            keys[i] = b""
        out = [known[key] + known[m] for key, m in zip(keys, marks)]
        for i, found in zip(rest, self._each([raw[i].decode("utf-8", "replace") for i in rest])):
            out[i] = np.array(found, dtype="<u4").tobytes()
        return out

    def values_of(self, raw: list[bytes]) -> list[memoryview]:
        return [memoryview(ids).cast("I") for ids in self.packed_of(raw)]


#: Words numbered by a worker.
WORDS = 600_000

_WORDS: dict[int, WordTable] = {}


def _word_table(data: str) -> WordTable:
    """One table of words per worker process and tokenizer; it outlives the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
    if hash(data) not in _WORDS:
        _WORDS.clear()
        _WORDS[hash(data)] = WordTable(LibraryWords(data).packed_of, WORDS)
    return _WORDS[hash(data)]


def _range_cuts(df: DataFrame, id_col: str, per_bucket: int) -> np.ndarray:
    """Quantiles of the ids: the lower ends of the ranges but the first (one number per range)."""
    ids = df.select(F.col(f"`{id_col}`").cast("long").alias("i"))
    n = ids.count()
    parts = -(-n // per_bucket)
    if parts < 2:
        return np.zeros(0, dtype=np.int64)
    shares = [k / parts for k in range(1, parts)]
    cuts = ids.agg(F.percentile_approx("i", shares, max(10_000, 4 * parts)).alias("c")).first()["c"]
    return np.array(cuts or [], dtype=np.int64)


def _bucket(ids: pa.Array, hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Range number of each document; ids that fill several ranges are dealt over them by their text's hash."""
    values = ids.fill_null(0).to_numpy()
    low, high = np.searchsorted(cuts, values, "left"), np.searchsorted(cuts, values, "right")
    share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
    inner = low + 1 + np.minimum(np.floor(share * (high - low - 1)), high - low - 2).astype(np.int64)
    return np.where(np.asarray(ids.is_null()), 0, np.where(high - low >= 2, inner, high))


def _packed_type(tokenizer_file: str, end_id: int) -> str:
    """16 bits per id if they hold the vocabulary, else 32."""
    from tokenizers import Tokenizer

    largest = max([end_id, *Tokenizer.from_file(tokenizer_file).get_vocab().values()])
    return "<u2" if largest < 1 << 16 else "<u4"


def encode_documents(
    df: DataFrame, id_col: str, text_col: str, tokenizer_file: str, end_id: int, per_bucket: int = BUCKET_DOCUMENTS
) -> DataFrame:
    """``(bucket, doc_id, text_hash, ids)`` with the ids packed as little-endian integers (see ``_packed_type``)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())  # under 2 MB
    packed_type = _packed_type(tokenizer_file, end_id)
    cuts = _range_cuts(df, id_col, per_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _word_table(data.value)
        for batch in slices(batches, 512):
            flat, owner = table.read(batch.column("text").to_pylist())
            # one end after each document
            counts = np.bincount(owner, minlength=batch.num_rows) + 1
            ends = np.cumsum(counts)
            ids = np.full(ends[-1], end_id, dtype=packed_type)
            inside = np.ones(len(ids), dtype=bool)
            inside[ends - 1] = False
            ids[inside] = flat
            packed = [ids[a:b].tobytes() for a, b in zip(ends - counts, ends)]
            hashes = batch.column("text_hash").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(_bucket(batch.column("doc_id"), hashes, cuts)), batch.column("doc_id"),
                 batch.column("text_hash"), pa.array(packed, pa.binary())],
                names=["bucket", "doc_id", "text_hash", "ids"],
            )

    narrow = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.xxhash64(text_of(text_col)).alias("text_hash"),
        bytes_of(text_col).alias("text"),
    )
    return narrow.mapInArrow(run, "bucket long, doc_id long, text_hash long, ids binary")


def id_counts(encoded: DataFrame, packed_type: str) -> np.ndarray:
    """Count of every id over all documents (one number per id of the vocabulary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in slices(batches):
            flat = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=packed_type)
            found = np.bincount(flat, minlength=len(total))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), dtype=np.int64)])
            total += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    sums = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = sums.column("id").to_numpy(), sums.column("n").to_numpy()
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.int64)
    counts[ids] = n
    return counts


_BLOCK = (
    "bucket long, number long, before long, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
    "payload binary, checkpoints binary"
)


_BLOCK_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("number", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()),
     ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary()),
     ("checkpoints", pa.binary())]
)


def write_ids(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_file: str = TOKENIZER,
    end_id: int = END_ID,
    max_bits: int = MAX_BITS,
    block_ids: int = BLOCK_IDS,
    per_bucket: int = BUCKET_DOCUMENTS,
) -> str:
    """Write the ids of all documents to the folder ``path`` in ascending order of their ids (NULL ids first).

    NULL and empty texts are the end id alone; documents of one id are
    ordered by the hash of their text.  An empty table writes empty files.
    """
    encoded = encode_documents(df, id_col, text_col, tokenizer_file, end_id, per_bucket)
    encoded, packed_type = stored(encoded, "token-ids", "zstd"), _packed_type(tokenizer_file, end_id)
    spark = df.sparkSession
    lengths = code_lengths(id_counts(encoded, packed_type), max_bits)
    ids = np.flatnonzero(lengths)
    shared = spark.sparkContext.broadcast((ids, lengths[ids]))
    rows = [(int(i), int(n)) for i, n in zip(ids, lengths[ids])]
    spark.createDataFrame(rows, "id int, length int").coalesce(1).write.parquet(f"{path}/code")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents are coded before they are dealt: what is shuffled is as small as the file."""
        code = Code(*shared.value)
        for batch in slices(batches, 512):
            parts = [np.frombuffer(p, dtype=packed_type) for p in batch.column("ids").to_pylist()]
            sizes = np.array(list(map(len, parts)), dtype=np.int64)
            payloads, checkpoints = code.encode(np.concatenate(parts), sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket"), batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes),
                 pa.array(payloads, pa.binary()), pa.array(checkpoints, pa.binary())],
                names=["bucket", "doc_id", "text_hash", "n", "payload", "checkpoints"],
            )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, before, waiting = None, 0, 0, 0
        rows: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal number, before, waiting, rows
            doc_ids, sizes, payloads, checkpoints = zip(*rows)
            row = {
                "bucket": bucket, "number": number, "before": before, "n_ids": waiting, "doc_ids": doc_ids,
                "doc_lengths": sizes, "payload": b"".join(payloads), "checkpoints": b"".join(checkpoints),
            }
            number, before, waiting, rows = number + 1, before + waiting, 0, []
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for found, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if found != bucket or waiting >= block_ids:
                    if rows:
                        yield block()
                    if found != bucket:
                        bucket, number, before = found, 0, 0
                rows.append(tuple(row))
                waiting += row[1]
        if rows:
            yield block()

    ordered = (
        encoded.mapInArrow(
            compress, "bucket long, doc_id long, text_hash long, n long, payload binary, checkpoints binary"
        )
        .repartition("bucket")
        .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text_hash")
        .drop("text_hash")
    )
    ordered.mapInArrow(assemble, _BLOCK).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    first = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")  # one row per range of ids
    totals.select("bucket", first.alias("first")).write.parquet(f"{path}/buckets")
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document; ``ids`` packed as little-endian 32-bit integers."""
    table = spark.read.schema("id int, length int").parquet(f"{path}/code").toArrow()
    pairs = (table.column("id").to_numpy(), table.column("length").to_numpy())
    shared = spark.sparkContext.broadcast(pairs)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        for batch in slices(batches, READ_BLOCKS):
            # documents start at a byte, so blocks in a row are a longer block
            payload, checkpoints = (b"".join(batch.column(c).to_pylist()) for c in ("payload", "checkpoints"))
            doc_ids, sizes = batch.column("doc_ids"), batch.column("doc_lengths")
            lengths, per_block = sizes.flatten().to_numpy(), sizes.value_lengths().to_numpy()
            flat = code.decode(payload, checkpoints, lengths).astype("<u4")
            ends = np.cumsum(lengths)
            n_ids = batch.column("n_ids").to_numpy()
            before = np.repeat(batch.column("before").to_numpy() - (np.cumsum(n_ids) - n_ids), per_block)
            packed = [flat[a:b].tobytes() for a, b in zip(ends - lengths, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("bucket").to_numpy(), per_block)), doc_ids.flatten(),
                 pa.array(before + ends - lengths), pa.array(lengths), pa.array(packed, pa.binary())],
                names=["bucket", "doc_id", "offset", "n_tokens", "ids"],
            )

    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").drop("number")
    decoded = blocks.mapInArrow(decode, "bucket long, doc_id long, offset long, n_tokens long, ids binary")
    buckets = spark.read.schema("bucket long, first long").parquet(f"{path}/buckets")
    return decoded.join(buckets, "bucket").select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids"
    )


def op4_id_files(spark, sf_dir):
    path = write_ids(documents(spark, sf_dir), scratch_path(spark, "id-files"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
