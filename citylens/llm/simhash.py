"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components.

Fingerprints are collapsed to the distinct ones first, so exact copies and
texts with equal fingerprints cost one row.  A fingerprint is cut into
``BLOCKS`` blocks; two that differ in at most ``distance`` bits agree on at
least ``BLOCKS - distance`` of them, so they meet under one of the
combinations of that many blocks.  Rows that share a combination are
compared inside a task; what is emitted is a spanning forest of the group's
links, never its pairs.  Groups above ``GROUP_ROWS`` are cut into chunks and
every pair of chunks is a group of its own, so memory stays bounded and no
link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.llm._tables import bytes_of, documents, fresh, slices, sorted_groups, stored, text_of

BITS = 64
BLOCKS = 5
GROUP_ROWS = 4096
SEED = 42


def _fingerprint(words: list[bytes], shingle: int) -> int:
    """Bit i is set if it is set in over half of the XXH64 values of the word shingles."""
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bounded scratch for very long texts
        strip = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(strip, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fingerprint)``, both as signed 64-bit integers; NULL text is empty (fingerprint 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [_fingerprint(t.as_py().lower().split(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"),
                 pa.array(np.array(prints, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "text_hash", "fingerprint"],
            )

    narrow = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.xxhash64(text_of(text_col)).alias("text_hash"),
        bytes_of(text_col).alias("text"),
    )
    return narrow.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def _masks(distance: int, blocks: int) -> list[int]:
    """Bit masks of the block combinations of which close fingerprints share at least one."""
    if not 0 <= distance < blocks:
        raise ValueError("distance must be below the number of blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _forest(group: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct fingerprints, by breadth-first search."""
    left, right = [], []
    rest = group
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= distance
            if near.any():
                found = rest[near]
                left += [node] * len(found)
                right += found.tolist()
                queue += found.tolist()
                rest = rest[~near]
    return left, right


def _links_in_groups(table: pa.Table, distance: int) -> pa.RecordBatch:
    """Links of sorted, whole groups: tiny groups all at once, larger ones by search."""
    cells = np.stack([table.column(c).to_numpy() for c in ("combo", "value", "cell")])
    prints = table.column("fingerprint").to_numpy().view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], (cells[:, 1:] != cells[:, :-1]).any(axis=0)]))
    ends = np.append(starts[1:], len(prints))
    left, right = [], []
    pairs = ends - starts == 2
    a, b = prints[starts[pairs]], prints[starts[pairs] + 1]
    near = np.bitwise_count(a ^ b) <= distance
    left += a[near].tolist()
    right += b[near].tolist()
    for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
        more_left, more_right = _forest(np.unique(prints[s:e]), distance)
        left += more_left
        right += more_right
    as_long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([as_long(left), as_long(right)], names=["a", "b"])


def links(distinct: DataFrame, distance: int = 3, blocks: int = BLOCKS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(a, b)``: links of distinct fingerprints that connect all those within ``distance`` bits.

    ``distinct`` has the column ``fingerprint``.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(distance, blocks)])
    keyed = distinct.select("fingerprint", F.posexplode(masks).alias("combo", "mask")).select(
        "combo", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("value"), "fingerprint"
    )
    # chunks of crowded values: every member goes to the cells of its chunk paired with any other
    crowded = (
        keyed.groupBy("combo", "value").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows)
        .select("combo", "value", F.ceil(F.col("n") / (group_rows // 2)).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    cells = F.transform(other, lambda o: F.least(o, chunk) * F.col("chunks") + F.greatest(o, chunk))
    dealt = keyed.join(crowded, ["combo", "value"], "left").select(
        "combo", "value", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell"),
        "fingerprint",
    )
    ordered = dealt.repartition("combo", "value", "cell").sortWithinPartitions("combo", "value", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["combo", "value", "cell"]):
            yield _links_in_groups(table, distance)

    return ordered.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``: the smallest node of its component.

    Alternating large-star and small-star rounds; every round is written to
    shared storage, and only its size and checksum come to the driver.
    """
    bigger, smaller = F.greatest("a", "b"), F.least("a", "b")
    current = stored(edges.filter("a <> b").select(bigger.alias("a"), smaller.alias("b")).distinct(), "links")
    state = None
    for _ in range(max_rounds):
        # large star: of every node's neighbours, those above it link to the least one
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lower neighbours link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        current = stored(small.filter("a <> b").distinct(), "links")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now
    raise RuntimeError("components did not settle")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 3,
    blocks: int = BLOCKS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per input row: ``(doc_id, fingerprint, component_id, root, text_hash)``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``distance`` differing bits.  NULL and empty texts have fingerprint 0 and
    are linked like any other; a NULL doc_id never names a component (it is
    NULL only if no row of the component has an id).
    """
    prints = stored(fingerprints(df, id_col, text_col, shingle), "simhash")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fingerprint"), distance, blocks, group_rows))
    rooted = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = stored(rooted.join(named, "root").select("fingerprint", "root", "component_id"), "simhash-components")
    return prints.join(lookup, "fingerprint").select("doc_id", "fingerprint", "component_id", "root", "text_hash")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` less its near-duplicates: one row of every component stays, that of the smallest id.

    A row without id stays only if no row of its component has one; among
    rows of one id the text of the smallest hash stays, equal rows count once.
    """
    found = near_duplicates(df, id_col, text_col, **options)
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash"))
    firsts = found.groupBy("root").agg(pick.alias("pick")).select(
        F.col("pick.doc_id").alias("pick_id"), F.col("pick.text_hash").alias("pick_hash")
    )
    text_hash = fresh(df, "__text_hash")
    hashed = df.withColumn(text_hash, F.xxhash64(text_of(text_col)))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("pick_id")) & (F.col(text_hash) == F.col("pick_hash"))
    kept = hashed.join(firsts, same, "left_semi")
    return kept.dropDuplicates([id_col, text_hash]).drop(text_hash)


def op7_simhash(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
