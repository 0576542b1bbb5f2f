"""Approximate nearest neighbours by inner product: a permutation index.

Pivots are a bounded sample of the vectors.  A vector is represented by its
nearest pivots in order.  It is filed under the nearest one; a query looks
into the files of its nearest pivots.  Inside, inverted files per pivot list
who has the pivot in its order and at which place; adding up a query's lists
gives the footrule distance between the query's order and every order there.
Those within a footrule distance are scored exactly from the original
vectors.  How many files a query opens and up to which distance it scores
are learnt from a bounded sample of queries whose true neighbours are found
by comparing them with every row, so that a stated recall is met whatever
the shape of the data.

Equal vectors are one entry (their smallest ids stand for them, no result
needs more).  Large files are dealt over several cells, small neighbouring
ones share a cell; a cell holds a bounded number of vectors and of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.llm._tables import documents, ragged, slices, stored

#: Pivots (sampled vectors): the root of the number of vectors within these bounds, and at most so many components
#: in all.  Places of an order that count.  Queries of the sample the search is fitted on.
PIVOTS = (32, 1024)
PIVOT_VALUES = 1_000_000
PLACES = 32
SAMPLE = 256
#: Vectors and queries of one cell.
CELL_VECTORS = 4096
CELL_QUERIES = 16_384


def pack(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, bytes)``: usable vectors as packed components of the column's own precision.

    Rows without an id, and vectors that are NULL, zero or empty, or hold a NULL or non-finite component, are left out.
    """
    wide = not isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    vector = F.col(f"`{vector_col}`").cast("array<double>" if wide else "array<float>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable
    )
    kind = "<f8" if wide else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            offsets = np.asarray(column.offsets)
            # minus zero is zero, so that equal vectors have equal bytes
            flat = (np.asarray(column.values)[offsets[0] : offsets[-1]] + 0.0).astype(kind)
            packed = [flat[a:b].tobytes() for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], names=["vec_id", "bytes"])

    return rows.mapInArrow(run, "vec_id long, bytes binary")


@dataclass
class Index:
    """What the tasks need: bounded by the number of pivots."""

    kind: str
    width: int
    largest: float
    pivots: np.ndarray
    places: int
    # learnt: files a query opens, least agreement (complement of the footrule distance) scored
    visits: int = 0
    agreement: int = 0
    # cells of a pivot's file: the first and how many
    first: np.ndarray | None = None
    parts: np.ndarray | None = None

    def matrix(self, packed) -> np.ndarray:
        """Rows in double precision, padded with zeros to the longest vector."""
        rows = [np.frombuffer(b, dtype=self.kind) for b in packed]
        out = np.zeros((len(rows), self.width))
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors whose cosines order candidates as their inner products with a query do."""
        scale = np.abs(vectors).max(axis=1, initial=0.0)
        scale[scale == 0] = 1.0
        unit = vectors / scale[:, None]
        norms = np.sqrt((unit * unit).sum(axis=1))
        if query:
            return np.concatenate([unit / norms[:, None], np.zeros((len(unit), 1))], axis=1)
        share = np.minimum(norms * (scale / self.largest), 1.0)
        return np.concatenate([unit / norms[:, None] * share[:, None], np.sqrt(1.0 - share * share)[:, None]], axis=1)

    def order(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """The pivots of every vector, nearest first."""
        near = self.lifted(vectors, query) @ self.pivots.T
        return np.argsort(-near, axis=1, kind="stable")

    def cells_of(self, order: np.ndarray) -> list[np.ndarray]:
        """The cells a query with this order looks into."""
        out = []
        for files in order[:, : self.visits]:
            out.append(np.unique(ragged(self.first[files], self.parts[files])))
        return out


def agreements(orders: np.ndarray, queries: np.ndarray, places: int) -> Iterator[np.ndarray]:
    """Per query order, how far each order agrees with it over the first ``places``.

    ``places * (places + 1) - 2 * agreement`` is the footrule distance of the two orders, a missing pivot standing
    at the place after the last.  Term at a time: the inverted file of each of the query's pivots adds its share.
    """
    mine = orders[:, :places]
    pivots = int(max(orders.max(initial=0), queries.max(initial=0))) + 1
    flat = mine.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
    who, weight = by_pivot // max(mine.shape[1], 1), places - by_pivot % max(mine.shape[1], 1)
    for query in queries[:, :places]:
        lengths = starts[query + 1] - starts[query]
        posted = ragged(starts[query], lengths)
        own = np.repeat(places - np.arange(len(query)), lengths)
        yield np.bincount(who[posted], weights=np.minimum(own, weight[posted]), minlength=len(mine)).astype(np.int64)


def places_of(orders: np.ndarray) -> np.ndarray:
    """The place of every pivot in each order."""
    out = np.empty_like(orders)
    np.put_along_axis(out, orders, np.broadcast_to(np.arange(orders.shape[1]), orders.shape), axis=1)
    return out


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same way whatever is compared beside it."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (vectors * query).sum(axis=1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        chosen = np.flatnonzero(~(scores < floor))
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))][:k]


def _true_neighbours(vectors: DataFrame, index: Index, asked: list, k: int) -> list:
    """For some queries ``(n, bytes)``: the place of every true neighbour's file and its agreement.

    One pass over all vectors; a task keeps the best ``k`` of each query.
    """
    numbers = np.array([r["n"] for r in asked])
    packed = [bytes(r["bytes"]) for r in asked]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = index.matrix(packed)
        order = index.order(queries, query=True)
        place = places_of(order)
        held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in packed]
        for batch in slices(batches, 2048):
            n = batch.column("n").to_numpy(zero_copy_only=False)
            rows = index.matrix(batch.column("bytes").to_pylist())
            scores = rows @ queries.T
            for i, kept in enumerate(held):
                column = np.where(n == numbers[i], -np.inf, scores[:, i])
                least = kept[0].min() if len(kept[0]) == k else -np.inf
                near = np.flatnonzero(np.isfinite(column) & (column >= least))
                near = near[_best(column[near], n[near], k)]
                if not len(near):
                    continue
                orders = index.order(rows[near])
                (agreed,) = agreements(orders, order[i : i + 1], index.places)
                both = [np.concatenate(x) for x in zip(kept, (column[near], n[near], place[i, orders[:, 0]], agreed))]
                best = _best(both[0], both[1], k)
                held[i] = tuple(x[best] for x in both)
        for number, (scores, n, places, agreed) in zip(numbers.tolist(), held):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(n), pa.int64()), pa.array(scores), pa.array(n), pa.array(places), pa.array(agreed)],
                names=["q", "score", "n", "place", "agreement"],
            )

    found = vectors.select("n", "bytes").mapInArrow(search, "q long, score double, n long, place long, agreement long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "n")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("place", "agreement").collect()


def _nearby(pivots: np.ndarray) -> np.ndarray:
    """The pivots in a chain from each to the nearest one left, so that neighbours in it share queries."""
    near = pivots @ pivots.T
    chain, left = [0], np.ones(len(pivots), dtype=bool)
    left[0] = False
    while left.any():
        step = int(np.argmax(np.where(left, near[chain[-1]], -np.inf)))
        chain.append(step)
        left[step] = False
    return np.array(chain)


def fit(vectors: DataFrame, queries: DataFrame, kind: str, k: int, recall: float, cell_vectors: int) -> Index:
    """Pivots, the files' cells, and how far a query has to look for the wanted recall."""
    size = np.dtype(kind).itemsize

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            top = 0.0
            for b in batch.column("bytes").to_pylist():
                v = np.frombuffer(b, dtype=kind).astype(np.float64)
                scale = np.abs(v).max()
                top = max(top, float(scale * np.sqrt(((v / scale) ** 2).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([top])], names=["norm"])

    shape = vectors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("bytes")).alias("bytes")).first()
    width, rows = max((shape["bytes"] or 0) // size, 1), shape["rows"]
    largest = vectors.select("bytes").mapInArrow(norm, "norm double").agg(F.max("norm")).first()[0] or 1.0
    count = int(min(max(np.ceil(np.sqrt(rows)), PIVOTS[0]), PIVOTS[1], max(PIVOT_VALUES // width, 1)))
    sample = vectors.orderBy(F.xxhash64("bytes", F.lit("pivot")), "n").limit(count).select("bytes").collect()
    index = Index(kind, width, largest, np.zeros((1, width + 1)), 1)
    if not sample:
        return index
    index.pivots = index.lifted(index.matrix([bytes(r[0]) for r in sample]), query=False)
    index.places = min(PLACES, len(sample))

    # how many vectors each file has: one number per pivot
    filed = vectors.select("bytes").mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_arrays(
                [pa.array(index.order(index.matrix(b.column("bytes").to_pylist()))[:, 0].astype(np.int64))], names=["file"]
            )
            for b in slices(batches, 2048)
        ),
        "file long",
    )
    sizes = np.zeros(len(sample), dtype=np.int64)
    for r in filed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["file"]] = r["n"]
    index.first, index.parts = np.zeros(len(sample), dtype=np.int64), np.ones(len(sample), dtype=np.int64)
    cell, filled = 0, 0
    for pivot in _nearby(index.pivots).tolist():
        if filled and filled + sizes[pivot] > cell_vectors:
            cell, filled = cell + 1, 0
        index.first[pivot] = cell
        if sizes[pivot] > cell_vectors:
            index.parts[pivot] = -(-int(sizes[pivot]) // cell_vectors)
            cell, filled = cell + int(index.parts[pivot]), 0
        else:
            filled += sizes[pivot]

    asked = queries.select("n", "bytes").distinct().orderBy(F.xxhash64("bytes", F.lit("query")), "n").limit(SAMPLE).collect()
    index.visits, index.agreement = len(sample), 0
    true = _true_neighbours(vectors, index, asked, k) if asked else []
    if true:
        # each of the two cuts may lose half of what the recall leaves
        lost = (1.0 - recall) / 2
        index.visits = int(np.quantile([r["place"] for r in true], 1 - lost, method="higher")) + 1
        index.agreement = int(np.quantile([r["agreement"] for r in true], lost, method="lower"))
    return index


def _search_cell(queries: pd.DataFrame, filed: pd.DataFrame, index: Index, k: int) -> pd.DataFrame:
    out: dict[str, list] = {"q": [], "of": [], "vec_id": [], "score": []}
    if len(queries) and len(filed):
        vectors, wanted = index.matrix(filed["bytes"]), index.matrix(queries["bytes"])
        orders, asked = index.order(vectors), index.order(wanted, query=True)
        place = places_of(asked)
        ids, entries = [np.asarray(i) for i in filed["ids"]], filed["n"].to_numpy()
        for i, agreed in enumerate(agreements(orders, asked, index.places)):
            opened = np.flatnonzero(place[i, orders[:, 0]] < index.visits)
            chosen = opened[agreed[opened] >= index.agreement]
            if len(chosen) <= k:
                chosen = opened[np.argsort(-agreed[opened], kind="stable")][: k + 1]
            if not len(chosen):
                continue
            # every copy of a vector is a candidate of its own
            copies = np.fromiter((len(ids[c]) for c in chosen), dtype=np.int64, count=len(chosen))
            each = np.concatenate([ids[c] for c in chosen])
            scores = np.repeat(products(vectors[chosen], wanted[i]), copies)
            best = _best(scores, each, k + 1)
            out["q"] += [queries["n"].iloc[i]] * len(best)
            out["of"] += np.repeat(entries[chosen], copies)[best].tolist()
            out["vec_id"] += each[best].tolist()
            out["score"] += scores[best].tolist()
    return pd.DataFrame(out).astype({"q": "int64", "of": "int64", "vec_id": "int64", "score": "float64"})


def _search(vectors: DataFrame, queries: DataFrame, index: Index, k: int, cell_queries: int) -> DataFrame:
    """``(q, found)``: per distinct query vector the ``k + 1`` best entries, the query's own row possibly among them."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            nearest = index.order(index.matrix(batch.column("bytes").to_pylist()))[:, 0]
            deal = batch.column("deal").to_numpy(zero_copy_only=False)
            cell = index.first[nearest] + deal % index.parts[nearest]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), *(batch.column(c) for c in ("n", "bytes", "ids"))], names=["cell", "n", "bytes", "ids"]
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            cells = index.cells_of(index.order(index.matrix(batch.column("bytes").to_pylist()), query=True))
            rows = pa.array(np.repeat(np.arange(len(cells)), [len(c) for c in cells]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cells)), batch.column("n").take(rows), batch.column("bytes").take(rows)],
                names=["cell", "n", "bytes"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ask(batches):
            cells, n = np.unique(batch.column("cell").to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], names=["cell", "asked"])

    deal = F.pmod(F.xxhash64("n"), F.lit(1 << 40)).alias("deal")
    filed = vectors.select("n", "bytes", "ids", deal).mapInArrow(file, "cell long, n long, bytes binary, ids array<long>")
    asked = queries.select("n", "bytes").mapInArrow(ask, "cell long, n long, bytes binary")
    # the queries of a crowded cell are dealt over blocks, each with the cell's vectors
    crowd = queries.select("n", "bytes").mapInArrow(count, "cell long, asked long").groupBy("cell").agg(F.sum("asked").alias("asked"))
    blocks = stored(crowd.select("cell", F.ceil(F.col("asked") / cell_queries).cast("int").alias("blocks")), "ann-blocks")
    asked = asked.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("n", F.lit("block")), "blocks").cast("int"))
    filed = filed.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = (
        asked.select("cell", "block", "n", "bytes").groupBy("cell", "block")
        .cogroup(filed.select("cell", "block", "n", "bytes", "ids").groupBy("cell", "block"))
        .applyInPandas(lambda q, v: _search_cell(q, v, index, k), "q long, of long, vec_id long, score double")
    )
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    # at most k + 1 entries
    return best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "of", "vec_id", "score"))).alias("found"))


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = 0.95,
    cell_vectors: int = CELL_VECTORS,
    cell_queries: int = CELL_QUERIES,
) -> DataFrame:
    """Per query row the ``k`` nearest rows found, by inner product in double precision.

    Returns ``(query_id, rank, vec_id, score)``.  Every row but the query's own is a candidate; ties go to the
    smaller id.  ``recall`` is the share of the true ``k`` nearest that the search is fitted to find on a sample of
    ``SAMPLE`` queries; the pivots are a sample too, every row is indexed.  A query that found fewer than ``k`` is
    compared with every row.  ``is_query`` is a predicate on ``vec_id``.

    Rows without an id, and vectors that are NULL, zero, empty or hold a NULL or non-finite component, take no part.
    Vectors of different lengths are compared over their common components.  Rows of one id, and equal vectors, are
    candidates of their own, and each query row has its list.  No vectors or no queries: an empty result.
    """
    wide = not isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    packed = stored(pack(df, id_col, vector_col), "ann-packed")
    # equal vectors: the k + 1 smallest ids are all that a result can name
    first = Window.partitionBy("bytes").orderBy("vec_id")
    few = packed.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k + 1)
    entries = few.groupBy("bytes").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = stored(entries.select(F.monotonically_increasing_id().alias("n"), "bytes", "ids"), "ann-vectors")
    rows = packed.filter(is_query).join(vectors.select("n", "bytes"), "bytes")
    asked = stored(rows.select("vec_id", "n", "bytes"), "ann-queries")
    distinct = stored(asked.select("n", "bytes").distinct(), "ann-distinct-queries")

    index = fit(vectors, distinct, "<f8" if wide else "<f4", k, recall, cell_vectors)
    if index.first is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    found = stored(_search(vectors, distinct, index, k, cell_queries), "ann-found")
    # a query that met too few candidates opens every file
    enough = min(k + 1, packed.count())
    short = distinct.join(found.filter(F.size("found") >= enough).select(F.col("q").alias("n")), "n", "left_anti")
    if index.visits < len(index.parts) and not short.isEmpty():
        whole = Index(**{**index.__dict__, "visits": len(index.parts)})
        again = _search(vectors, stored(short, "ann-short"), whole, k, cell_queries)
        found = found.filter(F.size("found") >= enough).unionByName(again)

    joined = asked.select(F.col("vec_id").alias("query_id"), "n").join(found, F.col("n") == F.col("q"))
    # one entry of the query's id with the query's vector is its own row
    own = F.get(F.filter("found", lambda x: (x["vec_id"] == F.col("query_id")) & (x["of"] == F.col("n"))), F.lit(0))["r"]
    joined = joined.withColumn("own", F.coalesce(own, F.lit(0)))
    without = F.filter("found", lambda x: x["r"] != F.col("own"))
    listed = joined.select("query_id", F.posexplode(F.slice(without, 1, k)).alias("at", "entry"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("entry.vec_id").alias("vec_id"), F.col("entry.score").alias("score"))


def op13_permutation_index(spark, sf_dir):
    return nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
