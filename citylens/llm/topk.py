"""Exact top-k search by inner product: term-at-a-time accumulation into dense score arrays.

Vectors are packed as rows and quantised to integers where they are compared.  Queries and
candidates are dealt to the cells of a grid (query block x candidate
block), both blocks of bounded size, so a cell fits one task however many
vectors there are and no side is broadcast.  Inside a cell the candidates
form posting lists per component; the non-zero components of every query
row scatter their weighted postings into a dense score array, a partition
selection keeps the k best, and a window merges the cells' winners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citylens.llm._tables import documents, stored

#: Vectors of one block; a score array has QUERY_STRIP x CANDIDATE_BLOCK entries.
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
QUERY_STRIP = 128
#: Scores from this magnitude on do not fit a long; sums of products that may reach half of it are worked out exactly.
TOO_LARGE = 2**63
_SAFE = float(2**62)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector)`` with the components packed as little-endian doubles.

    Vectors that are NULL or hold a NULL or non-finite component take no part; nor do rows without an id.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            offsets = np.asarray(column.offsets)
            flat, offsets = np.asarray(column.values, dtype="<f8")[offsets[0] : offsets[-1]], offsets - offsets[0]
            packed = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(packed, pa.binary())], names=["vec_id", "vector"]
            )

    return kept.mapInArrow(pack, "vec_id long, vector binary")


class _Rows:
    """The vectors of one side of a cell, padded with zeros to the longest (a missing component adds nothing).

    ``weights`` are the quantised components as longs, zero where one does not fit; ``sizes`` their magnitudes in double.
    """

    def __init__(self, packed: pd.Series, scale: int) -> None:
        rows = [np.frombuffer(b, dtype="<f8") for b in packed]
        self.scale = scale
        self.vectors = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
        for i, r in enumerate(rows):
            self.vectors[i, : len(r)] = r
        with np.errstate(over="ignore"):
            scaled = np.floor(self.vectors * scale)
        self.sizes = np.abs(scaled)
        self.weights = np.where(self.sizes < TOO_LARGE, scaled, 0.0).astype(np.int64)

    def exact(self, row: int) -> list[int]:
        """The quantised components as integers of any size (a double from 2^53 on is a whole number)."""
        return [int(x) * self.scale if abs(x) >= 2**53 else math.floor(x * self.scale) for x in self.vectors[row].tolist()]


def _postings(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per component: the candidates that have it and their weights."""
    lists = []
    for column in matrix.T:
        members = np.flatnonzero(column)
        lists.append((members, column[members]))
    return lists


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one score array, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        chosen = np.flatnonzero(scores >= floor)
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))][:k]


def _best_exact(scores: list[int], ids: np.ndarray, k: int) -> np.ndarray:
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)


def _search_cell(left: pd.DataFrame, right: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    ids, numbers = right["vec_id"].to_numpy(), right["n"].to_numpy()
    query_ids, query_numbers = left["vec_id"].to_numpy(), left["n"].to_numpy()
    queries, candidates = _Rows(left["vector"], scale), _Rows(right["vector"], scale)
    posting_lists = _postings(candidates.weights)
    width = min(queries.weights.shape[1], candidates.weights.shape[1])
    a, b = queries.sizes[:, :width], candidates.sizes[:, :width]
    with np.errstate(over="ignore", invalid="ignore"):
        plain = not a.size or not b.size or bool((a.max(axis=0) * b.max(axis=0)).sum() < _SAFE)
    found: dict[str, list] = {"query": [], "query_id": [], "vec_id": [], "score": [], "unfit": []}
    for start in range(0, len(left), QUERY_STRIP):
        strip = queries.weights[start : start + QUERY_STRIP]
        scores = np.zeros((len(strip), len(ids)), dtype=np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            # pairs whose products may not add up in a long (not a number: a component is beyond doubles)
            doubtful = None if plain else ~(a[start : start + QUERY_STRIP] @ b.T < _SAFE)
        for term in range(width):
            members, postings = posting_lists[term]
            if not len(members):
                continue
            whole = len(members) == len(ids)
            for row in np.flatnonzero(strip[:, term]):
                if whole:
                    scores[row] += strip[row, term] * postings
                else:
                    scores[row, members] += strip[row, term] * postings
        for row, query in enumerate(query_ids[start : start + QUERY_STRIP]):
            number = query_numbers[start + row]
            others = np.flatnonzero(numbers != number)
            if doubtful is not None and doubtful[row, others].any():
                mine, exact = queries.exact(start + row), scores[row, others].tolist()
                for i in np.flatnonzero(doubtful[row, others]):
                    exact[i] = sum(x * y for x, y in zip(mine, candidates.exact(others[i])))
                best = _best_exact(exact, ids[others], k)
                values = [exact[i] for i in best]
            else:
                best = _best(scores[row, others], ids[others], k)
                values = scores[row, others[best]].tolist()
            found["query"] += [number] * len(best)
            found["query_id"] += [query] * len(best)
            found["vec_id"] += ids[others[best]].tolist()
            # a score beyond a long keeps its place at the end it passed; it is an error if it is returned
            found["score"] += [min(max(v, -TOO_LARGE), TOO_LARGE - 1) for v in values]
            found["unfit"] += [not -TOO_LARGE <= v < TOO_LARGE for v in values]
    kinds = {"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64", "unfit": "bool"}
    return pd.DataFrame(found).astype(kinds)


def exact_top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """Per query row the ``k`` candidates of highest integer inner product.

    Returns ``(query_id, rank, vec_id, score)``; every row but the query's
    own is a candidate, ties go to the smaller id.  Vectors of different
    lengths are compared over their common components.  ``is_query`` is a
    predicate on ``vec_id``.  An id that occurs on several rows is one
    candidate, and one query with a list of its own, per row.  Components and sums of any size are worked out exactly;
    only a returned score that does not fit a long is an error.  No vectors or no queries: an empty result.
    """
    packed = stored(usable_vectors(df, id_col, vector_col), "vectors")
    total = packed.agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries")).first()
    columns, rows = -(-total["rows"] // candidate_block), -(-total["queries"] // query_block)
    # the packed table is written, so its rows keep their order and repeated rows are dealt apart
    packed = packed.withColumn("n", F.monotonically_increasing_id())
    deal = F.pmod(F.xxhash64("n"), F.lit(1 << 30)).cast("int")
    # each cell gets one block of either side: query rows repeat per column, candidate rows per row of the grid
    queries = packed.filter(is_query).select(
        (deal % max(rows, 1)).alias("row"),
        F.explode(F.sequence(F.lit(0), F.lit(max(columns, 1) - 1))).alias("col"),
        "n", "vec_id", "vector",
    )
    candidates = packed.select(
        (deal % max(columns, 1)).alias("col"),
        F.explode(F.sequence(F.lit(0), F.lit(max(rows, 1) - 1))).alias("row"),
        "n", "vec_id", "vector",
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search_cell(left, right, k, scale)

    winners = (
        queries.groupBy("row", "col")
        .cogroup(candidates.groupBy("row", "col"))
        .applyInPandas(search, "query long, query_id long, vec_id long, score long, unfit boolean")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = winners.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    error = F.raise_error(F.lit("a score does not fit a 64-bit integer")).cast("long")
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("unfit"), error).otherwise(F.col("score")).alias("score"))


def op10_exact_top_k(spark, sf_dir):
    return exact_top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
