"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words and runs of punctuation are hashed to ``BUCKETS`` buckets.  Every
bucket has a sparse random index vector; the vector of a bucket is the sum
of the index vectors of its neighbours in all texts, gathered in one pass
with partial sums per task.  A document is the weighted mean of its words'
vectors (frequent words weigh less).  A network with one hidden layer is
fitted in numpy on a bounded sample of labelled training documents, and its
logits are divided by a temperature fitted on a part of them kept aside.

What goes to the driver and back to the tasks is bounded by parameters: one
row per bucket, and at most ``MAX_LABELLED`` pooled vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.llm._tables import WordTable, bytes_of, documents, fresh, slices, text_of

BUCKETS = 1 << 15
DIMENSIONS = 64
NONZEROS = 4
REACH = 2
MAX_LABELLED = 20_000
HIDDEN = 32
EPOCHS = 40
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Tokens(WordTable):
    """Turns texts into bucket numbers; each distinct white-space word is cut and hashed once per task."""

    def __init__(self, buckets: int) -> None:
        super().__init__(lambda words: [self._cut(w) for w in words])
        self.buckets = buckets

    def _cut(self, word: bytes) -> list[int]:
        pieces = _TOKEN.findall(word.decode("utf-8", "replace"))
        return [xxhash.xxh32_intdigest(p.encode()) % self.buckets for p in pieces]


def index_vectors(buckets: int, dimensions: int, nonzeros: int = NONZEROS) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the places and signs of the non-zero components of its random index vector."""
    draw = np.random.default_rng(20_240_501)
    return draw.integers(0, dimensions, (buckets, nonzeros)), draw.choice([-1.0, 1.0], (buckets, nonzeros))


def context_sums(
    tokens: np.ndarray, owner: np.ndarray, places: np.ndarray, signs: np.ndarray, dimensions: int, reach: int = REACH
) -> np.ndarray:
    """Sums of the index vectors of every token's neighbours, added up by bucket."""
    size = len(places) * dimensions
    sums = np.zeros(size)
    for offset in range(1, reach + 1):
        same = owner[:-offset] == owner[offset:]
        left, right = tokens[:-offset][same].astype(np.int64), tokens[offset:][same].astype(np.int64)
        for a, b in ((left, right), (right, left)):
            for k in range(places.shape[1]):
                sums += np.bincount(a * dimensions + places[b, k], weights=signs[b, k], minlength=size)
    return sums.reshape(len(places), dimensions)


def word_vectors(
    df: DataFrame, text_col: str, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, reach: int = REACH
) -> tuple[np.ndarray, np.ndarray]:
    """``(sums, counts)`` per bucket over all texts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (places, signs) = Tokens(buckets), index_vectors(buckets, dimensions)
        sums, counts = np.zeros((buckets, dimensions)), np.zeros(buckets)
        for batch in slices(batches):
            flat, owner = tokens.read(batch.column(0).to_pylist())
            sums += context_sums(flat, owner, places, signs, dimensions, reach)
            counts += np.bincount(flat, minlength=buckets)
        some = np.flatnonzero(counts)
        columns = [pa.array(some), pa.array(counts[some].astype(np.int64))]
        columns += [pa.array(sums[some, d].astype(np.int64)) for d in range(dimensions)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["bucket", "n", *[f"v{d}" for d in range(dimensions)]]
    partial = df.select(bytes_of(text_col).alias("text")).mapInArrow(gather, ", ".join(f"{c} long" for c in names))
    table = partial.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    sums, counts = np.zeros((buckets, dimensions)), np.zeros(buckets)
    rows = table.column("bucket").to_numpy()
    counts[rows] = table.column("n").to_numpy()
    for d in range(dimensions):
        sums[rows, d] = table.column(f"v{d}").to_numpy()
    return sums, counts


def weighted_vectors(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors about the corpus mean, and the weight of each bucket in a document's mean."""
    damped = np.sign(sums) * np.sqrt(np.abs(sums))
    norms = np.linalg.norm(damped, axis=1, keepdims=True)
    unit = np.divide(damped, norms, out=np.zeros_like(damped), where=norms > 0)
    total = max(1.0, counts.sum())
    centre = (unit * counts[:, None]).sum(axis=0) / total
    unit = np.where(norms > 0, unit - centre, 0.0)
    return unit.astype(np.float32), (1e-3 / (1e-3 + counts / total)).astype(np.float32)


def pool(flat: np.ndarray, owner: np.ndarray, n: int, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per text the weighted mean of its word vectors, and how alike and how often equal neighbours are.

    A text without words is the zero vector.
    """
    out = np.zeros((n, vectors.shape[1] + 2))
    mean, mass = out[:, : vectors.shape[1]], np.bincount(owner, weights=weights[flat], minlength=n)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        alike = equal = 0.0
        for start in range(a, b, 1 << 16):  # bounded scratch for very long texts
            part = flat[start : min(b, start + (1 << 16) + 1)]
            found = vectors[part]
            alike += float(np.einsum("ij,ij->", found[:-1], found[1:]))
            equal += int((part[:-1] == part[1:]).sum())
            part, found = part[: 1 << 16], found[: 1 << 16]
            mean[i] += weights[part] @ found
        if b - a > 1:
            out[i, -2:] = alike / (b - a - 1), equal / (b - a - 1)
    np.divide(mean, mass[:, None], out=mean, where=mass[:, None] > 0)
    return out


@dataclass
class Network:
    """Features -> tanh layer -> one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss over the rows outside ``calibration``; the temperature is fitted on those inside.

    Without rows the network says 0.5 for every text; without calibration rows the temperature is 1.
    """
    draw, d = np.random.default_rng(7), x.shape[1]
    fit = ~calibration if (~calibration).any() else calibration
    xs, ys = x[fit], y[fit]
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if not len(xs):
        return net
    net.mean, net.scale = xs.mean(axis=0), np.maximum(xs.std(axis=0), 1e-6)
    net.w1, net.w2 = draw.normal(0, d**-0.5, (d, hidden)), draw.normal(0, hidden**-0.5, hidden)
    z = (xs - net.mean) / net.scale
    state, step = [net.w1, net.b1, net.w2, np.array([net.b2])], 0
    first, second = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    for _ in range(epochs):
        order = draw.permutation(len(z))
        for start in range(0, len(z), 128):
            rows = order[start : start + 128]
            h = np.tanh(z[rows] @ state[0] + state[1])
            error = (1 / (1 + np.exp(-np.clip(h @ state[2] + state[3], -60, 60))) - ys[rows]) / len(rows)
            back = np.outer(error, state[2]) * (1 - h * h)
            slopes = [z[rows].T @ back + 1e-4 * state[0], back.sum(axis=0), h.T @ error + 1e-4 * state[2], error.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                state[i] = state[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = state[0], state[1], state[2], float(state[3][0])
    if calibration.any():
        net.temperature = fit_temperature(net.logits(x[calibration]), y[calibration])
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss, by a search over a fine grid of powers."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(16.0), 241))
    margins = (2 * y - 1) * logits
    losses = [np.logaddexp(0, -margins / t).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


@dataclass
class QualityModel:
    vectors: np.ndarray
    weights: np.ndarray
    network: Network

    def features(self, tokens: Tokens, texts: list[bytes]) -> np.ndarray:
        flat, owner = tokens.read(texts)
        return pool(flat, owner, len(texts), self.vectors, self.weights)


def labelled_sample(
    df: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, most: int
) -> tuple[DataFrame, tuple[Column, ...]]:
    """``(doc_id, label, text)`` of the labelled training rows of at most ``most`` ids, and the order to choose by.

    Ids are chosen by their hash.

    An id with several labels takes the majority; rows without a label or an id are left out.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("label_id"), F.col(f"`{label_col}`").alias("y"))
    each = known.dropna().groupBy("label_id").agg((F.avg("y") >= 0.5).cast("double").alias("label"))
    rows = df.filter(train).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    usable = each.withColumn(id_col, F.col("label_id")).filter(train)
    chosen = usable.select("label_id", "label").orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    # at most ``most`` rows of two numbers
    joined = rows.join(F.broadcast(chosen), rows.doc_id == chosen.label_id).select("doc_id", "label", "text")
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"))
    return joined, order


def fit_quality(
    df: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    buckets: int = BUCKETS,
    dimensions: int = DIMENSIONS,
    max_labelled: int = MAX_LABELLED,
) -> QualityModel:
    """Word vectors from all texts; the network from labelled rows where ``train`` (a predicate on the id) holds."""
    vectors, weights = weighted_vectors(*word_vectors(df, text_col, buckets, dimensions))
    model = QualityModel(vectors, weights, None)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows, order = labelled_sample(df, labels, train, id_col, text_col, label_col, max_labelled)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(buckets)
        for batch in slices(batches, 512):
            x = shared.value.features(tokens, batch.column("text").to_pylist())
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), packed], names=["rank", "doc_id", "label", "x"]
            )

    ranked = rows.select(F.struct(*order).alias("rank"), "doc_id", "label", F.col("text").cast("binary").alias("text"))
    schema = f"rank {ranked.schema['rank'].dataType.simpleString()}, doc_id long, label double, x binary"
    sample = ranked.mapInArrow(pooled, schema).orderBy("rank").limit(max_labelled).select("doc_id", "label", "x").toArrow()
    x = np.array([np.frombuffer(b, dtype=np.float64) for b in sample.column("x").to_pylist()]).reshape(-1, dimensions + 2)
    y = sample.column("label").to_numpy()
    aside = np.array([xxhash.xxh32_intdigest(str(i)) % 5 == 0 for i in sample.column("doc_id").to_pylist()], dtype=bool)
    model.network = fit_network(x, y, aside)
    return model


def score_quality(
    df: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """The ``keep`` columns (all) plus ``score_col``, the probability that a text is good (NULL text is empty)."""
    kept = [c for c in (df.columns if keep is None else keep) if c != score_col]
    shared, buckets = df.sparkSession.sparkContext.broadcast(model), len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(buckets)
        for batch in slices(batches, 512):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = shared.value.network.probability(shared.value.features(tokens, texts))
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*kept, score_col])

    schema = T.StructType([df.schema[c] for c in kept]).add(score_col, T.DoubleType())
    return df.select(*[f"`{c}`" for c in kept], bytes_of(text_col).alias(fresh(df, "__utf8"))).mapInArrow(run, schema)


def is_held_out(column: str = "doc_id", modulus: int = 5) -> Column:
    """Whether the crc32 of the id as text is divisible by ``modulus`` (a NULL id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == 0


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose text scores at least ``threshold``."""
    score = fresh(df, "__quality")
    model = fit_quality(df, labels, ~is_held_out())
    return score_quality(df, model, score_col=score).filter(F.col(score) >= threshold).drop(score)


def op1_quality(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    scored = score_quality(docs, fit_quality(docs, labels, ~is_held_out()), keep=["doc_id"])
    return scored.select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
