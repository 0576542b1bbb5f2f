"""Mixing sources to target weights by the cube method.

Every source gets a target number of words (water-filling of its weight's
share, at most ``max_repeat`` times its own size).  Each document is taken
``floor(r)`` times, ``r = target / size of the source``, and once more with
probability ``frac(r)``.  The extra ones are drawn by the cube method: the
inclusion probabilities move along the null space of the balancing
constraints (number of documents, number of words), so both totals stay
exactly as planned until only two undecided documents are left.

The flight runs in blocks of bounded size, so that a source that holds a
third of all rows is many tasks; the few undecided documents of the blocks
fly on together, level by level, until one block per source is left, whose
last documents land (the document count is given up first, then the words).
A block's documents fly from the largest to the smallest, so that what is
left for the landing is small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citylens.llm._tables import WORD_CLASS, documents, slices, stored, text_of

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Documents of one block of the flight.
BLOCK_ROWS = 1024
#: Undecided documents in hand at a time; a block may be larger (rows that repeat share a block).
IN_HAND = 1024
#: Of the words the others can move at landing, a larger share for one document gives up the number of documents.
HEAVY_SHARE = 0.25
EPS = 1e-9


def word_count(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD_CLASS + "+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``(source, n_docs, source_size, target)`` from rows of ``(source, size)``.

    Weights repeat over the sources in code-point order, NULL last.  The
    targets sum to all words; a target above ``max_repeat`` times its source
    is cut there and the excess is shared by weight among the others until
    none is above.  One row per source passes a single-partition window.
    """
    per_source = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighted = per_source.withColumn(
        "weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights))
    ).withColumn("cap", F.col("source_size") * float(max_repeat))
    # In the order in which sources fill up, one is full if the water level reached without it would overflow it.
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        weighted.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("words_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("full", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("words_left"))
    )
    level = (F.max("total").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))) / (
        F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)
    return filled.select("source", "n_docs", "source_size", target.alias("target"))


class _Flight:
    """The flight phase of one block, whose documents come largest first.

    At most ``in_hand`` documents are undecided at a time.  Each step settles
    the largest of them as far as the others can make up for it: it moves by
    one, and the others by the share of the opposite move that their
    probabilities leave room for, so that documents and words stay as they
    are.  Large documents are thus decided while there are others to balance
    them, and small ones are left for the landing.
    """

    def __init__(self, seed: int, in_hand: int = IN_HAND) -> None:
        self.random = np.random.Generator(np.random.PCG64(seed))
        self.in_hand = in_hand
        self.rows: list[int] = []
        self.size, self.chance = np.zeros(0), np.zeros(0)

    def add(self, row: int, size: float, chance: float) -> list[tuple[int, int]]:
        """Take one document in hand; the documents decided by it as (row, 0 or 1)."""
        if not EPS <= chance <= 1 - EPS:
            return [(row, int(chance > 0.5))]
        self.rows.append(row)
        self.size, self.chance = np.append(self.size, size), np.append(self.chance, chance)
        decided = []
        while len(self.rows) > self.in_hand:
            direction = self._direction()
            if direction is None:
                break
            decided += self._move(direction)
        return decided

    def _direction(self, words_only: bool = False) -> np.ndarray | None:
        """A vector of the null space of (number, words), or of words alone, over the documents in hand."""
        if len(self.rows) < 2:
            return None
        scale = self.size[0]
        if scale <= 0:
            return self._among(0)
        x = self.size / scale
        room = self.chance * (1 - self.chance)
        room[0] = 0.0
        n, first, second = room.sum(), room @ x, room @ (x * x)
        if words_only:
            others = room * x / second if second > 0 else None
        elif x[-1] == 1.0:
            return self._among(0)
        elif x[1] == x[-1]:  # the others are of one size, which cannot balance this one
            return self._among(1) if len(x) > 2 else None
        else:
            spread = n * second - first * first
            others = room * ((second - first) + (n - first) * x) / spread if spread > EPS * n * second else None
            if others is None:
                return self._among(1)
        if others is None:
            return None
        direction = -others
        direction[0] = 1.0
        return direction

    def _among(self, lead: int) -> np.ndarray:
        """The document at ``lead`` against the later ones of its size."""
        same = (self.size == self.size[lead]) & (np.arange(len(self.size)) > lead)
        if not same.any():  # sizes too close to be told apart by the sums: the two next ones and the last
            a, b, c = self.size[lead], self.size[lead + 1], self.size[-1]
            direction = np.zeros(len(self.size))
            direction[lead], direction[lead + 1], direction[-1] = (b - c) / (a - c), -1.0, (a - b) / (a - c)
            return direction
        room = np.where(same, self.chance * (1 - self.chance), 0.0)
        direction = -room / room.sum()
        direction[lead] = 1.0
        return direction

    def _move(self, direction: np.ndarray, rise: bool | None = None) -> list[tuple[int, int]]:
        """One step along ``direction``, up (``rise``), down or, by default, drawn so that chances are kept."""
        moving = np.flatnonzero(direction)
        u, p = direction[moving], self.chance[moving]
        up = np.where(u > 0, 1 - p, p) / np.abs(u)
        down = np.where(u > 0, p, 1 - p) / np.abs(u)
        high, low = up.argmin(), down.argmin()
        if rise is None:
            rise = bool(self.random.random() * (up[high] + down[low]) < down[low])
        step, stop = (up[high], high) if rise else (-down[low], low)
        self.chance[moving] = np.clip(p + step * u, 0.0, 1.0)
        self.chance[moving[stop]] = float((u[stop] > 0) == rise)
        return self._settled()

    def _settled(self) -> list[tuple[int, int]]:
        done = (self.chance < EPS) | (self.chance > 1 - EPS)
        decided = [(self.rows[i], int(self.chance[i] > 0.5)) for i in np.flatnonzero(done)]
        self.rows = [row for row, d in zip(self.rows, done.tolist()) if not d]
        self.size, self.chance = self.size[~done], self.chance[~done]
        return decided

    def finish(self) -> list[tuple[int, int]]:
        """Fly on until at most two documents are undecided."""
        decided = []
        while len(self.rows) > 1 and (direction := self._direction()) is not None:
            decided += self._move(direction)
        return decided

    def _heavy(self) -> bool:
        """Whether the largest document needs much of what the others can still make up for."""
        p = self.chance
        movable = self.size[1:] @ np.minimum(p[1:], 1 - p[1:])
        return self.size[0] * max(p[0], 1 - p[0]) > HEAVY_SHARE * movable

    def _only_way(self) -> bool | None:
        """Up (True) or down, if the others can make up for the largest document's words in one of the two only."""
        lead, others, p = self.size[0], self.size[1:], self.chance
        up = others @ p[1:] >= lead * (1 - p[0])
        down = others @ (1 - p[1:]) >= lead * p[0]
        return bool(up) if up != down else None

    def land(self) -> list[tuple[int, int]]:
        """Decide what is left: the number of documents is given up first, then the words.

        A document that the others can make up for in one way only goes that way.
        """
        decided = []
        while self.rows:
            direction, way = (None, self._only_way()) if self._heavy() else (self._direction(), None)
            if direction is None:
                direction = self._direction(words_only=True)
            if direction is None:
                self.chance[0] = float(self.random.random() < self.chance[0])
                decided += self._settled()
            else:
                decided += self._move(direction, way)
        return decided


def _fly(rows: DataFrame, level: int) -> DataFrame:
    """One level of the flight over rows sorted into blocks; ``extra`` is 0/1, or NULL where still undecided.

    A source's only block (``land``) leaves nothing undecided.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, block, lands, held = None, None, False, None

        def close() -> list[tuple[int, int | None, float]]:
            if flight is None:
                return []
            decided = [(row, extra, 0.0) for row, extra in (flight.land() if lands else flight.finish())]
            return decided + [(row, None, p) for row, p in zip(flight.rows, flight.chance.tolist())]

        def emit(table: pa.Table, decided: list[tuple[int, int | None, float]]) -> Iterator[pa.RecordBatch]:
            out = table.take(pa.array([row for row, _, _ in decided], pa.int64()))
            columns = {n: out.column(n) for n in out.column_names}
            columns["extra"] = pa.array([extra for _, extra, _ in decided], pa.int32())
            columns["pi"] = pa.array([p for _, _, p in decided], pa.float64())
            yield from pa.table(columns).combine_chunks().to_batches()

        for batch in slices(batches):
            # rows in hand move to the front of the table of this batch
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
                flight.rows = list(range(held.num_rows))
            first = table.num_rows - batch.num_rows
            decided: list[tuple[int, int | None, float]] = []
            columns = [batch.column(c).to_pylist() for c in ("source", "block", "size", "pi", "land")]
            for i, (source, number, size, chance, only) in enumerate(zip(*columns), start=first):
                if flight is None or block != (source, number):
                    decided += close()
                    block, lands = (source, number), only
                    flight = _Flight(xxhash.xxh64_intdigest(repr((level, block))))
                decided += [(row, extra, 0.0) for row, extra in flight.add(i, float(size), chance)]
            if decided:
                yield from emit(table, decided)
            held = table.take(pa.array(flight.rows, pa.int64())) if flight and flight.rows else None
        if held is not None:
            flight.rows = list(range(held.num_rows))
            yield from emit(held, close())

    return rows.mapInArrow(run, rows.schema)


def _blocks(rows: DataFrame, counts: DataFrame, level: int, block_rows: int) -> DataFrame:
    """Deal the rows of each source into blocks by content, whole blocks to a task, in a fixed order."""
    n_blocks = F.ceil(F.col("n_rows") / block_rows)
    dealt = (
        rows.join(counts, F.col("source").eqNullSafe(F.col("count_source")))
        .withColumn("block", F.pmod(F.xxhash64("row_hash", F.lit(level)), n_blocks).cast("long"))
        .withColumn("land", n_blocks <= 1)
        .select(*rows.columns)
    )
    return dealt.repartition("source", "block").sortWithinPartitions("source", "block", F.desc("size"), "row_hash")


def mix_sources(
    df: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_cols: Sequence[str] = ("doc_id",),
    carry: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = WEIGHTS,
    max_repeat: float = MAX_REPEAT,
    block_rows: int = BLOCK_ROWS,
    keep_sizes: bool = True,
) -> DataFrame:
    """The ``carry`` columns of every row with ``size``, ``source_size``, ``target`` and ``copies`` (0..max_repeat).

    The draw depends on the rows' contents alone (``id_cols``, source, text),
    not on how they are partitioned.  NULL text counts as empty, NULL is a
    source of its own, a source without words has target 0; an empty table
    gives an empty result.  Equal rows share a block and are drawn one by one.
    ``keep_sizes=False`` counts the words twice instead of writing the carried
    columns with their sizes first (for wide rows).
    """
    ids = [F.col(f"`{c}`") for c in id_cols]
    fields = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")]
    sized = df.select(
        *fields,
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text_col).alias("size"),
        F.xxhash64(*ids, F.col(f"`{source_col}`"), text_of(text_col)).alias("row_hash"),
    )
    if keep_sizes:
        sizes = sized = stored(sized, "mix-sizes")
    else:
        sizes = stored(sized.select("source", "size"), "mix-sizes")
    targets = stored(source_targets(sizes, weights, max_repeat).coalesce(1), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.withColumnRenamed("source", "count_source")
    start = (
        sized.join(t, F.col("source").eqNullSafe(F.col("count_source")))
        .withColumn("base", F.floor(ratio + EPS).cast("int"))
        .withColumn("pi", F.greatest(ratio - F.col("base"), F.lit(0.0)))
        .select("row", "source", "size", "row_hash", "source_size", "target", "base", "pi",
                F.lit(None).cast("int").alias("extra"), F.lit(0).cast("long").alias("block"), F.lit(False).alias("land"))
    )
    counts = targets.select(F.col("source").alias("count_source"), F.col("n_docs").alias("n_rows"))
    rows, level, decided = start, 0, []
    while True:
        largest = counts.agg(F.max("n_rows")).first()[0]
        last = largest is None or largest <= block_rows
        flown = stored(_fly(_blocks(rows, counts, level, block_rows), level), f"mix-level{level}")
        decided.append(flown.filter("extra IS NOT NULL"))
        if last:
            break
        rows = flown.filter("extra IS NULL")
        counts = stored(
            rows.groupBy(F.col("source").alias("count_source")).agg(F.count("*").alias("n_rows")), f"mix-left{level}"
        )
        level += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.col("extra")).cast("int").alias("copies")
    return out.select(*[F.col("row").getField(c).alias(c) for c in carry], "size", "source_size", "target", copies)


def take_copies(
    df: DataFrame, text_col: str = "text", source_col: str = "source", id_cols: Sequence[str] = ("doc_id",), **options
) -> DataFrame:
    """The mix as rows: every row of ``df``, with its columns, as many times as it is taken."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")
    names = {text_col: "mix_text", source_col: "mix_source", **{c: f"mix_id{i}" for i, c in enumerate(id_cols)}}
    rows = df.select(whole, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    mixed = mix_sources(
        rows, "mix_text", "mix_source", [names[c] for c in id_cols], carry=["doc"], keep_sizes=False, **options
    )
    taken = mixed.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col("doc").getField(c).alias(c) for c in df.columns])


def op8_cube_mixture(spark, sf_dir):
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )
