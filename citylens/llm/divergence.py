"""Source divergence audit over count-level bitmaps.

For every group (a source within a language) and every count that occurs
there, a bitset holds the terms that occur that often in the group.  Terms
are numbered within blocks, the frequent ones first, and a bitset is kept as
its non-zero 64-bit words.  A pair of groups is compared word by word: the
AND of two bitsets and its popcount give the terms with this count here and
that count there, whose contribution ``f`` depends on the two counts alone;
the terms a group lacks are the complement of its bitsets.  So a pair costs
one popcount per pair of levels and word instead of a look at every term.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citylens.llm._tables import bytes_of, documents, slices, stored, text_of

#: Letters A-Z and a-z and everything beyond ASCII; text is lower-cased (A-Z) before.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Terms a task counts before it hands them on, bits of a word of a bitset, terms of a block, sources of a tile.
TERMS_HELD = 400_000
WORD = 64
BLOCK = 4096
TILE = 32


def group_counts(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of every term in every group.

    Terms are maximal runs of letters A-Z, a-z and characters beyond ASCII, with A-Z lower-cased.  NULL text,
    language and source read as empty; every row is a document.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per group: occurrences and documents of its terms
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (occurrences, in_docs) in held.items():
                terms = list(occurrences)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array(list(occurrences.values()), pa.int64()), pa.array([in_docs[t] for t in terms], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        size = 0
        for batch in slices(batches, 256):
            columns = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
            for lang, source, text in zip(*columns):
                terms = _TERM.findall(text.translate(_LOWER))
                occurrences, in_docs = held[lang, source]
                size -= len(occurrences)
                occurrences.update(terms)
                in_docs.update(set(terms))
                size += len(occurrences)
                if size > TERMS_HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = df.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), bytes_of(text_col).alias("text"))
    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (n + 5) / (total + 5 terms))``, exact."""
    big = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (big(n) + 5), big(total) + big(terms) * 5) + 1


def _tile_sums(cell: pd.DataFrame) -> pd.DataFrame:
    """``(a, b, value)`` over the terms of one block, for the pairs of sources of a pair of tiles."""
    zero = cell[cell["chunk"] < 0].drop_duplicates("source").sort_values("source")
    sources = zero["source"].tolist()
    tiles, zero_share = zero["tile"].to_numpy(), zero["p"].to_numpy(np.int64)
    first, second, terms = int(cell["t1"].iloc[0]), int(cell["t2"].iloc[0]), int(cell["terms"].iloc[0])
    number = {s: i for i, s in enumerate(sources)}
    levels = cell[cell["chunk"] >= 0]
    owner = levels["source"].map(number).to_numpy(np.int64)
    chunk, bits = levels["chunk"].to_numpy(np.int64), levels["bits"].to_numpy(np.int64).view(np.uint64)
    shares = levels["p"].to_numpy(np.int64)
    sums = np.zeros((len(sources), len(sources)), dtype=np.int64)
    order = np.lexsort((owner, chunk))
    owner, chunk, bits, shares = owner[order], chunk[order], bits[order], shares[order]
    edges = np.searchsorted(chunk, np.arange(-(-terms // WORD) + 1))
    for c, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        width = min(WORD, terms - c * WORD)
        full = np.uint64(2**width - 1)
        # the terms a group lacks: the complement of its levels
        present = np.zeros(len(sources), dtype=np.uint64)
        np.bitwise_or.at(present, owner[lo:hi], bits[lo:hi])
        whose = np.concatenate([owner[lo:hi], np.arange(len(sources))])
        sets = np.concatenate([bits[lo:hi], full & ~present])
        p = np.concatenate([shares[lo:hi], zero_share])
        by_owner = np.argsort(whose, kind="stable")
        whose, sets, p = whose[by_owner], sets[by_owner], p[by_owner]
        starts = np.searchsorted(whose, np.arange(len(sources) + 1))
        for s in np.flatnonzero(tiles == first):
            mine = slice(starts[s], starts[s + 1])
            joint = np.bitwise_count(sets[mine, None] & sets[None, :]).astype(np.int64)
            f = np.abs(p[mine, None] - p[None, :])
            sums[s] += np.add.reduceat((joint * f).sum(axis=0), starts[:-1])
    a, b = np.meshgrid(np.arange(len(sources)), np.arange(len(sources)), indexing="ij")
    wanted = (tiles[a] == first) & (tiles[b] == second) & ((a < b) if first == second else True)
    names = np.array(sources, dtype=object)
    return pd.DataFrame({"lang": cell["lang"].iloc[0], "a": names[a[wanted]], "b": names[b[wanted]], "value": sums[a[wanted], b[wanted]]})


def divergence(
    df: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = 30,
    top_terms: int = 50,
    block: int = BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """How far apart the sources of a language are, and the terms each overuses.

    A language keeps the terms found in at least ``least_docs`` of its documents.  Every group, even one without
    terms, and the language itself give each kept term the share ``1 + floor(10^9 (n + 5) / (N + 5 V))``; ``f`` is
    the distance of two shares.  Rows ``(lang, source, part, item, value, rank)``: part ``pair`` has ``f`` against
    each other source summed over all kept terms, part ``term`` the ``top_terms`` terms of largest ``f`` that occur in
    the group with a larger share than in the language.  Ranks go by value, ties by the item's code points.

    NULL text, language and source read as empty; repeated rows count each; a language without kept terms has
    pairs of value 0; a language with one source has no pairs; no rows give an empty result.
    """
    # every (lang, source) that occurs, also without terms
    groups_seen = df.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    counts = stored(group_counts(df, lang_col, source_col, text_col), "divergence-counts")
    totals = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    terms = totals.filter(F.col("docs") >= least_docs).select("lang", "term", "total")
    terms = stored(terms, "divergence-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    # frequent terms first, so the levels of a word of a bitset are few
    blocks = F.greatest(F.ceil(F.col("v") / block), F.lit(1)).cast("int")
    numbered = terms.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int"))
    at = F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("total"), "term")) - 1
    # dealt by block: the join would leave the terms of a language in one task
    numbered = numbered.repartition("lang", "block").withColumn("at", at).select("lang", "term", "total", "v", "lang_n", "block", "at")
    kept = stored(counts.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "divergence-kept")

    # per group: N and the share of a term it lacks
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    tiles = F.greatest(F.ceil(F.col("sources") / tile), F.lit(1)).cast("int")
    per_lang = groups_seen.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    none = F.lit(0).cast("long")
    groups = (
        groups_seen.join(sizes, ["lang", "source"], "left")
        .join(langs.select("lang", "v"), "lang", "left")
        .join(per_lang, "lang")
        .select(
            "lang", "source", F.coalesce("group_n", none).alias("group_n"), F.coalesce("v", none).alias("v"),
            tiles.alias("tiles"), F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile"),
        )
    )
    groups = stored(groups, "divergence-groups")
    lacking = F.when(F.col("v") > 0, share(none, F.col("group_n"), F.col("v"))).otherwise(none)
    zero = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("v") / block), F.lit(1)) - 1)))
    in_block = numbered.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("terms"))
    zero = zero.select(
        "lang", "source", F.col("block").cast("int").alias("block"), "tile", "tiles", lacking.alias("p"),
        F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("bits"),
    )
    # the bitsets: one row per (group, count) and non-zero word
    levels = kept.groupBy(
        "lang", "source", "block", "n", F.floor(F.col("at") / WORD).cast("int").alias("chunk")
    ).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % WORD).cast("int"))).alias("bits"))
    levels = levels.join(groups, ["lang", "source"]).select(
        "lang", "source", "block", "tile", "tiles", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), "chunk", "bits"
    )
    cells = levels.unionByName(zero).join(in_block, ["lang", "block"], "left").withColumn("terms", F.coalesce("terms", none))
    # a cell has the sources of two tiles: a source's rows go to every pair of tiles that has its own
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    cells = cells.select("*", other).withColumn("t1", F.least("tile", "other")).withColumn("t2", F.greatest("tile", "other"))
    sums = cells.groupBy("lang", "block", "t1", "t2").applyInPandas(_tile_sums, "lang string, a string, b string, value long")
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = pairs.select("lang", "value", F.inline(both)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    over = kept.join(groups.select("lang", "source", "group_n"), ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (share(F.col("n"), F.col("group_n"), F.col("v")) - share(F.col("total"), F.col("lang_n"), F.col("v"))).alias("value"),
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda part: part.withColumn("rank", F.row_number().over(order))
    best = ranked(over.filter("value > 0")).filter(F.col("rank") <= top_terms)
    return ranked(pairs).unionByName(best)


def op12_divergence(spark, sf_dir):
    return divergence(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS MATERIALIZED (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, k.total, l.v, l.lang_n, coalesce(c.n, 0) AS n,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS group_n
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
       LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (
  SELECT *, 1 + 1000000000 * (n + 5) // (group_n + 5 * v) AS p, 1 + 1000000000 * (total + 5) // (lang_n + 5 * v) AS q FROM cells),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source
       LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
