import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citylens.llm import divergence as D
from tests.llm.helpers import SCHEMA, empty_frame, odd_frame


def plain(rows, least_docs, top_terms):
    """``rows``: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = lambda t: re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t)
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)), lang, source) for t, lang, source in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for terms, lang, source in found:
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(key):
            total = sum(counts[key][t] for t in kept)
            return {t: 1 + 10**9 * (counts[key][t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares((lang, None))
        p = {s: shares((lang, s)) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", over)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(items, 1):
                    if part == "pair" or rank <= top_terms:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in D.divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed=2):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abÉéß") for _ in range(draw.randint(1, 4))) for _ in range(300)]
    rows = []
    for _ in range(250):
        lang = draw.choice(["en", "de", None])
        # one source holds most rows; equal texts in two sources
        source = draw.choice(["hot"] * 6 + ["s1", "s2", "ß", None, ""])
        text = " ".join(words[int(300 * draw.random() ** 3)] for _ in range(draw.randint(0, 40)))
        rows.append((text.upper() if draw.random() < 0.2 else text, lang, source))
    rows += [(None, "en", "s1"), ("", "fr", "alone"), ("1 2 3", "es", "x"), (None, "es", "y"), ("rare words only", "es", "z")]
    return rows + rows[:40]


@pytest.mark.parametrize("options", [{}, {"block": 16, "tile": 2}, {"block": 100, "tile": 1}])
def test_against_brute_force(spark, options):
    rows = corpus()
    assert run(spark, rows, least_docs=4, top_terms=7, **options) == plain(rows, 4, 7)


def test_no_kept_terms_and_no_rows(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), ("d", "en", "z")]
    got = run(spark, rows)
    assert got == plain(rows, 30, 50) and {r[4] for r in got} == {0}
    assert D.divergence(empty_frame(spark)).collect() == []
    assert run(spark, rows, least_docs=1) == plain(rows, 1, 50)


def test_flushing_and_odd_rows(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(D, "TERMS_HELD", 10)
    assert run(spark, rows, least_docs=4) == plain(rows, 4, 50)
    odd = D.divergence(odd_frame(spark).withColumnRenamed("text", "t"), text_col="t", least_docs=1)
    assert odd.filter("part = 'pair'").count() == 2


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 9 * 10**17, 9 * 10**18, 10**9
    got = spark.range(1).select(D.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)
