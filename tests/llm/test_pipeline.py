import base64
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from citylens.llm import bpe, mixture, quality
from tests.conftest import SF001
from tests.llm.helpers import SCHEMA, empty_frame, odd_frame, odd_rows, write_tables
from tests.llm.test_mixture import plain_targets
from tests.llm.test_secrets import plain
from tests.llm.test_simhash import plain_components, plain_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out, written and read like the pipeline does."""
    folder, docs = tmp_path_factory.mktemp("stages"), C.documents(spark, SF001)
    tables = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF001).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        tables.append(docs)
    return tables


def test_columns(stages):
    assert all(t.columns == COLUMNS for t in stages[:-1])


def test_quality_stage_keeps_what_scores(spark, stages):
    docs, kept = stages[0], stages[1]
    labels = C.documents(spark, SF001, "labels")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels, ~quality.is_held_out()))
    want = {r.doc_id for r in scored.filter("score >= 0.3").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good & want) >= 0.97 * len(good)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    groups = plain_components([d for d, _ in rows], [plain_print(t) for _, t in rows])
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(groups))


def test_secrets_are_masked(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for d, r in after.items():
        text, want, at = before[d].text, "", 0
        for start, _, end, _ in plain(text):
            if start >= at:
                want += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert r.text == want + text[at:] and r.n_chars == len(r.text)
    assert any("[SECRET]" in r.text for r in after.values()) == any(plain(r.text) for r in before.values())


def test_mix_meets_its_targets(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before, after = stages[3].collect(), stages[4].collect()
    sizes, taken = {}, {}
    for rows, sums in ((before, sizes), (after, taken)):
        for r in rows:
            sums[r.source] = sums.get(r.source, 0) + size(r.text)
    largest = max(size(r.text) for r in before)
    targets = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - t) <= largest for s, t in targets.items())
    counts = {}
    for r in after:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= mixture.MAX_REPEAT


def test_ids_equal_the_library(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    out = stages[5].collect()
    assert len(out) == stages[4].count() and all(r.round_trip for r in out)
    assert all(list(r.ids) == library.encode_ordinary(texts[r.doc_id]) for r in out)


def test_run_gives_the_last_stage(spark, stages):
    got = {tuple([r.doc_id, *r.ids]) for r in C.run(spark, SF001).collect()}
    assert got == {tuple([r.doc_id, *r.ids]) for r in stages[5].collect()}


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_every_stage_takes_odd_tables(spark, tmp_path, rows):
    docs = odd_frame(spark) if rows == "odd" else empty_frame(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    sf = write_tables(tmp_path, documents=docs, labels=labels)
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs, sf).count() <= 3 * len(odd_rows())
    out = C.run(spark, sf)
    assert out.filter(~F.col("round_trip")).count() == 0
    assert SCHEMA.names == COLUMNS
