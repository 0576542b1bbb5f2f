"""A corpus pipeline: quality, near-duplicates, secrets, source mix, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that
is written as Parquet and read again as the next stage's ``docs``.  All but
the last return the columns of the documents they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citylens.llm import bpe, mixture, quality, secrets, simhash
from citylens.llm._tables import documents, stored
from citylens.session import scratch_path


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier gives at least the threshold stay.

    The network is fitted on the labelled rows of ``docs`` that are not held out.
    NULL text is scored as empty text; rows that repeat are judged alike; an
    empty table stays empty.
    """
    return quality.keep_good(docs, documents(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of fingerprints linked at 3 or fewer bits stays, that of the smallest id.

    NULL and empty texts share the fingerprint zero, so one of them stays; of
    rows that repeat one stays; an empty table stays empty.
    """
    return simhash.keep_first(docs, shingle=3, distance=3)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets found in it are masked and ``n_chars`` follows.

    NULL and empty texts stay as they are, rows that repeat stay repeated, an
    empty table stays empty.
    """
    return secrets.redact_secrets(docs, scratch_path(spark, "pipeline-secret-ledger"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0 to 3) as the mix takes it.

    NULL text has no words and NULL is a source of its own; a source without
    words is not taken; rows that repeat are drawn one by one; an empty table
    stays empty.
    """
    return mixture.take_copies(docs)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source`` and the byte-level BPE ids of each document, with a check of the decoded bytes.

    NULL and empty texts have no ids; rows that repeat each give a row; an
    empty table stays empty.
    """
    encoded = bpe.encode_texts(docs, bytes_col="decoded", keep=["doc_id", "source", "text"])
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_ids),
]

#: The classifier, the fingerprints and the draw cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to shared storage and read again."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"pipeline-{number}")
    return docs
