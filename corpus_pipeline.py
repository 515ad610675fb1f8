"""The corpus pipeline: five stages from the documents table to packed training sequences.

Every stage takes what the one before has kept, and its decisions take effect: rejected documents go, lines and personal
data are taken out of the texts, and one document of each near-duplicate group stays. Between stages the rows are
written to the folder that all executors share, so a lost executor never repeats a stage.

Defined cases, for every stage: an empty table gives no rows; columns beyond those of documents, whatever their names, pass
through to the last stage and are ignored by it; ties go to the smaller doc_id. A null or empty text fails the quality rules
and goes there (alone, the later stages take it as empty: no language, so it goes; one near-duplicate class; no personal
data; an end id). A null source is a host of its own. Exact repeats of a row are kept by the first two stages and are one
row after the third; rows that share a doc_id with different texts are separate documents. A null doc_id never trains a
model, and such a document stays unless its near-duplicate group holds one with an id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import language_id, near_copies, packing, pii, quality_rules
from tidelane.llm.shared import read_table, written


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``rows``, whose text may have changed; n_chars follows it."""
    return rows.select([F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go; lines above their host's limit are taken out of the rest."""
    return _with_text(docs, quality_rules.keep(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents without a language, or with an unsure one, go."""
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups of five-word shingle similarity 0.8 and more: the document with the smallest doc_id of each stays."""
    return near_copies.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: each span gives way to its kind in brackets."""
    return _with_text(docs, pii.redact(docs, pii.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: Language identification, the trees and both encoders are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
