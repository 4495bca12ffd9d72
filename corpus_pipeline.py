"""The training-data pipeline: five stages, each written as Parquet and read again by the next.

language_id: documents in no learned language, or too uncertain, go.
near_dedup: of each group of near copies (0.8 of their five-word shingles or more) the first document stays.
decontamination: documents that hold a benchmark item go.
pii: personal data in the texts is replaced by its kind in brackets.
packing: the documents are laid into batches of a token budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.llm.decontaminate import without_contaminated
from payscope.llm.langid import accepted, fit_model
from payscope.llm.packing import pack_documents
from payscope.llm.pii import redact
from payscope.llm.shared import materialize, read_table
from payscope.llm.simhash import without_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is predicted with enough certainty; learns from their own labels."""
    return accepted(docs, fit_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest doc_id.

    Near copies share 0.8 or more of their five-word shingles; SimHashes and their pigeonhole plan find the candidates.
    """
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no item of ``benchmark``."""
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; replaces the personal data in their texts and counts their characters anew."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document: (doc_id, n_tokens, bucket, padded_tokens, batch, slot)."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Learned models and links of links have no SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
