"""The corpus pipeline: documents in, packed sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. Stages 1 to 4 return the columns of documents, the last the pieces of the packed sequences.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from kilnbase.llm import common, langid, ngram_join, packing, pii, quality

#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None
CAPACITY = 2048
END_ID = 0
#: Bytes for remembered words in a worker: less than the operator's own, as the workers have served other stages.
ROOM = 48 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, whose language cannot be told, go."""
    common.bound_batches(spark)
    return langid.keep_identified(docs)


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go."""
    common.bound_batches(spark)
    return quality.keep_selected(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal spans are masked in the text."""
    common.bound_batches(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token runs of all documents, packed into sequences."""
    return packing.pack_documents(spark, docs, vocabulary(), CAPACITY, END_ID, ROOM)


def vocabulary() -> str:
    """Path of the tokenizer file; KILNBASE_TOKENIZER names another."""
    import public_tokenizers

    return os.environ.get("KILNBASE_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


STAGES = [
    ("language_id", identify_language),
    ("quality", select_quality),
    ("ngram_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each but the last returns is a table in the shared folder."""
    common.bound_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
