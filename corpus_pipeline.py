"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

language ID drops texts whose language it rejects; near-dedup keeps one document of each group; decontamination
drops documents that hold a benchmark passage; personal data is masked; packing returns the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm import decontaminate, language_id, near_dedup, packing, pii, token_files
from traceframe.llm.common import stored, table
from traceframe.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no language (null, or without letters). A null ``lang`` becomes the predicted one.

    Decided text by text, so the prediction travels with its row and nothing is joined.
    """
    ship(spark)
    return language_id.annotate(docs, language_id.fit(language_id.training_rows(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    ship(spark)
    return near_dedup.keep_one(docs, near_dedup.near_groups(docs, width=5, percent=80))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 or more of a benchmark passage's five-word shingles."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data, plain or disguised; every document stays."""
    ship(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs, token_files.default_tokenizer(), end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate_stage),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express the language model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
