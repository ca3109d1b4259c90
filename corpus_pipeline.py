"""A corpus run over ``documents``: stages that are written and read again.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and
returns the documents that it keeps, with all their columns; the last returns a
row for each token piece with its sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from honeyframe.llm.common import Written, documents, rows_of
from honeyframe.llm.exact_dedup import keep_one
from honeyframe.llm.language import keep_languages
from honeyframe.llm.packing import pack_documents
from honeyframe.llm.queries import vocabulary
from honeyframe.llm.setsketch import near_duplicates
from honeyframe.llm.ship import ship


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: texts without a letter go, and those that no
    language explains better than all others together."""
    ship(spark)
    return keep_languages(docs, vocabulary("piece_bpe_32k.model"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship(spark)
    return keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by shared five-word shingles,
    at a similarity of 0.80 or more: the one with the smallest id."""
    ship(spark)
    kept = near_duplicates(docs, percent=80).where("kept").select("doc_id").distinct()
    return rows_of(docs, kept, "doc_id")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    ship(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("language", with_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: Two stages have no SQL form; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; every stage's rows are written below the checkpoints."""
    store, docs = Written(spark), documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = store.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
