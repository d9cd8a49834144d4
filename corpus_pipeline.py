"""The corpus pipeline: raw documents to deduplicated, mixed and encoded ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ropeway.llm import bpe, chosen, exact, langid, mixing
from ropeway.llm.base import query, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language that is at least as likely as all others.

    Models are fitted on the labelled rows of ``docs`` itself.  NULL and empty texts
    go; NULL ids, repeated rows and extra columns stay as they are; an empty table
    stays empty.
    """
    return langid.accepted(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts; see ``exact.deduplicated`` for the cases."""
    return exact.deduplicated(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates; see ``chosen.near_duplicates`` for the cases."""
    return chosen.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by source weight, one row for each time; see ``mixing.materialised`` for the cases."""
    return mixing.mixed(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every drawn row; see ``bpe.encode`` for the cases."""
    return bpe.round_trip(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", encoded),
]

#: SQL can express neither the language models nor the encoding.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
