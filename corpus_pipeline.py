"""The corpus pipeline: five stages, each a written table that the next one reads.

Defined results: documents with a null or empty text, or without a letter, go in the first stage; without any labelled document
that stage judges none and keeps all.  Of rows with one ``doc_id`` the second stage keeps one; rows without ``doc_id`` are
documents of their own there, lose passages never, and stay unless contaminated.  A null source is a source, a null language no label.  An
empty table gives an empty mix, an empty benchmark contaminates nothing.  Extra columns pass to the last stage, which returns
``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken``; names that begin with ``_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontamination, language_id, mixing, near_dedup, substring_dedup
from barloom.llm.steps import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language can't be told, go."""
    return language_id.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return near_dedup.deduplicated(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that a document with a smaller id has are cut out of the text."""
    return substring_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mixture_report(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
ORACLE_SQL = None  # a trained model and a schedule have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
