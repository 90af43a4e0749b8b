"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, then tokenizer samples.

Each stage works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from impactgraph.llm import decontam, exact_dedup, quality, queries, segment, simhash
from impactgraph.llm.common import discard, materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on docs, does not reject; null and empty texts are judged like any other, repeated rows alike."""
    return quality.keep_good(docs)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id, any id before a null one; null and empty are equal. The index is the run's own."""
    index = queries.new_index(spark)
    kept = exact_dedup.drop_exact_copies(docs, index)
    index.drop()
    return kept


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id, any id before a null one; repeated rows are one group."""
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out; those that are mostly benchmark go. Null texts stay null."""
    return decontam.remove_contamination(docs, queries.table(spark, sf_dir, "benchmark"))


def tokenizer_samples(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document that is left; a null or empty text has one, of no piece."""
    return queries.segment_digests(segment.sample_segmentations(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("exact_dedup", without_exact_copies),
    ("simhash", without_near_copies),
    ("decontaminate", without_benchmark),
    ("segment", tokenizer_samples),
]

#: SimHash and sampling have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(before)  # the stage's result is written; documents themselves stay
    return STAGES[-1][1](spark, docs, sf_dir)
