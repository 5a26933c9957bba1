"""Five stages over the corpus: quality rules, toxicity, near duplicates, secrets, packing.

Each stage takes all its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from octavo.llm import jaccard_join, packing, quality_rules, secret_scan, toxicity
from octavo.llm.queries import END_ID, WINDOW, WORDS
from octavo.llm.shared import keep, parquet

#: SQL can't express the classifier, the tagger or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject, and without common lines in the others."""
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents; the chain learns from the labels of the documents at hand."""
    return toxicity.keep_clean(docs, parquet(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path(WORDS), WINDOW, END_ID))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good),
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("secret scans", redacted),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each one's result written and read again."""
    docs = parquet(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
