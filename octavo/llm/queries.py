"""The corpus queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, license_scan, packing, piece_tokens, quality_rules, secret_scan, token_counts, token_files, toxicity, vector_links
from .shared import parquet

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
WINDOW, END_ID = 2048, 1


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path(WORDS), WINDOW, END_ID))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    return token_counts.length_histogram(token_counts.encoded_lengths(docs, public_tokenizers.path(WORDS)))


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_vectors(parquet(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(license_scan.as_files(parquet(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(parquet(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    return token_files.read_tokens(token_files.write_tokens(docs, public_tokenizers.path(WORDS), END_ID))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(parquet(spark, sf_dir, "documents")).drop("key")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(parquet(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    return piece_tokens.encode_pieces(docs, public_tokenizers.path(PIECES), whole=False)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_vector_links": op3_vector_links,
    "op4_license_scan": op4_license_scan,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_files": op7_token_files,
    "op8_quality_rules": op8_quality_rules,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_sentencepiece": op10_sentencepiece,
}

#: For the queries that SQL can express.
ORACLES: dict[str, str] = {"op4_license_scan": license_scan.SQL, "op8_quality_rules": quality_rules.SQL}
