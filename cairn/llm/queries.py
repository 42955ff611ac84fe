"""Queries over the driver's tables: one opN_<name> per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import table
from cairn.llm.exact_dedup import exact_dedup
from cairn.llm.fill_middle import fill_digest, fill_in_middle
from cairn.llm.fingerprint import document_fingerprints
from cairn.llm.hard_negatives import hard_negatives
from cairn.llm.license_scan import license_digest, license_scan
from cairn.llm.line_dedup import line_dedup
from cairn.llm.mixing import mix_sources
from cairn.llm.near_dedup import near_dedup
from cairn.llm.packing import pack_documents
from cairn.llm.quality import quality_scores
from cairn.llm.secret_scan import secret_digest, secret_scan
from cairn.llm.token_count import token_counts
from cairn.llm.vector_search import top_k_search

#: Tokenizer files of the production queries; operators take a path.
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
#: A line is boilerplate from as many distinct sources on.
BOILERPLATE_SITES = 10


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(license_scan(table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), BOILERPLATE_SITES).select("doc_id", "n_lines", "n_removed", "text")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_TOKENIZER))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_scan(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    own = own.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(own, own.filter("vec_id % 100 = 0"))


def op12_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    return top_k_search(own, own.filter("vec_id % 50 = 0"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_digest(fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_exact_dedup, op3_line_dedup, op4_document_fingerprints, op5_packing, op6_token_counts, op7_secret_scan, op8_mixing, op9_near_dedup, op10_quality, op11_hard_negatives, op12_top_k_search, op13_fill_in_middle)
}
