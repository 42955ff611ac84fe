"""A corpus from documents to packed sequences: quality, lines, near copies, source weights, packing.

Each stage takes all that its predecessor kept. Every stage but the last returns the columns of
documents, n_chars kept in step with the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import fresh, saved, scope, table
from cairn.llm.line_dedup import line_dedup
from cairn.llm.mixing import mixed_documents
from cairn.llm.near_dedup import one_of_each, with_group_sites
from cairn.llm.packing import pack_documents
from cairn.llm.quality import good_documents
from cairn.llm.queries import BOILERPLATE_SITES, WORD_TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    out = docs.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go out of the texts. A group of near copies counts as one site, or its own text would be boilerplate."""
    return _measured(line_dedup(with_group_sites(docs, "site__"), BOILERPLATE_SITES, site_col="site__"), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts hold the words that the mix takes, as often as it takes them."""
    return _measured(mixed_documents(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", source_weights), ("packing", packing)]

#: The classifier and the permutations have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        path = fresh(spark)
        # a stage's own tables go when its outcome is stored, and so does the outcome before it
        with scope(spark) as own:
            own += before
            docs = saved(stage(spark, docs, sf_dir), path, keep=True)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
