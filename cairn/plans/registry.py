"""Registered queries: a function over the driver's tables and, where SQL can express it, an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.operators.search import IndexOnDemand
from cairn.plans.fixtures import FIXTURES
from cairn.sources.store import scratch, stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_indexes: dict[tuple[str, str], IndexOnDemand] = {}
_batches: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


class Tables:
    """Driver tables and fixtures by name, as DataFrames; only those that a query names are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.held = spark, sf_dir, {}

    @property
    def search_index(self) -> IndexOnDemand:
        """The search documents' index, each table of it written by the first query of the session that asks for it."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _indexes:
            _indexes[key] = IndexOnDemand(self.search_documents, scratch(self.spark, "search"))
        return _indexes[key]

    @property
    def graph_batch(self) -> tuple[DataFrame, DataFrame]:
        """Facts in folders by kind, and evidence: stored by the first query of the session that projects them, as projectors read them many times."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _batches:
            _batches[key] = stored(self.graph_facts, "facts", "kind"), stored(self.graph_evidence, "evidence")
        return _batches[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in FIXTURES:
            raise AttributeError(name)
        if name not in self.held:
            sql = FIXTURES[name]
            self.held[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in _names(sql)})
        return self.held[name]


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def duckdb_sql(sql: str) -> str:
    """sql with fixtures it names, in braces, as leading common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in FIXTURES and name not in order:
            for n in _names(FIXTURES[name]):
                need(n)
            order.append(name)

    for n in _names(sql):
        need(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s).strip()
    body = plain(sql)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({plain(FIXTURES[n])})" for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


def query(sql: str | None = None):
    """Register a function of Tables under its own name, with its oracle."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            # <L> and <N> stand for braces of regex classes, which would name fixtures
            ORACLE[fn.__name__] = duckdb_sql(sql).replace("<L>", "{L}").replace("<N>", "{N}").replace("<32>", "{32}").replace("<o>", "{").replace("<c>", "}")
        return fn

    return register
