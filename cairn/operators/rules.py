"""Constraints as data quality: each rule returns the rows that break it, and only the driver decides to fail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Ceilings of the stages, checked before work is published."""

    files: int = 100_000
    file_bytes: int = 2 * 1024 * 1024
    total_bytes: int = 512 * 1024 * 1024
    path_length: int = 1_024
    path_depth: int = 64
    symbols_per_file: int = 10_000
    dependencies_per_file: int = 20_000
    source_bytes: int = 512 * 1024 * 1024
    facts_per_file: int = 20_000
    diagnostics_per_file: int = 1_000
    tokens_per_file: int = 200_000
    property_bytes: int = 16_384
    architecture_symbols: int = 250_000
    architecture_files: int = 100_000
    architecture_dependencies: int = 500_000
    architecture_outputs: int = 500_000
    workflows: int = 10_000
    workflow_steps: int = 100_000
    steps_per_workflow: int = 1_000
    search_documents: int = 1_000_000
    document_bytes: int = 131_072
    content_bytes: int = 256 * 1024 * 1024
    query_length: int = 200
    results_per_page: int = 100
    graph_seeds: int = 10
    neighbours_per_seed: int = 5
    graph_candidates: int = 50

    def __post_init__(self) -> None:
        bad = [k for k, v in vars(self).items() if v < 1]
        if bad:
            raise ValueError(f"limits must be positive: {', '.join(bad)}")


def measured(df: DataFrame, scope: str | None = None, **sizes: Column) -> DataFrame:
    """scope, limit and value of each of sizes for each row of df (for the whole of it without a scope, sizes being aggregates): one pass for all."""
    every = F.array(*[F.struct(F.lit(name).alias("limit"), value.cast("long").alias("value")) for name, value in sizes.items()])
    if scope is None:
        return df.agg(every.alias("x")).select(F.lit(None).cast("string").alias("scope"), F.explode("x").alias("x")).select("scope", "x.*")
    return df.select(F.col(scope).cast("string").alias("scope"), F.explode(every).alias("x")).select("scope", "x.*")


def exceeded(measures: DataFrame, limits: Limits) -> DataFrame:
    """Measures (scope, limit, value) beyond their limit, with it as most; an unknown limit is a mistake of the caller."""
    most = F.create_map(*[F.lit(x) for pair in vars(limits).items() for x in pair])
    known = F.when(most[F.col("limit")].isNull(), F.raise_error(F.concat(F.lit("no such limit: "), F.col("limit")))).otherwise(most[F.col("limit")])
    return measures.withColumn("most", known.cast("long")).filter(F.col("value") > F.col("most"))


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """Rows with the names of the rules they break; a rule is what must hold, null breaks it. One pass over df for all rules."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def shape() -> Column:
    """Which references a search document of each type has."""
    has = lambda c: F.col(c).isNotNull()
    file, symbol, node = has("indexed_file_id"), has("code_symbol_id"), has("knowledge_node_id")
    return F.when(F.col("source_type") == "file", file & ~symbol & ~node).when(F.col("source_type") == "symbol", file & symbol & ~node).when(F.col("source_type") == "knowledge_node", node & ~symbol & ~file).otherwise(False)


def blank(c: str) -> Column:
    return F.length(F.trim(F.col(c))) == 0


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def out_of_scope(rows: DataFrame, owner: DataFrame, reference: str, scope: list[str]) -> DataFrame:
    """Rows whose reference is no row of owner (id) in the same scope."""
    own = owner.select(F.col("id").alias("o_"), *[F.col(c).alias(f"s_{c}") for c in scope])
    met = rows[reference] == own["o_"]
    for c in scope:
        met = met & (rows[c] == own[f"s_{c}"])
    return rows.filter(F.col(reference).isNotNull()).join(own, met, "left_anti")
