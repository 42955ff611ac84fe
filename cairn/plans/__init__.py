"""Queries over the driver's tables, one per operator of the survey."""

from cairn.plans import code, graph, ingest, knowledge, ops, search, sources
from cairn.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "code", "graph", "ingest", "knowledge", "ops", "search", "sources"]
