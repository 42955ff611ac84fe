"""Closed vocabularies, in declaration order: the position is the sort ordinal of an enumerated column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SOURCE_TYPES = ("file", "symbol", "knowledge_node")
NODE_KINDS = ("architectural_component", "domain_concept", "business_rule", "workflow", "workflow_step", "state", "state_transition", "domain_event", "event_handler")
EDGE_KINDS = ("contains", "depends_on", "calls", "handles", "represents", "enforces", "triggers", "precedes", "transitions_to")
JOB_STATUSES = ("queued", "running", "succeeded", "failed", "cancelled")
SOURCE_LANGUAGES = {"ts": ("typescript", "parser_supported"), "tsx": ("typescript", "parser_supported"), "js": ("javascript", "parser_supported"), "jsx": ("javascript", "parser_supported"), "json": ("json", "inventory_only"), "md": ("markdown", "inventory_only"), "yaml": ("yaml", "inventory_only"), "yml": ("yaml", "inventory_only")}
IGNORED_DIRECTORIES = (".git", "build", "coverage", "dist", "node_modules")
REGULAR_MODES = ("100644", "100755")


def ordinal(column: Column | str, values: tuple[str, ...]) -> Column:
    """Declaration-order position of an enumerated value (0 based); null for an unknown one."""
    c = F.col(column) if isinstance(column, str) else column
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(at > 0, at - 1)
