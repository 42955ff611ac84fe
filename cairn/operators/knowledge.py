"""Projection of analysis facts to knowledge graphs: nodes, edges and violations of each kind of fact, and persistence of a batch.

facts: fact_id (their order), kind, identity_key, name, value, source_key, target_key, relation,
container, path, resolved, confidence_pct, deterministic, fingerprint. evidence: fact_id, nth (0 is a
fact's first), file_id, start_offset and end_offset (null without a range), role. Components are found
around evidence by the file and an offset bucket as join keys; groups are aggregates, so a fact that
is everywhere costs a row for each task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.canonical import identity
from cairn.operators.ingest import enclosing
from cairn.sources.store import stored

# Confidence of an anchor that stands in for a component, by whether its symbol is known.
SYMBOL_ANCHOR, FILE_ANCHOR = 90, 75
NAME_LIMIT = 512
NODE_COLUMNS = ("kind", "identity_key", "name", "confidence_pct", "deterministic", "fingerprint", "evidence")
EDGE_COLUMNS = ("kind", "identity_key", "source_kind", "source_key", "target_kind", "target_key", "confidence_pct", "deterministic", "fingerprint", "evidence")


@dataclass(frozen=True)
class Projection:
    """nodes and edges to persist; violations (rule, identity_key), with any of which a build fails."""

    nodes: DataFrame
    edges: DataFrame
    violations: DataFrame


def _violations(rule: str, keys: DataFrame) -> DataFrame:
    return keys.select(F.lit(rule).alias("rule"), F.col("identity_key")).distinct()


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _printed(*columns: str) -> Column:
    """Fingerprint of what was made of several facts."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def _places() -> Column:
    """Number of distinct pieces of evidence."""
    return F.count_distinct(F.struct("file_id", F.coalesce("start_offset", F.lit(-1)), F.coalesce("end_offset", F.lit(-1)), "role"))


def _evidence_of(facts: DataFrame, evidence: DataFrame, key: Column) -> DataFrame:
    """node_key and evidence: the distinct pieces of evidence of all facts with one key."""
    own = facts.select("fact_id", key.alias("node_key")).join(evidence.hint("merge"), "fact_id")
    return own.groupBy("node_key").agg(_places().alias("evidence"))


def marked(rows: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """rows with <column>_known for each of columns: whether it is an identity_key of known (distinct). One join for each, no row is lost."""
    for c in columns:
        rows = rows.join(known.select(F.col("identity_key").alias(c), F.lit(True).alias(f"{c}_known")), c, "left").withColumn(f"{c}_known", F.coalesce(f"{c}_known", F.lit(False)))
    return rows


def components(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """The components' descriptors: component, c_confidence, c_deterministic and the range of their first evidence."""
    first = evidence.filter("nth = 0 and start_offset is not null").select("fact_id", "file_id", "start_offset", "end_offset")
    own = facts.filter("kind = 'architecture_component'").select("fact_id", F.col("identity_key").alias("component"), F.col("confidence_pct").alias("c_confidence"), F.col("deterministic").alias("c_deterministic"))
    return own.join(first, "fact_id").drop("fact_id")


def around(pieces: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """pieces of evidence with the narrowest component of their file around them (component, c_confidence, c_deterministic; null for none)."""
    own = components(facts, evidence)
    ranges = own.select("component", "file_id", "start_offset", "end_offset")
    met = enclosing(pieces.filter("start_offset is not null").select("fact_id", "nth", "file_id", "start_offset", "end_offset"), ranges, ["fact_id", "nth"], "component")
    facts_of = own.select("component", "c_confidence", "c_deterministic").groupBy("component").agg(F.max("c_confidence").alias("c_confidence"), F.bool_or("c_deterministic").alias("c_deterministic"))
    return pieces.join(met.join(facts_of, "component"), ["fact_id", "nth"], "left")


def merged_edges(rows: DataFrame, fact_wins: str = "first") -> DataFrame:
    """One edge per (kind, source, target) of rows (EDGE_COLUMNS but identity, fingerprint and evidence; ord, file_id, start_offset, end_offset, role).

    Evidence is united. first: confidence is the greatest, the rest is the first row's. last: all is the last row's, its evidence too.
    """
    keys = ["kind", "source_kind", "source_key", "target_kind", "target_key"]
    if fact_wins == "last":
        last = rows.groupBy(*keys).agg(F.max("ord").alias("ord"))
        rows = rows.join(last, [*keys, "ord"])
    out = rows.groupBy(*keys).agg(F.max("confidence_pct").alias("confidence_pct"), F.min_by("deterministic", "ord").alias("deterministic"), _places().alias("evidence"))
    out = out.withColumn("identity_key", identity("knowledge_edge", "source_key", "target_key", "kind"))
    return out.withColumn("fingerprint", _printed("identity_key", "confidence_pct", "deterministic", "evidence")).select(*EDGE_COLUMNS)


def architecture(facts: DataFrame, evidence: DataFrame) -> Projection:
    """Components become nodes, relationships edges; one identity with several contents, and an unknown endpoint, are violations."""
    own = facts.filter("kind = 'architecture_component'")
    several = own.groupBy("identity_key").agg(F.max_by(F.struct("name", "confidence_pct", "deterministic", "fingerprint", "fact_id"), "fact_id").alias("x"), (F.min("fingerprint") != F.max("fingerprint")).alias("conflict"))
    per_fact = evidence.groupBy("fact_id").agg(_places().alias("evidence"))
    nodes = several.select("identity_key", "x.*").join(per_fact, "fact_id").withColumn("kind", F.lit("architectural_component"))
    relations = marked(facts.filter("kind = 'architecture_relationship'").withColumn("relation_", F.col("relation")), own.select("identity_key").distinct(), "source_key", "target_key")
    both = F.col("source_key_known") & F.col("target_key_known")
    fine = relations.filter(both)
    edges = fine.join(per_fact, "fact_id").withColumns({"kind": F.col("relation_"), "source_kind": F.lit("architectural_component"), "target_kind": F.lit("architectural_component")})
    unknown = relations.filter(~both)
    return Projection(nodes.select(*NODE_COLUMNS), edges.select(*EDGE_COLUMNS), _all(_violations("conflicting_component", several.filter("conflict")), _violations("unknown_component", unknown)))


def business(facts: DataFrame, evidence: DataFrame) -> Projection:
    """Concepts and rules become nodes, and edges from the component around each fact, or from an anchor where there is none.

    Rules are keyed anew by their file and properties (value), so that equal guards of one file are one
    rule. A concept's identity with several names is a violation.
    """
    firsts = evidence.filter("nth = 0")
    own = facts.filter("kind in ('domain_concept', 'business_rule')").join(firsts.select("fact_id", "file_id", "start_offset", "end_offset", "nth", "role"), "fact_id")
    concept = F.col("kind") == "domain_concept"
    own = own.withColumn("node_key", F.when(concept, F.col("identity_key")).otherwise(identity("business_rule", "file_id", "value"))).withColumn("node_kind", F.col("kind"))
    groups = own.groupBy("node_kind", "node_key").agg(
        F.min_by("name", "fact_id").alias("name"), F.max("confidence_pct").alias("confidence_pct"), F.bool_or("deterministic").alias("deterministic"),
        ((F.min("name") != F.max("name")) | (F.min("value") != F.max("value"))).alias("conflict"),
    )
    counted = _evidence_of(own, evidence, F.col("node_key"))
    nodes = groups.join(counted, "node_key").select(F.col("node_kind").alias("kind"), F.col("node_key").alias("identity_key"), "name", "confidence_pct", "deterministic", "evidence")
    nodes = nodes.withColumn("fingerprint", _printed("kind", "identity_key", "name", "confidence_pct", "deterministic", "evidence"))
    met = around(own, facts, evidence)
    anchor = identity("architecture_component", F.lit("source_context"), F.col("file_id"), F.coalesce("container", F.lit("")))
    none = F.col("component").isNull()
    anchored = met.filter(none).withColumn("identity_key", anchor)
    anchors = anchored.groupBy("identity_key").agg(
        F.left(F.coalesce(F.max_by("container", "fact_id"), F.max_by("path", "fact_id"), F.concat(F.lit("Source file #"), F.min("file_id").cast("string"))), F.lit(NAME_LIMIT)).alias("name"),
        F.max(F.when(F.col("container").isNotNull(), SYMBOL_ANCHOR).otherwise(FILE_ANCHOR)).cast("long").alias("confidence_pct"), _places().alias("evidence"),
    ).withColumns({"kind": F.lit("architectural_component"), "deterministic": F.lit(False)})
    anchors = anchors.withColumn("fingerprint", _printed("kind", "identity_key", "name", "confidence_pct", "evidence"))
    sure = F.when(none, F.when(F.col("container").isNotNull(), SYMBOL_ANCHOR).otherwise(FILE_ANCHOR)).otherwise(F.col("c_confidence"))
    edges = met.select(
        F.col("fact_id").alias("ord"), F.when(concept, "represents").otherwise("enforces").alias("kind"), F.lit("architectural_component").alias("source_kind"), F.coalesce("component", anchor).alias("source_key"),
        F.col("node_kind").alias("target_kind"), F.col("node_key").alias("target_key"), F.least(sure, F.col("confidence_pct")).cast("long").alias("confidence_pct"), (F.coalesce("c_deterministic", F.lit(False)) & F.col("deterministic")).alias("deterministic"), "fact_id",
    )
    edges = edges.join(evidence.select("fact_id", "file_id", "start_offset", "end_offset", "role"), "fact_id")
    bad = groups.filter("node_kind = 'domain_concept' and conflict").select(F.col("node_key").alias("identity_key"))
    return Projection(_all(anchors.select(*NODE_COLUMNS), nodes.select(*NODE_COLUMNS)), merged_edges(edges), _violations("conflicting_concept", bad))


def states(facts: DataFrame, evidence: DataFrame) -> Projection:
    """States and transitions become nodes; transitions_to edges between states, enforces edges from the component around a transition.

    A state with several names, a repeated transition, and an unknown state of a transition are violations.
    """
    own = facts.filter("kind = 'state'")
    groups = own.groupBy("identity_key").agg(
        F.concat(F.min_by("value", "fact_id"), F.lit("."), F.min_by("name", "fact_id")).alias("name"), F.max("confidence_pct").alias("confidence_pct"), F.bool_or("deterministic").alias("deterministic"),
        ((F.min("name") != F.max("name")) | (F.min("value") != F.max("value"))).alias("conflict"),
    )
    state_nodes = groups.join(_evidence_of(own, evidence, F.col("identity_key")).withColumnRenamed("node_key", "identity_key"), "identity_key").withColumn("kind", F.lit("state"))
    state_nodes = state_nodes.withColumn("fingerprint", _printed("kind", "identity_key", "name", "confidence_pct", "deterministic", "evidence"))
    moves = facts.filter("kind = 'state_transition'")
    per_fact = evidence.groupBy("fact_id").agg(_places().alias("evidence")).hint("merge")
    move_nodes = moves.join(per_fact, "fact_id").withColumn("name", F.concat_ws(" ", F.col("name"), F.lit("→"), F.col("value"))).select(*NODE_COLUMNS)
    seen = marked(moves, own.select("identity_key").distinct(), "source_key", "target_key")
    lost = F.col("source_key").isNotNull() & ~F.col("source_key_known")
    to, whence, fine = seen.filter(~F.col("target_key_known")), seen.filter(lost), seen.filter(F.col("target_key_known") & ~lost)
    steps = fine.filter("source_key is not null").select(F.col("fact_id").alias("ord"), "fact_id", F.lit("transitions_to").alias("kind"), F.lit("state").alias("source_kind"), "source_key", F.lit("state").alias("target_kind"), "target_key", "confidence_pct", "deterministic")
    met = around(evidence.filter("nth = 0").join(fine.select("fact_id", "identity_key", "confidence_pct", "deterministic").hint("merge"), "fact_id"), facts, evidence).filter("component is not null")
    held = met.select(
        F.col("fact_id").alias("ord"), "fact_id", F.lit("enforces").alias("kind"), F.lit("architectural_component").alias("source_kind"), F.col("component").alias("source_key"), F.lit("state_transition").alias("target_kind"), F.col("identity_key").alias("target_key"),
        F.least("c_confidence", "confidence_pct").alias("confidence_pct"), (F.col("c_deterministic") & F.col("deterministic")).alias("deterministic"),
    )
    edges = steps.unionByName(held).join(evidence.select("fact_id", "file_id", "start_offset", "end_offset", "role").hint("merge"), "fact_id")
    repeated = moves.groupBy("identity_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bad = _all(_violations("conflicting_state", groups.filter("conflict")), _violations("repeated_transition", repeated), _violations("unknown_target_state", to), _violations("unknown_source_state", whence))
    return Projection(_all(state_nodes.select(*NODE_COLUMNS), move_nodes), merged_edges(edges, "last"), bad)


def events(facts: DataFrame, evidence: DataFrame) -> Projection:
    """Resolved events and all handlers become nodes; triggers edges from the component around each call site, handles edges from handlers.

    An event with several names, a repeated handler, and a handler of an unknown event are violations.
    Call sites outside of components, and unresolved events, make nothing.
    """
    own = facts.filter("kind = 'domain_event' and resolved")
    groups = own.groupBy("identity_key").agg(F.min_by("name", "fact_id").alias("name"), ((F.min("name") != F.max("name")) | (F.min("value") != F.max("value"))).alias("conflict"))
    event_nodes = groups.join(_evidence_of(own, evidence, F.col("identity_key")).withColumnRenamed("node_key", "identity_key"), "identity_key")
    event_nodes = event_nodes.withColumns({"kind": F.lit("domain_event"), "confidence_pct": F.lit(100).cast("long"), "deterministic": F.lit(True)})
    event_nodes = event_nodes.withColumn("fingerprint", _printed("kind", "identity_key", "name", "evidence"))
    handlers = facts.filter("kind = 'event_handler'")
    per_fact = evidence.groupBy("fact_id").agg(_places().alias("evidence"))
    handler_nodes = handlers.join(per_fact, "fact_id").select(*NODE_COLUMNS)
    calls = evidence.filter("role = 'call_site'").join(own.select("fact_id", "identity_key", "confidence_pct"), "fact_id")
    met = around(calls, facts, evidence).filter("component is not null")
    triggers = met.select(
        (F.col("fact_id") * 1000 + F.col("nth")).alias("ord"), F.lit("triggers").alias("kind"), F.lit("architectural_component").alias("source_kind"), F.col("component").alias("source_key"), F.lit("domain_event").alias("target_kind"), F.col("identity_key").alias("target_key"),
        F.least("c_confidence", "confidence_pct").alias("confidence_pct"), F.col("c_deterministic").alias("deterministic"), "file_id", "start_offset", "end_offset", "role",
    )
    asked = marked(handlers.filter("target_key is not null"), own.select("identity_key").distinct(), "target_key")
    known = asked.filter("target_key_known")
    handles = known.select(
        (F.col("fact_id") * 1000).alias("ord"), "fact_id", F.lit("handles").alias("kind"), F.lit("event_handler").alias("source_kind"), F.col("identity_key").alias("source_key"), F.lit("domain_event").alias("target_kind"), "target_key", "confidence_pct", "deterministic"
    ).join(evidence.select("fact_id", "file_id", "start_offset", "end_offset", "role"), "fact_id").drop("fact_id")
    repeated = handlers.groupBy("identity_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    unknown = asked.filter(~F.col("target_key_known"))
    bad = _all(_violations("conflicting_event", groups.filter("conflict")), _violations("repeated_handler", repeated), _violations("unknown_event", unknown))
    return Projection(_all(event_nodes.select(*NODE_COLUMNS), handler_nodes), merged_edges(triggers.unionByName(handles)), bad)


def workflows(facts: DataFrame, components: DataFrame) -> Projection:
    """Workflows and their steps become nodes; edges from the entry's component to its workflow (contains), to each step (contains), from steps to the components that they call (calls), and from step to step (precedes, with the evidence of both).

    facts: kind (workflow, workflow_step), identity_key, name, workflow_key, step, step_type,
    component_key, steps (how many a workflow has), file_id, start_offset, end_offset. components:
    identity_key. A repeated workflow, steps that aren't numbered 0, 1, 2, ... up to their number, a step of
    an unknown workflow, and an unknown component are violations; a workflow with any of the first two has
    no edges between its steps.
    """
    head, part = F.col("kind") == "workflow", F.col("kind") == "workflow_step"
    step = F.when(part, F.col("step"))
    # facts without a workflow's key don't belong together
    apart = F.when(F.col("workflow_key").isNull(), F.col("kind")).alias("apart_")
    groups = facts.filter(head | part).groupBy("workflow_key", apart).agg(
        F.count_if(head).alias("heads_"), F.max(F.when(head, F.col("steps"))).alias("steps_"), F.count_if(part).alias("held_"), F.min(step).alias("low_"), F.max(step).alias("high_"), F.count_distinct(step).alias("own_")
    )
    whole = (F.col("held_") == F.col("steps_")) & (F.col("low_") == 0) & (F.col("high_") == F.col("held_") - 1) & (F.col("own_") == F.col("held_"))
    state = F.when(F.col("heads_") == 0, "orphan_step").when(F.col("heads_") > 1, "repeated_workflow").when(~F.coalesce(whole, F.lit(False)), "invalid_steps").otherwise("fine")
    states_ = stored(groups.select("workflow_key", state.alias("state_")), "states")
    known = components.select(F.col("identity_key").alias("component_key")).distinct().withColumn("known_", F.lit(True))
    # read once for each kind of edge, and for the steps after steps
    every = stored(facts.join(states_, "workflow_key").join(known, "component_key", "left"), "marked")
    nodes = facts.withColumns({"confidence_pct": F.lit(100).cast("long"), "deterministic": F.lit(True), "evidence": F.lit(1).cast("long")})
    nodes = nodes.withColumn("fingerprint", _printed("kind", "identity_key", "name", "workflow_key", "step", "component_key")).select(*NODE_COLUMNS).distinct()
    fine = every.filter("state_ = 'fine'")
    role = F.when(F.col("step_type") == "resolved_call", "call_site").otherwise("decorator")
    place = ["file_id", "start_offset", "end_offset", role.alias("role")]
    edge = lambda rows, kind, a_kind, a, b_kind, b: rows.select(F.lit(kind).alias("kind"), F.lit(a_kind).alias("source_kind"), F.col(a).alias("source_key"), F.lit(b_kind).alias("target_kind"), F.col(b).alias("target_key"), *place)
    own = fine.filter("kind = 'workflow_step'")
    entered = edge(fine.filter("kind = 'workflow' and known_"), "contains", "architectural_component", "component_key", "workflow", "workflow_key")
    held = edge(own, "contains", "workflow", "workflow_key", "workflow_step", "identity_key")
    called = edge(own.filter("step_type = 'resolved_call' and known_"), "calls", "workflow_step", "identity_key", "architectural_component", "component_key")
    # the next step by its number: a long workflow is many keys
    after = own.select("workflow_key", (F.col("step") - 1).alias("step"), F.col("identity_key").alias("next_key"), *[F.col(c).alias(f"next_{c}") for c in ("file_id", "start_offset", "end_offset", "step_type")])
    pairs = own.join(after, ["workflow_key", "step"])
    both = F.explode(F.array(F.struct("file_id", "start_offset", "end_offset", "step_type"), F.struct(*[F.col(f"next_{c}").alias(c) for c in ("file_id", "start_offset", "end_offset", "step_type")])))
    ahead = edge(pairs.select("identity_key", "next_key", both.alias("x")).select("identity_key", "next_key", "x.*"), "precedes", "workflow_step", "identity_key", "workflow_step", "next_key")
    rows = _all(entered, held, called, ahead).withColumns({"confidence_pct": F.lit(100).cast("long"), "deterministic": F.lit(True), "ord": F.lit(0)})
    odd = states_.filter("state_ <> 'fine'").select(F.col("state_").alias("rule"), F.col("workflow_key").alias("identity_key"))
    asked = (F.col("kind") == "workflow") | (F.col("step_type") == "resolved_call")
    unknown = every.filter(asked & F.col("component_key").isNotNull() & F.col("known_").isNull())
    return Projection(nodes, merged_edges(rows), _all(odd, _violations("unknown_component", unknown)))


def flat(p: Projection) -> DataFrame:
    """All of a projection as rows of one table: part (node, edge, violation), kind, identity_key, name, source_key, target_key, confidence_pct, deterministic, evidence."""
    none = F.lit(None).cast("string")
    number, flag = F.lit(None).cast("long"), F.lit(None).cast("boolean")
    rest = ["confidence_pct", "deterministic", "evidence"]
    nodes = p.nodes.select(F.lit("node").alias("part"), "kind", "identity_key", "name", none.alias("source_key"), none.alias("target_key"), *rest)
    edges = p.edges.select(F.lit("edge").alias("part"), "kind", "identity_key", none.alias("name"), "source_key", "target_key", *rest)
    bad = p.violations.select(F.lit("violation").alias("part"), F.col("rule").alias("kind"), "identity_key", none.alias("name"), none.alias("source_key"), none.alias("target_key"), number.alias("confidence_pct"), flag.alias("deterministic"), number.alias("evidence"))
    return _all(nodes, edges, bad)


def outcomes(known: DataFrame, batch: DataFrame) -> DataFrame:
    """What persisting a batch (kind, identity_key, fingerprint) into a snapshot does to each of its rows: inserted, kept (a retry) or conflict.

    Rows of the batch with one identity and several fingerprints conflict too. A batch with any conflict
    is not written at all (see persisted).
    """
    keys = ["kind", "identity_key"]
    own = batch.groupBy(*keys).agg(F.min("fingerprint").alias("fingerprint"), (F.min("fingerprint") != F.max("fingerprint")).alias("several"))
    met = own.join(known.select(*keys, F.col("fingerprint").alias("was")), keys, "left")
    action = F.when(F.col("several") | (F.col("was") != F.col("fingerprint")), "conflict").when(F.col("was").isNull(), "inserted").otherwise("kept")
    return met.select(*keys, action.alias("action"))


class Conflict(Exception):
    """A batch that may not be persisted."""


def persisted(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a draft snapshot after a batch: all of it or, raising Conflict, nothing. The same batch again changes nothing.

    All are of one snapshot, with NODE_COLUMNS and EDGE_COLUMNS. An edge's endpoints must be nodes of the snapshot or of the batch.
    """
    keys = ["kind", "identity_key"]
    for what, known, batch in (("node", nodes, new_nodes), ("edge", edges, new_edges)):
        if not outcomes(known, batch).filter("action = 'conflict'").isEmpty():
            raise Conflict(f"{what} identity has conflicting content")
    first = lambda batch, columns: batch.groupBy(*keys).agg(F.min(F.struct(*[c for c in columns if c not in keys])).alias("r")).select(*keys, "r.*").select(*columns)
    nodes = nodes.unionByName(first(new_nodes, NODE_COLUMNS).join(nodes.select(*keys), keys, "left_anti").select(*NODE_COLUMNS))
    for side in ("source", "target"):
        own = nodes.select(F.col("kind").alias(f"{side}_kind"), F.col("identity_key").alias(f"{side}_key"))
        if not new_edges.join(own, [f"{side}_kind", f"{side}_key"], "left_anti").isEmpty():
            raise Conflict("edge references an unknown node")
    return nodes, edges.unionByName(first(new_edges, EDGE_COLUMNS).join(edges.select(*keys), keys, "left_anti").select(*EDGE_COLUMNS))
