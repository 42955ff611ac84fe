"""Knowledge graphs: projection of facts, merging, publication, and queries over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.enums import EDGE_KINDS, NODE_KINDS, ordinal

# Fixed values.
SELF_EDGES = ("calls", "depends_on", "transitions_to")
EVIDENCE_LIMIT = 100


def merged_nodes(parts: list[DataFrame]) -> DataFrame:
    """Union of projections by (kind, identity_key) with conflict: one identity with several fingerprints, on which a build fails."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("kind", "identity_key").agg(F.min("fingerprint").alias("fingerprint"), (F.min("fingerprint") != F.max("fingerprint")).alias("conflict"))


def unknown_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node of their snapshot: a violation, not a filter."""
    own = nodes.select(F.col("id").alias("n_"), F.col("snapshot_id").alias("s_"))
    bad = lambda side: edges.join(own, (edges[side] == own["n_"]) & (edges["snapshot_id"] == own["s_"]), "left_anti")
    return bad("source_node_id").unionByName(bad("target_node_id")).distinct()


def edge_confidence(a: Column, b: Column) -> Column:
    return F.least(a, b)


def forbidden_self_edges(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("source_node_id") == F.col("target_node_id")) & ~F.col("kind").isin(*SELF_EDGES))


def without_evidence(facts: DataFrame, links: DataFrame, fact: str, link: str) -> DataFrame:
    """Facts that no evidence backs; a snapshot with any is not published."""
    return facts.join(links.select(F.col(link).alias("l_")), facts[fact] == F.col("l_"), "left_anti")


def published(manifest: DataFrame, version: int, current: bool) -> DataFrame:
    """The manifest after publishing a version: current moves to it where wanted, the earlier current one is superseded."""
    own = F.col("id") == version
    status = F.when(own, "published").when(F.lit(current) & F.col("is_current"), "superseded").otherwise(F.col("status"))
    return manifest.withColumns({"status": status, "is_current": F.when(own, F.lit(current)).when(F.lit(current), F.lit(False)).otherwise(F.col("is_current"))})


def publication(manifest: DataFrame, heads: DataFrame, nodes: DataFrame, edges: DataFrame, node_links: DataFrame, edge_links: DataFrame) -> DataFrame:
    """manifest (id, branch_id, status, is_current, commit) after its drafts are published, with superseded, and what speaks against a draft: unbacked_nodes, unbacked_edges, and refused.

    heads: branch_id, head. nodes and edges: id, snapshot_id; links: id of what has evidence. A draft is
    published if all its nodes and edges have evidence and its branch is known. It becomes current only
    where its commit is still the branch's head, and what was current there is superseded then.
    """
    bare = lambda rows, links, name: rows.join(links.select("id"), "id", "left_anti").groupBy(F.col("snapshot_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    met = manifest.join(bare(nodes, node_links, "unbacked_nodes"), "id", "left").join(bare(edges, edge_links, "unbacked_edges"), "id", "left").join(heads, "branch_id", "left")
    met = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("unbacked_nodes", "unbacked_edges")})
    draft = F.col("status") == "draft"
    refused = F.when(draft & (F.col("unbacked_nodes") + F.col("unbacked_edges") > 0), "evidence_incomplete").when(draft & F.col("head").isNull(), "unknown_branch")
    met = met.withColumn("refused", refused).withColumn("new_", draft & F.col("refused").isNull()).withColumn("lead_", F.col("new_") & (F.col("commit") == F.col("head")))
    led = met.filter("lead_").select("branch_id").distinct().withColumn("led_", F.lit(True))
    met = met.join(led, "branch_id", "left")
    gone = F.col("is_current") & ~F.col("lead_") & F.col("led_").isNotNull()
    out = met.withColumns({"superseded": gone, "status": F.when(F.col("new_"), "published").otherwise(F.col("status")), "is_current": F.when(F.col("new_"), F.col("lead_")).otherwise(F.col("is_current") & ~gone)})
    return out.select("id", "branch_id", "status", "is_current", "superseded", "unbacked_nodes", "unbacked_edges", "refused")


def node_order() -> list[Column]:
    return [ordinal("kind", NODE_KINDS).asc(), F.asc("name"), F.asc("id")]


def edge_order() -> list[Column]:
    return [ordinal("kind", EDGE_KINDS).asc(), F.asc("id")]


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with name and kind of both endpoints."""
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_node_id"), F.col("name").alias(f"{p}_name"), F.col("kind").alias(f"{p}_kind"))
    return edges.join(side("source"), "source_node_id").join(side("target"), "target_node_id")


def evidence_page(evidence: DataFrame, files: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """The first rows by evidence id, put into reading order after that cut."""
    cut = evidence.orderBy("id").limit(limit)
    return cut.join(files.select(F.col("id").alias("indexed_file_id"), "path"), "indexed_file_id").orderBy("path", F.coalesce("start_offset", F.lit(-1)), "id")
