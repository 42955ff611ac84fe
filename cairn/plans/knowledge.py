"""Queries that project analysis facts to knowledge graphs. Each returns nodes, edges and violations as rows of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import knowledge as kn
from cairn.plans.registry import Tables, query

PLACES = "count(DISTINCT (e.file_id, e.start_offset, e.end_offset, e.role))"
NULLS = "NULL, NULL, NULL, NULL, NULL, NULL"
PER_FACT = f"per_fact AS (SELECT e.fact_id, {PLACES} AS n FROM {{graph_evidence}} e GROUP BY 1)"
#: Components with the range of their evidence; and the narrowest one around a row with file_id, start_offset and end_offset.
RANGES = """ranges AS (SELECT DISTINCT f.identity_key AS component, f.confidence_pct AS cc, f.deterministic AS cd, e.file_id, e.start_offset AS a, e.end_offset AS b
    FROM {graph_facts} f JOIN {graph_evidence} e ON e.fact_id = f.fact_id AND e.nth = 0 WHERE f.kind = 'architecture_component')"""
FOUND = "(SELECT arg_min(r.component, (r.b - r.a, r.component)) FROM ranges r WHERE r.file_id = {x}.file_id AND r.a <= {x}.start_offset AND r.b >= {x}.end_offset)"


def edge_id(source: str, target: str, kind: str) -> str:
    return f"""'knowledge_edge:' || sha256('["' || {source} || '","' || {target} || '","' || {kind} || '"]')"""


@query(
    f"""WITH {PER_FACT}, comp AS (
        SELECT identity_key, arg_max(name, fact_id) AS name, arg_max(confidence_pct, fact_id) AS confidence_pct, arg_max(deterministic, fact_id) AS deterministic, max(fact_id) AS fact_id, count(DISTINCT fingerprint) > 1 AS bad
        FROM {{graph_facts}} WHERE kind = 'architecture_component' GROUP BY 1
    ), rel AS (
        SELECT f.*, f.source_key IN (SELECT identity_key FROM comp) AND f.target_key IN (SELECT identity_key FROM comp) AS ok FROM {{graph_facts}} f WHERE kind = 'architecture_relationship'
    )
    SELECT 'node' AS part, 'architectural_component' AS kind, identity_key, name, NULL AS source_key, NULL AS target_key, confidence_pct, deterministic, n AS evidence FROM comp JOIN per_fact USING (fact_id)
    UNION ALL SELECT 'edge', relation, identity_key, NULL, source_key, target_key, confidence_pct, deterministic, n FROM rel JOIN per_fact USING (fact_id) WHERE ok
    UNION ALL SELECT 'violation', 'conflicting_component', identity_key, {NULLS} FROM comp WHERE bad
    UNION ALL SELECT DISTINCT 'violation', 'unknown_component', identity_key, {NULLS} FROM rel WHERE NOT ok"""
)
def kg_arch(t: Tables) -> DataFrame:
    return kn.flat(kn.architecture(*t.graph_batch))


@query(
    f"""WITH {RANGES}, own AS (
        SELECT f.*, e.file_id, e.start_offset, e.end_offset, e.role,
            CASE WHEN kind = 'domain_concept' THEN identity_key ELSE 'business_rule:' || sha256('["' || CAST(file_id AS VARCHAR) || '","' || value || '"]') END AS node_key
        FROM {{graph_facts}} f JOIN {{graph_evidence}} e ON e.fact_id = f.fact_id AND e.nth = 0 WHERE kind IN ('domain_concept', 'business_rule')
    ), met AS (
        SELECT own.*, {FOUND.replace("{x}", "own")} AS component FROM own
    ), anchored AS (
        SELECT met.*, coalesce(met.component, 'architecture_component:' || sha256('["source_context","' || CAST(met.file_id AS VARCHAR) || '","' || coalesce(container, '') || '"]')) AS anchor,
            coalesce(c.cc, CASE WHEN container IS NULL THEN 75 ELSE 90 END) AS sure, coalesce(c.cd, FALSE) AS cd
        FROM met LEFT JOIN (SELECT DISTINCT component, cc, cd FROM ranges) c ON c.component = met.component
    ), groups AS (
        SELECT kind, node_key, arg_min(name, fact_id) AS name, max(confidence_pct) AS confidence_pct, bool_or(deterministic) AS deterministic, count(DISTINCT name) > 1 OR count(DISTINCT value) > 1 AS bad FROM own GROUP BY ALL
    ), counted AS (SELECT o.node_key, {PLACES} AS n FROM own o JOIN {{graph_evidence}} e ON e.fact_id = o.fact_id GROUP BY 1)
    SELECT 'node' AS part, kind, node_key AS identity_key, name, NULL AS source_key, NULL AS target_key, confidence_pct, deterministic, n AS evidence FROM groups JOIN counted USING (node_key)
    UNION ALL SELECT 'node', 'architectural_component', anchor, left(coalesce(max(container), arg_max_null(path, fact_id), 'Source file #' || CAST(min(file_id) AS VARCHAR)), 512), NULL, NULL, CAST(max(sure) AS BIGINT), FALSE, {PLACES}
        FROM anchored e WHERE component IS NULL GROUP BY anchor
    UNION ALL SELECT 'edge', k, {edge_id("anchor", "node_key", "k")}, NULL, anchor, node_key, confidence_pct, deterministic, n FROM (
        SELECT CASE a.kind WHEN 'domain_concept' THEN 'represents' ELSE 'enforces' END AS k, anchor, node_key, CAST(max(least(sure, confidence_pct)) AS BIGINT) AS confidence_pct, arg_min(cd AND deterministic, a.fact_id) AS deterministic, {PLACES} AS n
        FROM anchored a JOIN {{graph_evidence}} e ON e.fact_id = a.fact_id GROUP BY ALL)
    UNION ALL SELECT 'violation', 'conflicting_concept', node_key, {NULLS} FROM groups WHERE bad AND kind = 'domain_concept'"""
)
def kg_business(t: Tables) -> DataFrame:
    return kn.flat(kn.business(*t.graph_batch))


@query(
    f"""WITH {RANGES}, {PER_FACT}, s AS (
        SELECT identity_key, arg_min(value, fact_id) || '.' || arg_min(name, fact_id) AS name, max(confidence_pct) AS confidence_pct, bool_or(deterministic) AS deterministic, count(DISTINCT name) > 1 OR count(DISTINCT value) > 1 AS bad
        FROM {{graph_facts}} WHERE kind = 'state' GROUP BY 1
    ), counted AS (SELECT f.identity_key, {PLACES} AS n FROM {{graph_facts}} f JOIN {{graph_evidence}} e ON e.fact_id = f.fact_id WHERE f.kind = 'state' GROUP BY 1),
    x AS (
        SELECT f.*, target_key IN (SELECT identity_key FROM s) AS to_ok, source_key IS NULL OR source_key IN (SELECT identity_key FROM s) AS from_ok FROM {{graph_facts}} f WHERE kind = 'state_transition'
    ), steps AS (
        SELECT fact_id, 'transitions_to' AS kind, source_key, target_key, confidence_pct, deterministic FROM x WHERE to_ok AND from_ok AND source_key IS NOT NULL
    ), met AS (
        SELECT x.*, {FOUND.replace("{x}", "e")} AS component FROM x JOIN {{graph_evidence}} e ON e.fact_id = x.fact_id AND e.nth = 0 WHERE to_ok AND from_ok
    ), every AS (
        SELECT * FROM steps
        UNION ALL SELECT fact_id, 'enforces', component, identity_key, least(cc, confidence_pct), cd AND deterministic FROM met JOIN (SELECT DISTINCT component, cc, cd FROM ranges) c USING (component)
    ), last AS (SELECT kind, source_key, target_key, max(fact_id) AS fact_id FROM every GROUP BY ALL)
    SELECT 'node' AS part, 'state' AS kind, identity_key, name, NULL AS source_key, NULL AS target_key, confidence_pct, deterministic, n AS evidence FROM s JOIN counted USING (identity_key)
    UNION ALL SELECT 'node', 'state_transition', identity_key, CASE WHEN name IS NULL THEN '' ELSE name || ' ' END || '→ ' || value, NULL, NULL, confidence_pct, deterministic, n FROM x JOIN per_fact USING (fact_id)
    UNION ALL SELECT 'edge', kind, {edge_id("source_key", "target_key", "kind")}, NULL, source_key, target_key, confidence_pct, deterministic, n FROM every JOIN last USING (kind, source_key, target_key, fact_id) JOIN per_fact USING (fact_id)
    UNION ALL SELECT 'violation', 'conflicting_state', identity_key, {NULLS} FROM s WHERE bad
    UNION ALL SELECT 'violation', 'repeated_transition', identity_key, {NULLS} FROM x GROUP BY identity_key HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'violation', 'unknown_target_state', identity_key, {NULLS} FROM x WHERE NOT to_ok
    UNION ALL SELECT DISTINCT 'violation', 'unknown_source_state', identity_key, {NULLS} FROM x WHERE NOT from_ok"""
)
def kg_state(t: Tables) -> DataFrame:
    return kn.flat(kn.states(*t.graph_batch))


@query(
    f"""WITH {RANGES}, {PER_FACT}, own AS (SELECT * FROM {{graph_facts}} WHERE kind = 'domain_event' AND resolved),
    g AS (SELECT identity_key, arg_min(name, fact_id) AS name, count(DISTINCT name) > 1 OR count(DISTINCT value) > 1 AS bad FROM own GROUP BY 1),
    counted AS (SELECT f.identity_key, {PLACES} AS n FROM own f JOIN {{graph_evidence}} e ON e.fact_id = f.fact_id GROUP BY 1),
    h AS (SELECT f.*, target_key IN (SELECT identity_key FROM g) AS ok FROM {{graph_facts}} f WHERE kind = 'event_handler'),
    calls AS (
        SELECT own.identity_key, own.fact_id, own.confidence_pct, e.nth, e.file_id, e.start_offset, e.end_offset, e.role, {FOUND.replace("{x}", "e")} AS component FROM own JOIN {{graph_evidence}} e ON e.fact_id = own.fact_id WHERE e.role = 'call_site'
    ), triggers AS (
        SELECT component AS source_key, identity_key AS target_key, max(least(cc, confidence_pct)) AS confidence_pct, arg_min(cd, fact_id * 1000 + nth) AS deterministic, {PLACES} AS n
        FROM calls e JOIN (SELECT DISTINCT component, cc, cd FROM ranges) c USING (component) GROUP BY ALL
    ), handles AS (
        SELECT h.identity_key AS source_key, h.target_key, max(h.confidence_pct) AS confidence_pct, arg_min(h.deterministic, h.fact_id) AS deterministic, {PLACES} AS n FROM h JOIN {{graph_evidence}} e ON e.fact_id = h.fact_id WHERE ok GROUP BY ALL
    )
    SELECT 'node' AS part, 'domain_event' AS kind, identity_key, name, NULL AS source_key, NULL AS target_key, CAST(100 AS BIGINT) AS confidence_pct, TRUE AS deterministic, n AS evidence FROM g JOIN counted USING (identity_key)
    UNION ALL SELECT 'node', 'event_handler', identity_key, name, NULL, NULL, confidence_pct, deterministic, n FROM h JOIN per_fact USING (fact_id)
    UNION ALL SELECT 'edge', 'triggers', {edge_id("source_key", "target_key", "'triggers'")}, NULL, source_key, target_key, confidence_pct, deterministic, n FROM triggers
    UNION ALL SELECT 'edge', 'handles', {edge_id("source_key", "target_key", "'handles'")}, NULL, source_key, target_key, confidence_pct, deterministic, n FROM handles
    UNION ALL SELECT 'violation', 'conflicting_event', identity_key, {NULLS} FROM g WHERE bad
    UNION ALL SELECT 'violation', 'repeated_handler', identity_key, {NULLS} FROM h GROUP BY identity_key HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'violation', 'unknown_event', identity_key, {NULLS} FROM h WHERE NOT ok"""
)
def kg_event(t: Tables) -> DataFrame:
    return kn.flat(kn.events(*t.graph_batch))


#: A snapshot that holds every second component already, some with other content.
DRAFT = "SELECT 'architectural_component' AS kind, 'c' || CAST(p_partkey AS STRING) AS identity_key, CASE WHEN p_partkey % 7 = 0 THEN 'old' ELSE 'f' || CAST(p_size AS STRING) END AS fingerprint FROM {part} WHERE p_partkey % 2 = 0"


@query(
    f"""SELECT 'architectural_component' AS kind, identity_key, CASE WHEN k.fingerprint IS NULL THEN 'inserted' WHEN k.fingerprint = b.fingerprint THEN 'kept' ELSE 'conflict' END AS action
    FROM (SELECT identity_key, arg_max(fingerprint, fact_id) AS fingerprint FROM {{graph_facts}} WHERE kind = 'architecture_component' GROUP BY 1) b LEFT JOIN ({DRAFT.replace("{part}", "part")}) k USING (identity_key)"""
)
def kg_persist(t: Tables) -> DataFrame:
    return kn.outcomes(t.spark.sql(DRAFT, part=t.part), kn.architecture(*t.graph_batch).nodes)


ANALYSED = "('domain_concept', 'business_rule', 'state', 'state_transition', 'domain_event')"


@query(f"SELECT kind, identity_key, min(fingerprint) AS fingerprint, count(DISTINCT fingerprint) > 1 AS conflict FROM {{graph_facts}} WHERE kind IN {ANALYSED} GROUP BY ALL")
def kg_merge(t: Tables) -> DataFrame:
    from cairn.operators.graph import merged_nodes

    own = t.graph_facts.select("kind", "identity_key", "fingerprint")
    return merged_nodes([own.filter(F.col("kind") == x) for x in ("domain_concept", "business_rule", "state", "state_transition", "domain_event")])
