"""Queries of analysis and of knowledge graphs; and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import analysis as a
from cairn.operators import graph as k
from cairn.operators.search import page
from cairn.plans.registry import Tables, query


def rows() -> Column:
    return F.count(F.lit(1))

#: Class-like names from parts: an adjective, a noun and a technical suffix by number.
NAMES = """SELECT p_partkey AS id, p_size AS file_id, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
    || CASE p_partkey % 9 WHEN 0 THEN 'Service' WHEN 1 THEN 'Controller' WHEN 2 THEN 'Dto' WHEN 3 THEN 'Config' WHEN 4 THEN 'HTTPModule' WHEN 5 THEN '_entity2' WHEN 6 THEN 'Provider' ELSE '' END AS name,
    CASE WHEN p_size % 10 = 0 THEN 'src/config/' ELSE 'src/' END || p_type || '.ts' AS path, p_partkey % 3 = 0 AS exported FROM part"""


def _names(t: Tables) -> DataFrame:
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    cap = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))
    n = F.col("p_partkey") % 9
    tail = F.when(n == 0, "Service").when(n == 1, "Controller").when(n == 2, "Dto").when(n == 3, "Config").when(n == 4, "HTTPModule").when(n == 5, "_entity2").when(n == 6, "Provider").otherwise("")
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("file_id"), F.concat(cap(first), cap(second), tail).alias("name"), F.concat(F.when(F.col("p_size") % 10 == 0, "src/config/").otherwise("src/"), F.col("p_type"), F.lit(".ts")).alias("path"), (F.col("p_partkey") % 3 == 0).alias("exported"))


STRIPPED = "regexp_replace(name, '^(.+?)(Configuration|Controller|Repository|Service|Provider|Response|Request|Entity|Module|Config|Model|Input|Output|DTO|Dto)$', '\\1')"
CONCEPT = f"nullif(trim(regexp_replace(regexp_replace(regexp_replace({STRIPPED}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), '')"


@query(f"SELECT id, {CONCEPT} AS concept FROM ({NAMES})")
def ana_concept_norm(t: Tables) -> DataFrame:
    return _names(t).select("id", a.concept_name(F.col("name")).alias("concept"))


#: Declarations of files: kind and decorator by the key.
DECLARED = f"""SELECT file_id, id AS ord, CASE id % 7 WHEN 0 THEN 'interface' WHEN 1 THEN 'enum' WHEN 2 THEN 'type_alias' WHEN 3 THEN 'function' ELSE 'class' END AS kind,
    name || CASE id % 5 WHEN 1 THEN 'Request' WHEN 2 THEN 'Repository' ELSE '' END AS name, exported, id % 13 = 0 AS entity FROM ({NAMES})"""


@query(
    f"""WITH d AS (SELECT *, {CONCEPT} AS concept FROM ({DECLARED})), c AS (
        SELECT *, CASE WHEN kind = 'class' AND entity THEN 'entity_decorator' WHEN kind IN ('interface', 'enum', 'type_alias') THEN 'domain_type' WHEN kind = 'class' AND regexp_matches(name, '{a.BOUNDARY}') THEN 'boundary_type'
            WHEN kind = 'class' AND regexp_matches(name, '{a.SERVICE}') THEN 'service_boundary' WHEN kind = 'class' AND exported THEN 'domain_type' END AS source
        FROM d WHERE concept IS NOT NULL AND lower(concept) NOT IN ('app', 'application', 'base', 'common', 'config', 'configuration', 'core', 'default', 'helper', 'shared', 'utility', 'utils')
    )
    SELECT file_id, 'domain_concept:' || sha256('["' || lower(concept) || '"]') AS identity_key, ord, concept, kind AS declaration_kind, source,
        CAST(CASE source WHEN 'entity_decorator' THEN 100 WHEN 'boundary_type' THEN 85 WHEN 'service_boundary' THEN 70 ELSE CASE WHEN kind = 'class' THEN 65 ELSE 80 END END AS BIGINT) AS confidence_pct, source = 'entity_decorator' AS deterministic
    FROM c WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, lower(concept) ORDER BY ord) = 1"""
)
def ana_concept(t: Tables) -> DataFrame:
    n, m = F.col("id") % 7, F.col("id") % 5
    kind = F.when(n == 0, "interface").when(n == 1, "enum").when(n == 2, "type_alias").when(n == 3, "function").otherwise("class")
    name = F.concat("name", F.when(m == 1, "Request").when(m == 2, "Repository").otherwise(""))
    return a.concepts(_names(t).select("file_id", F.col("id").alias("ord"), kind.alias("kind"), name.alias("name"), "exported", (F.col("id") % 13 == 0).alias("entity")))


SIGNALS = "lower(text || CASE doc_id % 8 WHEN 0 THEN ' user.Role ' WHEN 1 THEN ' order.status ' WHEN 2 THEN ' isEligible ' WHEN 3 THEN ' slotFree ' ELSE ' plain ' END)"
EVERY = f"({SIGNALS} || CASE doc_id % 11 WHEN 0 THEN ' pendingState ' WHEN 1 THEN ' qualifies ' WHEN 2 THEN ' ownerAccess ' WHEN 3 THEN ' booking ' ELSE '' END)"


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(c, '{a.PERMISSION}') THEN 'permission' WHEN regexp_matches(c, '{a.STATE}') THEN 'state_constraint' WHEN regexp_matches(c, '{a.ELIGIBILITY}') THEN 'eligibility' WHEN regexp_matches(c, '{a.SCHEDULING}') THEN 'scheduling'
    WHEN regexp_matches(s, '{a.PERMISSION}') THEN 'permission' WHEN regexp_matches(s, '{a.ELIGIBILITY}') THEN 'eligibility' WHEN regexp_matches(s, '{a.STATE}') THEN 'state_constraint' WHEN regexp_matches(s, lower('{a.SCHEDULING}')) THEN 'scheduling'
    WHEN doc_id % 2 = 0 THEN 'validation' END AS rule_type FROM (SELECT doc_id, {SIGNALS} AS c, lower({EVERY}) AS s FROM documents)"""
)
def ana_rule_class(t: Tables) -> DataFrame:
    m, n = F.col("doc_id") % 8, F.col("doc_id") % 11
    c = F.concat("text", F.when(m == 0, " user.Role ").when(m == 1, " order.status ").when(m == 2, " isEligible ").when(m == 3, " slotFree ").otherwise(" plain "))
    s = F.concat(c, F.when(n == 0, " pendingState ").when(n == 1, " qualifies ").when(n == 2, " ownerAccess ").when(n == 3, " booking ").otherwise(""))
    return t.documents.select("doc_id", a.rule_type(c, s, F.when(F.col("doc_id") % 2 == 0, "throw").otherwise("log")).alias("rule_type"))


@query("SELECT p_partkey AS id, list_has_all(['small', 'ring', 'blue', 'widget', 'red'], string_split(lower(p_name), ' ')) AS matches FROM part")
def ana_concept_match(t: Tables) -> DataFrame:
    signals = F.array(*map(F.lit, ("small", "ring", "blue", "widget", "red")))
    return t.part.select(F.col("p_partkey").alias("id"), a.tokens_within(a.concept_tokens(F.col("p_name")), signals).alias("matches"))


#: Facts of files under analysis: some name an analyser that isn't registered, some evidence lies in another file, hash or beyond the end.
CONTRACT_FACTS = """SELECT f.fact_id, e.file_id + CASE WHEN f.fact_id % 97 = 0 THEN 8 ELSE 0 END AS file_id, f.identity_key, CASE WHEN f.fact_id % 89 = 0 THEN 'stray' ELSE 'typescript' END AS analyzer, CASE WHEN f.fact_id % 83 = 0 THEN '0.9' ELSE '1.0' END AS version
    FROM {graph_facts} f JOIN {graph_evidence} e ON e.fact_id = f.fact_id AND e.nth = 0 WHERE f.kind <> 'architecture_relationship'"""
CONTRACT_EVIDENCE = "SELECT fact_id, file_id, file_id + CASE WHEN fact_id % 79 = 0 THEN 1 ELSE 0 END AS hash_id, end_offset FROM {graph_evidence}"
CONTRACT_FILES = "SELECT DISTINCT file_id, file_id AS hash_id, CAST(4900 AS BIGINT) AS length FROM {graph_evidence}"


@query(
    f"""WITH cf AS ({CONTRACT_FACTS}), ce AS ({CONTRACT_EVIDENCE}), fi AS ({CONTRACT_FILES})
    SELECT 'unknown_analyzer' AS rule, file_id, identity_key FROM cf WHERE analyzer <> 'typescript' OR version <> '1.0'
    UNION ALL SELECT DISTINCT 'evidence_outside', cf.file_id, identity_key FROM cf JOIN ce ON ce.fact_id = cf.fact_id LEFT JOIN fi ON fi.file_id = cf.file_id
        WHERE fi.file_id IS NULL OR ce.file_id <> cf.file_id OR ce.hash_id <> fi.hash_id OR ce.end_offset > fi.length
    UNION ALL SELECT 'repeated_identity', file_id, identity_key FROM cf GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'too_many_facts', file_id, NULL FROM cf GROUP BY file_id HAVING count(*) > 95"""
)
def ana_fact_contract(t: Tables) -> DataFrame:
    named = {"graph_facts": t.graph_facts, "graph_evidence": t.graph_evidence}
    only = {"graph_evidence": t.graph_evidence}
    analyzers = t.spark.sql("SELECT 'typescript' AS analyzer, '1.0' AS version")
    return a.contract_violations(t.spark.sql(CONTRACT_FACTS, **named), t.spark.sql(CONTRACT_EVIDENCE, **only), t.spark.sql(CONTRACT_FILES, **only), analyzers, 95)


DECORATED = """SELECT l_partkey AS symbol_id, CASE l_suppkey % 9 WHEN 0 THEN 'common.Module' WHEN 1 THEN 'Controller' WHEN 2 THEN 'orm.Entity' WHEN 3 THEN 'ChildEntity' ELSE 'Injectable' END AS name FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 8"""
DIRECT = "CASE WHEN name LIKE '%Module' THEN 'module' WHEN name = 'Controller' THEN 'controller' WHEN name LIKE '%Entity' THEN 'entity' END"
SUFFIX = "CASE WHEN name LIKE '%Controller' THEN 'controller' WHEN name LIKE '%Service' THEN 'service' WHEN name LIKE '%Repository' THEN 'repository' WHEN name LIKE '%Module' THEN 'module' WHEN name LIKE '%Entity' THEN 'entity' WHEN name LIKE '%Provider' THEN 'provider' WHEN name LIKE '%Config' THEN 'configuration' END"


@query(
    f"""SELECT id, CASE WHEN nd > 1 THEN NULL WHEN nd = 1 THEN one WHEN suffix IS NOT NULL THEN suffix WHEN inj THEN 'provider' WHEN path LIKE 'src/config/%' THEN 'configuration' END AS type,
    CASE WHEN nd > 1 THEN NULL WHEN nd = 1 THEN 1.0 WHEN inj AND suffix IS NOT NULL THEN 0.95 WHEN inj THEN 1.0 WHEN suffix IS NOT NULL THEN 0.8 WHEN path LIKE 'src/config/%' THEN 0.85 END::DOUBLE AS confidence, nd > 1 AS conflict
    FROM (SELECT n.*, {SUFFIX} AS suffix, coalesce(d.nd, 0) AS nd, d.one, coalesce(d.inj, FALSE) AS inj FROM ({NAMES}) n
        LEFT JOIN (SELECT symbol_id, count(DISTINCT {DIRECT}) AS nd, max({DIRECT}) AS one, bool_or(name = 'Injectable') AS inj FROM ({DECORATED}) GROUP BY symbol_id) d ON d.symbol_id = n.id)"""
)
def arch_classify(t: Tables) -> DataFrame:
    n = F.col("l_suppkey") % 9
    decorators = t.lineitem.filter("l_linenumber = 1 AND l_quantity < 8").select(F.col("l_partkey").alias("symbol_id"), F.when(n == 0, "common.Module").when(n == 1, "Controller").when(n == 2, "orm.Entity").when(n == 3, "ChildEntity").otherwise("Injectable").alias("name"))
    return a.component_type(_names(t), decorators)


@query("SELECT conv_id, list_sort(list(turn)) = range(0, count(*)) AS complete FROM conversations GROUP BY conv_id")
def kg_step_check(t: Tables) -> DataFrame:
    return a.complete_steps(t.conversations, "conv_id", "turn")


MERGED = "SELECT kind, identity_key, max(confidence_pct) AS confidence_pct, bool_or(deterministic) AS deterministic, array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases, count(DISTINCT evidence_file) AS evidence, count(DISTINCT fingerprint) > 1 AS conflict FROM {facts} GROUP BY ALL"


@query(MERGED)
def agg_merge_fact(t: Tables) -> DataFrame:
    return a.merged_facts(t.facts, ["kind", "identity_key"]).withColumn("aliases", F.array_join("aliases", ","))


#: A total order of the facts: their number may repeat.
ORD = "ord * 1000 + confidence_pct * 10 + fingerprint"


def total_order() -> Column:
    return F.struct((F.col("ord") * 1000 + F.col("confidence_pct") * 10 + F.col("fingerprint")).alias("total"), F.col("alias"))


@query(f"SELECT kind, identity_key, max(confidence_pct) AS confidence_pct, arg_min(alias, ({ORD}, alias)) AS alias FROM {{facts}} GROUP BY ALL")
def agg_merge_edge(t: Tables) -> DataFrame:
    own = t.facts.withColumn("total", total_order())
    return a.first_wins(own, ["kind", "identity_key"], "alias", "total")


@query(f"SELECT kind, identity_key, arg_max(alias, ({ORD}, alias)) AS alias, arg_max(confidence_pct, ({ORD}, alias)) AS confidence_pct FROM {{facts}} GROUP BY ALL")
def agg_last_wins_edge(t: Tables) -> DataFrame:
    own = t.facts.withColumn("total", total_order())
    return a.last_wins(own, ["kind", "identity_key"], ["alias", "confidence_pct"], "total")


@query("SELECT evidence_file, kind, array_to_string(list_sort(list(DISTINCT alias)), ',') AS operations, count(DISTINCT identity_key) AS occurrences FROM {facts} GROUP BY ALL")
def agg_event_merge(t: Tables) -> DataFrame:
    return a.merged_events(t.facts, ["evidence_file", "kind"]).withColumn("operations", F.array_join("operations", ","))


@query("SELECT kind, identity_key, max(confidence_pct) AS confidence_pct, arg_max(ord, (confidence_pct, -ord)) AS ord FROM {facts} GROUP BY ALL")
def agg_state_merge(t: Tables) -> DataFrame:
    return a.most_confident(t.facts, ["kind", "identity_key"], ["confidence_pct", "ord"], "ord")


@query("SELECT o_orderkey AS id, running FROM (SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS BIGINT)) OVER (ORDER BY o_orderkey) AS BIGINT) AS running FROM orders) WHERE running > 1000000 ORDER BY o_orderkey LIMIT 1")
def agg_budget(t: Tables) -> DataFrame:
    from cairn.operators.ingest import first_offender

    own = t.orders.select(F.col("o_orderkey").alias("id"), F.rint("o_totalprice").cast("long").alias("amount"))
    return first_offender(own, "amount", "id", 1_000_000).select("id", "running")


@query("SELECT f.ord, coalesce(CAST(n.id AS STRING), 'file:' || CAST(f.evidence_file AS STRING)) AS anchor, CASE WHEN n.id IS NULL THEN 75 ELSE 90 END AS confidence_pct FROM (SELECT DISTINCT ord, identity_key, evidence_file FROM {facts}) f LEFT JOIN {nodes} n ON n.id = f.identity_key AND n.kind = 'architectural_component'")
def kg_fallback(t: Tables) -> DataFrame:
    own = t.nodes.filter("kind = 'architectural_component'").select(F.col("id").alias("identity_key"), F.col("id").alias("node"))
    facts = t.facts.select("ord", "identity_key", "evidence_file").distinct()
    return facts.join(own, "identity_key", "left").select("ord", F.coalesce(F.col("node").cast("string"), F.concat(F.lit("file:"), F.col("evidence_file").cast("string"))).alias("anchor"), F.when(F.col("node").isNull(), 75).otherwise(90).alias("confidence_pct"))


#: Rules as the reader finds them: some without a condition, a target, identifiers or a container, some long.
RULES = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'state_constraint' WHEN 1 THEN 'permission' WHEN 2 THEN 'eligibilityCheck' ELSE '' END AS rule_type, o_orderkey % 5 <> 0 AS asks, CASE WHEN o_orderkey % 2 = 0 THEN 'binaryExpression' ELSE '_' END AS c_kind,
    CASE o_orderkey % 3 WHEN 0 THEN '!' WHEN 1 THEN '===' END AS c_operation, CASE WHEN o_orderkey % 7 < 3 THEN 'o' || CAST(o_custkey AS STRING) || '.status' END AS c_target,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'a' || CAST(o_custkey % 9 AS STRING) END AS c_first, o_orderkey % 13 = 0 AS c_many,
    CASE o_orderkey % 8 WHEN 0 THEN 'assignment' WHEN 1 THEN 'throw' WHEN 2 THEN 'return' WHEN 3 THEN 'call' WHEN 4 THEN 'rounding_call' WHEN 5 THEN 'someOther-kind' WHEN 6 THEN 'throw' END AS o_kind,
    CASE WHEN o_orderkey % 3 = 1 THEN 'op' || CAST(o_custkey % 5 AS STRING) END AS o_operation, CASE WHEN o_orderkey % 5 = 1 THEN 't' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 10 = 1 THEN repeat('x', 600) ELSE '' END END AS o_target,
    CASE WHEN o_orderkey % 9 <> 0 THEN 'i' || CAST(o_custkey % 4 AS STRING) END AS o_first, CASE WHEN o_orderkey % 4 <> 3 THEN 'C' || CAST(o_custkey AS STRING) || chr(10) || '.m' END AS container FROM {orders}"""


def _humanized(c: str) -> str:
    words = f"lower(trim(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-]+', ' ', 'g')))"
    return f"CASE WHEN {words} = '' THEN 'Business rule' ELSE upper(substr({words}, 1, 1)) || substr({words}, 2) END"


LIMITED = "left(trim(regexp_replace({}, '[\\r\\n]+', ' ', 'g')), {n})"


@query(
    f"""WITH r AS ({RULES.replace("{orders}", "orders")}), x AS (
        SELECT *, coalesce(c_target, CASE WHEN c_first IS NULL THEN NULL WHEN c_many THEN c_first || ' and b and c' ELSE c_first END) AS aim, {_humanized("rule_type")} || ' rule' AS fallback FROM r
    ), y AS (
        SELECT id, CASE WHEN NOT asks THEN NULL WHEN aim IS NULL THEN {_humanized("c_kind")} WHEN c_operation = '!' THEN 'not ' || aim ELSE aim END AS asked, coalesce(' in ' || container, '') AS place,
            CASE WHEN o_kind IS NULL THEN fallback WHEN o_kind = 'assignment' THEN 'Set ' || coalesce(o_target, o_first, 'state') WHEN o_kind = 'throw' THEN 'Reject' || coalesce(' with ' || o_first, '') WHEN o_kind = 'return' THEN coalesce('Return ' || coalesce(o_target, o_first), 'Return early')
                WHEN o_kind = 'call' THEN 'Call ' || coalesce(o_operation, o_first, 'operation') WHEN o_kind = 'rounding_call' THEN 'Round ' || coalesce(o_target, o_first, 'calculated value') ELSE {_humanized("o_kind")} END AS title,
            CASE WHEN o_kind IS NULL THEN 'enforces a ' || fallback WHEN o_kind = 'assignment' THEN 'sets ' || coalesce(o_target, o_first, 'state') WHEN o_kind = 'throw' THEN 'rejects execution' || coalesce(' with ' || o_first, '') WHEN o_kind = 'return' THEN coalesce('returns ' || coalesce(o_target, o_first), 'returns early')
                WHEN o_kind = 'call' THEN 'calls ' || coalesce(o_operation, o_first, 'operation') WHEN o_kind = 'rounding_call' THEN 'rounds ' || coalesce(o_target, o_first, 'calculated value') ELSE 'performs ' || {_humanized("o_kind")} END AS summary
        FROM x
    )
    SELECT id, {LIMITED.replace("{}", "title || coalesce(' when ' || asked, '') || place").replace("{n}", "512")} AS name, {LIMITED.replace("{}", "coalesce('When ' || asked || ', the code ', 'The code ') || summary || place || '.'").replace("{n}", "4000")} AS summary FROM y"""
)
def kg_rule_text(t: Tables) -> DataFrame:
    own = t.spark.sql(RULES, orders=t.orders)
    listed = lambda first, *rest: F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.array(first, *rest))
    names = F.when(F.col("c_many"), listed(F.col("c_first"), F.lit("b"), F.lit("c"), F.lit("d"))).otherwise(listed(F.col("c_first")))
    condition = F.when(F.col("asks"), F.struct(F.col("c_kind").alias("kind"), F.col("c_operation").alias("operation"), F.col("c_target").alias("target"), names.alias("identifiers")))
    outcome = F.when(F.col("o_kind").isNotNull(), F.struct(F.col("o_kind").alias("kind"), F.col("o_operation").alias("operation"), F.col("o_target").alias("target"), listed(F.col("o_first")).alias("identifiers")))
    return a.rule_text(own.select("id", "rule_type", condition.alias("condition"), outcome.alias("outcome"), "container")).select("id", "name", "summary")


@query("SELECT e.id, least(e.weight, n.size) AS confidence_pct, n.size > 25 AND e.weight > 25 AS deterministic FROM {edges} e JOIN {nodes} n ON n.id = e.source_node_id")
def kg_edge_confidence(t: Tables) -> DataFrame:
    own = t.edges.join(t.nodes.select(F.col("id").alias("source_node_id"), F.col("size").cast("long").alias("size")), "source_node_id")
    return own.select("id", k.edge_confidence(F.col("weight"), F.col("size")).alias("confidence_pct"), ((F.col("size") > 25) & (F.col("weight") > 25)).alias("deterministic"))


@query("SELECT id, kind FROM {knowledge_edges} WHERE source_node_id = target_node_id AND kind NOT IN ('calls', 'depends_on', 'transitions_to')")
def kg_self_edge(t: Tables) -> DataFrame:
    return k.forbidden_self_edges(t.knowledge_edges).select("id", "kind")


#: Snapshots of branches, and what they hold; not everything has evidence, and not every branch is known.
SNAPSHOTS = """SELECT p_partkey AS id, p_partkey % 700 AS branch_id, CASE WHEN p_size % 3 = 0 THEN 'draft' ELSE 'published' END AS status, p_size % 3 <> 0 AND p_partkey < 700 AS is_current, md5(CAST(p_partkey AS STRING)) AS commit FROM {part}"""
HEADS = "SELECT c_custkey AS branch_id, md5(CAST(c_custkey + c_custkey % 3 * 700 AS STRING)) AS head FROM {customer}"
HELD = "SELECT o_orderkey AS id, o_orderkey * 7 % (SELECT count(*) FROM {part}) AS snapshot_id FROM {orders}"
LINKS = "SELECT DISTINCT l_orderkey AS id FROM {lineitem} WHERE l_quantity > {q} UNION SELECT o_orderkey FROM {orders} WHERE o_orderkey % 5 <> 0"


@query(
    f"""WITH s AS ({SNAPSHOTS.replace("{part}", "part")}), h AS ({HEADS.replace("{customer}", "customer")}), x AS ({HELD.replace("{part}", "part").replace("{orders}", "orders")}),
    n AS ({LINKS.replace("{q}", "5").replace("{orders}", "orders").replace("{lineitem}", "lineitem")}), e AS ({LINKS.replace("{q}", "15").replace("{orders}", "orders").replace("{lineitem}", "lineitem")}),
    m AS (
        SELECT s.*, h.head, (SELECT count(*) FROM x WHERE x.snapshot_id = s.id AND x.id NOT IN (SELECT id FROM n)) AS unbacked_nodes, (SELECT count(*) FROM x WHERE x.snapshot_id = s.id AND x.id NOT IN (SELECT id FROM e)) AS unbacked_edges FROM s LEFT JOIN h USING (branch_id)
    ), d AS (SELECT *, CASE WHEN status = 'draft' AND unbacked_nodes + unbacked_edges > 0 THEN 'evidence_incomplete' WHEN status = 'draft' AND head IS NULL THEN 'unknown_branch' END AS refused FROM m),
    l AS (SELECT *, status = 'draft' AND refused IS NULL AS fresh, coalesce(status = 'draft' AND refused IS NULL AND commit = head, FALSE) AS leads FROM d),
    b AS (SELECT *, bool_or(leads) OVER (PARTITION BY branch_id) AS led FROM l)
    SELECT id, branch_id, CASE WHEN fresh THEN 'published' ELSE status END AS status, CASE WHEN fresh THEN leads ELSE is_current AND NOT led END AS is_current, is_current AND NOT leads AND led AS superseded, unbacked_nodes, unbacked_edges, refused FROM b"""
)
def kg_publish(t: Tables) -> DataFrame:
    held = t.spark.sql(HELD, part=t.part, orders=t.orders)
    links = lambda q: t.spark.sql(LINKS.replace("{q}", q), orders=t.orders, lineitem=t.lineitem)
    return k.publication(t.spark.sql(SNAPSHOTS, part=t.part), t.spark.sql(HEADS, customer=t.customer), held, held, links("5"), links("15"))


# Queries over snapshots.


@query("SELECT id, created FROM {jobs} WHERE status = 'succeeded' ORDER BY created DESC, id DESC LIMIT 20 OFFSET 20")
def kq_snapshots(t: Tables) -> DataFrame:
    return page(t.jobs.filter("status = 'succeeded'"), [F.desc("created"), F.desc("id")], 2).select("id", "created")


@query("SELECT (SELECT count(*) FROM {nodes} WHERE snapshot_id = 1) AS nodes, (SELECT count(*) FROM {edges} WHERE snapshot_id = 1) AS edges")
def kq_current(t: Tables) -> DataFrame:
    one = lambda df, node: df.filter("snapshot_id = 1").select(F.lit(node).alias("node"))
    return one(t.nodes, True).unionAll(one(t.edges, False)).agg(F.count_if("node").alias("nodes"), F.count_if(~F.col("node")).alias("edges"))


@query("SELECT n.snapshot_id, n.nodes, e.edges FROM (SELECT snapshot_id, count(*) AS nodes FROM {nodes} GROUP BY 1) n JOIN (SELECT snapshot_id, count(*) AS edges FROM {edges} GROUP BY 1) e USING (snapshot_id)")
def agg_graph_counts(t: Tables) -> DataFrame:
    return t.nodes.groupBy("snapshot_id").agg(rows().alias("nodes")).join(t.edges.groupBy("snapshot_id").agg(rows().alias("edges")), "snapshot_id")


NODE_ORDER = "CASE kind WHEN 'architectural_component' THEN 0 WHEN 'domain_concept' THEN 1 WHEN 'business_rule' THEN 2 WHEN 'workflow' THEN 3 WHEN 'domain_event' THEN 7 END"


@query(f"SELECT id, kind, name FROM {{nodes}} WHERE name ILIKE '%ring%' ORDER BY {NODE_ORDER}, name, id LIMIT 20")
def kq_nodes(t: Tables) -> DataFrame:
    return page(t.nodes.filter(F.col("name").ilike("%ring%")), k.node_order()).select("id", "kind", "name")


@query("SELECT node_id, count(*) AS total, count(*) > 100 AS truncated FROM {evidence} WHERE node_id = 7 GROUP BY node_id")
def kq_node_detail(t: Tables) -> DataFrame:
    return t.evidence.filter("node_id = 7").groupBy("node_id").agg(rows().alias("total"), (rows() > 100).alias("truncated"))


EDGE_ORDER = "CASE e.kind WHEN 'contains' THEN 0 WHEN 'depends_on' THEN 1 WHEN 'calls' THEN 2 WHEN 'triggers' THEN 6 END"
ENDPOINTS = "FROM {edges} e JOIN {nodes} s ON s.id = e.source_node_id JOIN {nodes} d ON d.id = e.target_node_id"


@query(f"SELECT e.id, e.kind, s.name AS source_name, d.name AS target_name {ENDPOINTS} WHERE e.snapshot_id = 2 ORDER BY {EDGE_ORDER}, e.id, e.weight, source_name, target_name LIMIT 50 OFFSET 50")
def kq_edges(t: Tables) -> DataFrame:
    own = k.with_endpoints(t.edges.filter("snapshot_id = 2"), t.nodes)
    # edges of this stand-in may repeat an id
    return page(own, [*k.edge_order(), F.asc("weight"), F.asc("source_name"), F.asc("target_name")], 2, 50).select("id", "kind", "source_name", "target_name")


@query(f"SELECT e.id, s.kind AS source_kind, d.kind AS target_kind, e.weight {ENDPOINTS}")
def join_edge_nodes(t: Tables) -> DataFrame:
    return k.with_endpoints(t.edges, t.nodes).select("id", "source_kind", "target_kind", "weight")


@query(f"SELECT e.id, e.kind, s.name AS source_name, count(*) AS n {ENDPOINTS} WHERE e.id = 100304 GROUP BY ALL")
def kq_edge_detail(t: Tables) -> DataFrame:
    return k.with_endpoints(t.edges.filter("id = 100304"), t.nodes).groupBy("id", "kind", "source_name").agg(rows().alias("n"))


CUT = "SELECT e.id, f.path, e.start_offset FROM (SELECT * FROM {evidence} WHERE role = 'primary' ORDER BY id LIMIT 100) e JOIN {files} f ON f.id = e.indexed_file_id"


@query(CUT)
def join_evidence(t: Tables) -> DataFrame:
    return k.evidence_page(t.evidence.filter("role = 'primary'"), t.files).select("id", "path", "start_offset")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY path, coalesce(start_offset, -1), id) AS INTEGER) AS place FROM ({CUT})")
def kq_evidence_sort(t: Tables) -> DataFrame:
    cut = k.evidence_page(t.evidence.filter("role = 'primary'"), t.files)
    # at most a hundred rows by now
    rows = cut.agg(F.array_sort(F.collect_list(F.struct("path", F.coalesce("start_offset", F.lit(-1)).alias("at"), "id"))).alias("x"))
    return rows.select(F.posexplode("x").alias("pos", "x")).select("x.id", (F.col("pos") + 1).alias("place"))


# Search projection.


@query("SELECT 'file' AS source_type, count(*) AS documents FROM pages UNION ALL SELECT 'symbol', count(*) FROM documents UNION ALL SELECT 'knowledge_node', count(*) FROM benchmark")
def pj_union(t: Tables) -> DataFrame:
    from cairn.operators.projection import by_type

    return by_type(t.search_documents)


@query("SELECT (SELECT count(*) FROM pages) AS files, (SELECT count(*) FROM documents) AS symbols, (SELECT count(*) FROM benchmark) AS knowledge_nodes")
def agg_docs_by_type(t: Tables) -> DataFrame:
    kinds = {"files": "file", "symbols": "symbol", "knowledge_nodes": "knowledge_node"}
    return t.search_documents.agg(*[F.count_if(F.col("source_type") == v).alias(n) for n, v in kinds.items()])


@query("SELECT id, path AS title, size_bytes, sha256(path) AS sha FROM {files} WHERE status = 'active'")
def pj_file_doc(t: Tables) -> DataFrame:
    from cairn.operators.projection import file_documents

    own = file_documents(t.files.filter("status = 'active'"), F.col("path"))
    return own.select("id", "title", F.get_json_object("metadata", "$.size_bytes").cast("long").alias("size_bytes"), F.get_json_object("metadata", "$.sha").alias("sha"))


@query("SELECT id, name || chr(10) || lower(replace(replace(qualified_name, '#', ' '), '.', ' ')) || chr(10) || kind AS content FROM {symbols}")
def pj_symbol_doc(t: Tables) -> DataFrame:
    from cairn.operators.projection import symbol_documents

    return symbol_documents(t.symbols).select("id", "content")


@query("SELECT id, name || chr(10) || kind || chr(10) || brand AS content FROM {nodes}")
def pj_node_doc(t: Tables) -> DataFrame:
    from cairn.operators.projection import node_documents

    return node_documents(t.nodes).select("id", "content")


@query("SELECT id FROM {jobs} WHERE status = 'succeeded' AND repository_id = 3 AND total_files = 103")
def pj_reuse(t: Tables) -> DataFrame:
    from cairn.operators.search import optional_filters

    return optional_filters(t.jobs, status="succeeded", repository_id=3, total_files=103).select("id")


@query("SELECT id, CASE WHEN id = 500 THEN 'published' WHEN id % 50 = 7 THEN 'superseded' ELSE status END AS status, id = 500 AS is_current FROM {jobs} WHERE repository_id = 5")
def pj_publish(t: Tables) -> DataFrame:
    manifest = t.jobs.filter("repository_id = 5").select("id", "status", (F.col("id") % 50 == 7).alias("is_current"))
    return k.published(manifest, 500, True)


@query("SELECT event_id AS id, CAST(2 * len(json_keys(props)) AS INTEGER) AS n FROM events")
def pj_prop_terms(t: Tables) -> DataFrame:
    """Terms of the events' JSON properties."""
    from cairn.operators.projection import with_property_terms

    return with_property_terms(t.events.select(F.col("event_id").alias("id"), "props"), "props").select("id", F.size("terms").alias("n"))


@query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(list_max(list_filter(list_transform(range(0, 100), lambda k: strlen(left(text, k))), lambda n: n <= 99)) AS INTEGER) END AS n FROM documents")
def pj_truncate_utf8(t: Tables) -> DataFrame:
    from cairn.operators.projection import with_truncated

    return with_truncated(t.documents.select("doc_id", "text"), "text", 99).select("doc_id", F.octet_length("text").alias("n"))


#: Facts of events, some of which break a rule, and their evidence.
CHECKED = """SELECT event_id AS fact_id, CASE event_id % 50 WHEN 0 THEN '  ' WHEN 1 THEN 'a' || chr(10) || 'b' WHEN 2 THEN repeat('k', 513) WHEN 3 THEN NULL ELSE 'fact:' || CAST(event_id AS STRING) END AS identity_key,
    CASE event_id % 40 WHEN 0 THEN '' WHEN 1 THEN repeat('n', 101) ELSE 'typescript' END AS analyzer, CASE WHEN event_id % 45 = 0 THEN chr(13) || '1' ELSE '1.0' END AS version,
    CASE event_id % 30 WHEN 0 THEN CAST(1.5 AS DOUBLE) WHEN 1 THEN CAST(-0.5 AS DOUBLE) WHEN 2 THEN CAST('NaN' AS DOUBLE) WHEN 3 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS confidence,
    CASE WHEN event_id % 60 = 7 THEN NULL WHEN event_id % 60 = 8 THEN chr(123) || '"k":"' || repeat('é', 30) || '"' || chr(125) ELSE replace(props, ' ', '') END AS props FROM {events}"""
BACKED = """SELECT event_id AS fact_id, CASE WHEN event_id % 33 = 0 THEN 0 ELSE event_id + 1 END AS file_id, event_id + 1 AS hash_id, CASE event_id % 35 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 5 END AS symbol_id,
    CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 37 = 1 THEN 0 ELSE 3 END END AS start_line, CASE WHEN event_id % 4 <> 0 THEN 1 END AS start_column, CASE WHEN event_id % 4 <> 0 THEN 20 END AS start_offset,
    CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 39 = 1 THEN 2 ELSE 3 END END AS end_line, CASE WHEN event_id % 4 <> 0 AND event_id % 41 <> 1 THEN 9 END AS end_column, CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 43 = 1 THEN 19 ELSE 20 END END AS end_offset
    FROM {events} WHERE event_id % 31 <> 0"""


@query(
    f"""WITH f AS ({CHECKED.replace("{events}", "events")}), e AS ({BACKED.replace("{events}", "events")}), b AS (
        SELECT fact_id, bool_or(file_id < 1 OR hash_id < 1 OR coalesce(symbol_id < 1, FALSE)
            OR start_line IS NOT NULL AND (start_line < 1 OR end_line < start_line OR end_column IS NULL OR end_offset < start_offset)) AS bad FROM e GROUP BY 1
    ), r AS (
        SELECT fact_id, unnest([CASE WHEN identity_key IS NULL OR trim(identity_key) = '' OR length(identity_key) > 512 OR contains(identity_key, chr(10)) THEN 'invalid_identity' END,
            CASE WHEN analyzer = '' OR length(analyzer) > 100 OR contains(version, chr(13)) THEN 'invalid_analyzer' END, CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence > 1 OR confidence < 0 THEN 'invalid_confidence' END,
            CASE WHEN bad IS NULL THEN 'missing_evidence' END, CASE WHEN bad THEN 'invalid_evidence' END, CASE WHEN props IS NULL THEN 'invalid_properties' END, CASE WHEN strlen(props) > 40 THEN 'properties_too_large' END]) AS rule
        FROM f LEFT JOIN b USING (fact_id)
    ) SELECT fact_id, rule FROM r WHERE rule IS NOT NULL"""
)
def ana_fact_validate(t: Tables) -> DataFrame:
    from cairn.functions.canonical import with_canonical

    facts = with_canonical(t.spark.sql(CHECKED, events=t.events), "props")
    return a.fact_violations(facts, t.spark.sql(BACKED, events=t.events), 40)


@query("SELECT event_id AS id, sha256(replace(props, ' ', '')) AS content_fingerprint FROM events")
def ana_fact_fingerprint(t: Tables) -> DataFrame:
    """Fingerprints of canonical JSON."""
    from cairn.functions.canonical import with_fingerprint

    return with_fingerprint(t.events.select(F.col("event_id").alias("id"), "props"), "props").select("id", "content_fingerprint")


NUMBER = "coalesce(CAST({} AS STRING), 'null')"


@query("SELECT id, sha256('[' || " + " || ',' || ".join(NUMBER.replace("{}", c) for c in ("node_id", "indexed_file_id", "start_offset")) + """ || ',"' || role || '"]') AS identity_hash FROM {evidence}""")
def kg_evidence_hash(t: Tables) -> DataFrame:
    from cairn.functions.canonical import array_hash

    return t.evidence.select("id", array_hash("node_id", "indexed_file_id", "start_offset", "role").alias("identity_hash"))
