"""Queries of ingestion: discovery, manifests, hashes, resolution; and filters, projections, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import extension, iso_utc, joined, normalized_url, progress, provider, sanitized
from cairn.operators import ingest as g
from cairn.operators import reconcile as r
from cairn.plans.registry import Tables, query

EXT = "CASE WHEN length(x) BETWEEN 1 AND 32 THEN x END"
WITH_EXT = f"SELECT *, {EXT} AS extension FROM (SELECT *, lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) AS x FROM {{tree}})"
IGNORED = "list_has_any(list_transform(string_split(path, '/')[:-2], lambda d: lower(d)), ['.git', 'build', 'coverage', 'dist', 'node_modules'])"
OUTCOME = f"""CASE WHEN mode NOT IN ('100644', '100755') THEN 'special' WHEN {IGNORED} THEN 'ignored'
    WHEN extension IS NULL OR extension NOT IN ('ts', 'tsx', 'js', 'jsx', 'json', 'md', 'yaml', 'yml') THEN 'unsupported' WHEN size_bytes > 2097152 THEN 'oversized' ELSE 'selected' END"""
CLASSIFIED = f"SELECT *, {OUTCOME} AS outcome FROM ({WITH_EXT})"


@query(f"SELECT path, outcome FROM ({CLASSIFIED})")
def ing_classify(t: Tables) -> DataFrame:
    return t.tree.select("path", g.outcome().alias("outcome"))


@query(f"SELECT path, extension FROM ({WITH_EXT})")
def ing_extension(t: Tables) -> DataFrame:
    return t.tree.select("path", extension(F.col("path")).alias("extension"))


LANG = "CASE WHEN extension IN ('ts', 'tsx') THEN 'typescript' WHEN extension IN ('js', 'jsx') THEN 'javascript' WHEN extension = 'json' THEN 'json' WHEN extension = 'md' THEN 'markdown' WHEN extension IN ('yaml', 'yml') THEN 'yaml' END"
ABLE = "CASE WHEN extension IN ('ts', 'tsx', 'js', 'jsx') THEN 'parser_supported' WHEN extension IN ('json', 'md', 'yaml', 'yml') THEN 'inventory_only' END"


@query(f"SELECT path, {LANG} AS language, {ABLE} AS capability FROM ({WITH_EXT})")
def ing_language(t: Tables) -> DataFrame:
    return g.with_language(t.tree).select("path", "language", "capability")


@query(f"SELECT {LANG} AS language, count(*) AS files, count(*) FILTER ({ABLE} = 'parser_supported') AS parsed FROM ({CLASSIFIED}) WHERE outcome = 'selected' GROUP BY 1")
def agg_language_dist(t: Tables) -> DataFrame:
    chosen = g.with_language(t.tree.withColumn("outcome", g.outcome()).filter("outcome = 'selected'"))
    return chosen.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("capability") == "parser_supported").alias("parsed"))


@query(
    f"""SELECT count(*) AS observed, count(*) FILTER (outcome = 'selected') AS selected, count(*) FILTER (outcome = 'ignored') AS ignored, count(*) FILTER (outcome = 'unsupported') AS unsupported,
    count(*) FILTER (outcome = 'oversized') AS oversized, count(*) FILTER (outcome = 'special') AS special, CAST(coalesce(sum(size_bytes) FILTER (outcome = 'selected'), 0) AS BIGINT) AS selected_bytes FROM ({CLASSIFIED})"""
)
def agg_discovery_stats(t: Tables) -> DataFrame:
    return g.discovery_statistics(t.tree)




@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 6")
def ing_path_valid(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 7
    path = F.when(k == 0, "/abs").when(k == 1, "a//b").when(k == 2, "a/./b").when(k == 3, "../up").when(k == 4, "a\\b").when(k == 5, "a\tb").otherwise("fine/path.ts")
    return g.path_violations(t.part.select(F.col("p_partkey").alias("id"), path.alias("path"))).select("id")


MANIFEST = """SELECT coalesce(k.path, o.path) AS path, k.id, CASE WHEN o.path IS NOT NULL THEN o.size_bytes ELSE k.size_bytes END AS size_bytes, CASE WHEN o.path IS NOT NULL THEN 'active' ELSE 'deleted' END AS status,
    CASE WHEN k.path IS NULL THEN 'created' WHEN o.path IS NOT NULL AND k.status = 'deleted' THEN 'restored' WHEN o.path IS NOT NULL THEN 'seen' WHEN k.status = 'deleted' THEN 'gone' ELSE 'deleted' END AS action
    FROM {inventory} k FULL JOIN {tree} o ON k.path = o.path"""


def _manifest(t: Tables) -> DataFrame:
    return r.soft_deleted(t.inventory, t.tree, ["path"], ["size_bytes"])


@query(MANIFEST)
def ing_manifest(t: Tables) -> DataFrame:
    return _manifest(t)


@query(f"SELECT action, count(*) AS files FROM ({MANIFEST}) GROUP BY action")
def join_tree_inventory(t: Tables) -> DataFrame:
    return _manifest(t).groupBy("action").agg(F.count(F.lit(1)).alias("files"))


SKIP = "SELECT t.path, t.size_bytes, coalesce(t.object_id = k.object_id AND t.size_bytes = k.size_bytes, FALSE) AS skip FROM {tree} t LEFT JOIN {inventory} k ON k.path = t.path"


@query(f"SELECT path, skip FROM ({SKIP})")
def ing_hash_incremental(t: Tables) -> DataFrame:
    return g.unchanged(t.tree, t.inventory).select("path", "skip")


@query("SELECT t.path, t.object_id FROM {tree} t JOIN {inventory} k ON k.path = t.path AND k.object_id = t.object_id AND k.size_bytes = t.size_bytes")
def join_hash_current(t: Tables) -> DataFrame:
    return g.unchanged(t.tree, t.inventory).filter("skip").select("path", "object_id")


@query(f"SELECT count(*) FILTER (NOT skip) AS hashed, count(*) FILTER (skip) AS unchanged, CAST(sum(size_bytes) FILTER (NOT skip) AS BIGINT) AS bytes FROM ({SKIP})")
def agg_hash_stats(t: Tables) -> DataFrame:
    own = g.unchanged(t.tree, t.inventory)
    return own.agg(F.count_if(~F.col("skip")).alias("hashed"), F.count_if("skip").alias("unchanged"), F.sum(F.when(~F.col("skip"), F.col("size_bytes"))).alias("bytes"))


@query("SELECT page_id AS id, sha256(html) AS sha256 FROM pages")
def ing_sha256(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").alias("id"), F.sha2("html", 256).alias("sha256"))


@query(
    """SELECT path, object_id FROM {inventory} UNION ALL SELECT path, object_id FROM {tree} t WHERE NOT EXISTS (SELECT 1 FROM {inventory} k WHERE k.path = t.path AND k.object_id = t.object_id)"""
)
def ing_hash_versions(t: Tables) -> DataFrame:
    return r.insert_ignore(t.inventory.select("path", "object_id"), t.tree.select("path", "object_id"), ["path", "object_id"])


@query(f"SELECT path FROM ({CLASSIFIED}) WHERE outcome = 'selected' AND {ABLE} = 'parser_supported' AND size_bytes % 2 = 0")
def ing_select_analysis(t: Tables) -> DataFrame:
    own = g.with_language(t.tree.withColumn("outcome", g.outcome()))
    return own.filter((F.col("outcome") == "selected") & (F.col("capability") == "parser_supported") & (F.col("size_bytes") % 2 == 0)).select("path")


@query(
    """SELECT coalesce(b.name, o.name) AS name, b.id, CASE WHEN b.name IS NULL THEN 'created' WHEN o.name IS NULL AND b.status = 'deleted' THEN 'gone' WHEN o.name IS NULL THEN 'deleted' WHEN b.status = 'deleted' THEN 'restored' ELSE 'seen' END AS action,
    CASE WHEN o.name IS NOT NULL THEN o.head ELSE b.head END AS head FROM {branches} b FULL JOIN {remote_branches} o ON b.name = o.name"""
)
def ing_branch_sync(t: Tables) -> DataFrame:
    return r.soft_deleted(t.branches, t.remote_branches, ["name"], ["head"]).select("name", "id", "action", "head")


SYMBOL_DIFF = """SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.qualified_name, b.qualified_name) AS qualified_name, coalesce(a.start_offset, b.start_offset) AS start_offset, a.id AS old_id,
    CASE WHEN a.id IS NULL THEN 'created' WHEN b.id IS NULL THEN 'removed' WHEN a.exported = b.exported THEN 'unchanged' ELSE 'updated' END AS action
    FROM (SELECT kind, qualified_name, start_offset, min(id) AS id, bool_or(exported) AS exported FROM {symbols} WHERE indexed_file_id < 40 GROUP BY ALL) a
    FULL JOIN (SELECT kind, qualified_name, start_offset, min(id) AS id, bool_and(exported) AS exported FROM {symbols} WHERE indexed_file_id > 10 GROUP BY ALL) b USING (kind, qualified_name, start_offset)"""


def _symbol_diff(t: Tables) -> DataFrame:
    key = ["kind", "qualified_name", "start_offset"]
    old = t.symbols.filter("indexed_file_id < 40").groupBy(*key).agg(F.min("id").alias("id"), F.bool_or("exported").alias("exported"))
    new = t.symbols.filter("indexed_file_id > 10").groupBy(*key).agg(F.min("id").alias("id"), F.bool_and("exported").alias("exported"))
    return r.reconcile(old, new, key, ["exported"])


@query(SYMBOL_DIFF)
def ing_reconcile_symbols(t: Tables) -> DataFrame:
    return _symbol_diff(t).select("kind", "qualified_name", "start_offset", "old_id", "action")


@query(f"SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'removed') AS removed FROM ({SYMBOL_DIFF})")
def agg_reconcile_counts(t: Tables) -> DataFrame:
    return r.counts(_symbol_diff(t))


IDENTITY = "sha256(kind || ':' || CAST(source_indexed_file_id AS STRING) || ':' || coalesce(CAST(target_symbol_id AS STRING), '-'))"


@query(
    f"""SELECT coalesce(a.h, b.h) AS identity_hash, CASE WHEN a.h IS NULL THEN 'created' WHEN b.h IS NULL THEN 'removed' WHEN a.n = b.n THEN 'unchanged' ELSE 'updated' END AS action
    FROM (SELECT {IDENTITY} AS h, count(*) AS n FROM {{code_dependencies}} WHERE organization_id < 3 GROUP BY 1) a FULL JOIN (SELECT {IDENTITY} AS h, count(*) AS n FROM {{code_dependencies}} WHERE organization_id > 1 GROUP BY 1) b ON a.h = b.h"""
)
def ing_reconcile_deps(t: Tables) -> DataFrame:
    own = t.code_dependencies.withColumn("identity_hash", F.sha2(F.concat_ws(":", "kind", F.col("source_indexed_file_id").cast("string"), F.coalesce(F.col("target_symbol_id").cast("string"), F.lit("-"))), 256))
    side = lambda c: own.filter(c).groupBy("identity_hash").agg(F.count(F.lit(1)).alias("n"))
    return r.reconcile(side("organization_id < 3"), side("organization_id > 1"), ["identity_hash"], ["n"]).select("identity_hash", "action")


TIERS = """SELECT f.id, f.file_id, f.target_name, count(s.id) AS n3, max(s.id) AS s3, count(s.id) FILTER (s.qualified_name = f.target_name) AS n1, max(s.id) FILTER (s.qualified_name = f.target_name) AS s1, count(s.id) FILTER (s.exported) AS n2, max(s.id) FILTER (s.exported) AS s2
    FROM (SELECT DISTINCT id, file_id, target_name FROM {references_to}) f LEFT JOIN {symbols} s ON s.indexed_file_id = f.file_id AND s.name = regexp_extract(f.target_name, '([^.]*)$', 1) AND f.target_name NOT IN ('*', 'default', '') GROUP BY ALL"""
RESOLVED = f"""SELECT x.id, x.file_id, x.target_name, CASE WHEN x.target_name = 'default' THEN d.only ELSE CASE WHEN n1 = 1 THEN s1 WHEN n2 = 1 THEN s2 WHEN n3 = 1 THEN s3 END END AS target_symbol_id
    FROM ({TIERS}) x LEFT JOIN (SELECT indexed_file_id AS file_id, max(id) AS only FROM {{symbols}} WHERE default_export GROUP BY 1 HAVING count(*) = 1) d ON d.file_id = x.file_id"""


def _references(t: Tables) -> DataFrame:
    # a reference may repeat in this stand-in: its identity is all its columns
    return g.resolved_symbols(t.references_to.select("id", "file_id", "target_name").distinct(), t.symbols)


@query(RESOLVED)
def join_target_symbol(t: Tables) -> DataFrame:
    return _references(t).select("id", "file_id", "target_name", "target_symbol_id")


@query(f"SELECT count(*) AS dependencies, count(target_symbol_id) AS resolved, count(*) - count(target_symbol_id) AS unresolved FROM ({RESOLVED})")
def agg_dep_resolution(t: Tables) -> DataFrame:
    n, hit = F.count(F.lit(1)), F.count("target_symbol_id")
    return _references(t).agg(n.alias("dependencies"), hit.alias("resolved"), (n - hit).alias("unresolved"))


@query("SELECT f.id, f.file_id, f.target_name, min(s.id) AS source_symbol FROM (SELECT DISTINCT id, file_id, target_name, at_offset FROM {references_to}) f JOIN {symbols} s ON s.indexed_file_id = f.file_id AND s.name = f.target_name AND s.start_offset = f.at_offset GROUP BY ALL")
def join_source_symbol(t: Tables) -> DataFrame:
    own = t.symbols.select(F.col("indexed_file_id").alias("file_id"), F.col("name").alias("target_name"), F.col("start_offset").alias("at_offset"), F.col("id").alias("symbol"))
    return t.references_to.select("id", "file_id", "target_name", "at_offset").distinct().join(own, ["file_id", "target_name", "at_offset"]).groupBy("id", "file_id", "target_name").agg(F.min("symbol").alias("source_symbol"))


ENCLOSING = """SELECT p.id, p.file_id, p.at_offset, (SELECT arg_min(s.id, (s.end_offset - s.start_offset, s.id)) FROM {symbols} s WHERE s.indexed_file_id = p.file_id AND s.start_offset <= p.at_offset AND p.at_offset <= s.end_offset) AS range_id
    FROM (SELECT l_suppkey * 50 + l_quantity AS id, CAST(l_quantity AS BIGINT) AS file_id, l_suppkey * 37 % 5000 AS at_offset FROM lineitem GROUP BY ALL) p"""


@query(ENCLOSING)
def join_containment(t: Tables) -> DataFrame:
    points = t.lineitem.select((F.col("l_suppkey") * 50 + F.col("l_quantity")).alias("id"), F.col("l_quantity").cast("long").alias("file_id"), (F.col("l_suppkey") * 37 % 5000).alias("at_offset")).distinct()
    return g.smallest_enclosing(points, t.symbols).select("id", "file_id", "at_offset", "range_id")


@query("SELECT c.id AS component, m.id AS method FROM {symbols} c JOIN {symbols} m ON m.indexed_file_id = c.indexed_file_id AND c.kind = 'class' AND m.kind = 'class' AND m.id <> c.id AND m.start_offset >= c.start_offset AND m.end_offset <= c.end_offset AND starts_with(m.qualified_name, substr(c.qualified_name, 1, 6))")
def join_members(t: Tables) -> DataFrame:
    return g.members(t.symbols.filter("kind = 'class'"), 6)


@query(
    """SELECT p_partkey AS id, unnest(CASE WHEN p_size % 5 = 0 THEN [NULL] ELSE list_concat(list_concat(CASE WHEN p_size % 2 = 0 THEN ['default'] ELSE [] END, CASE WHEN p_size % 3 = 0 THEN ['*'] ELSE [] END), CASE WHEN p_size % 2 = 1 OR p_size % 3 <> 0 THEN [p_name, p_type] ELSE [] END) END) AS target_name FROM part"""
)
def ing_norm_imports(t: Tables) -> DataFrame:
    n = F.col("p_size")
    some = n % 5 != 0
    pair = lambda c: F.struct(F.col(c).alias("imported"), F.col(c).alias("local"))
    own = t.part.select(
        F.col("p_partkey").alias("id"), F.lit("m").alias("module"), F.when(some & (n % 2 == 0), "d").alias("default_import"), F.when(some & (n % 3 == 0), "ns").alias("namespace_import"), F.when(some & ((n % 2 == 1) | (n % 3 != 0)), F.array(pair("p_name"), pair("p_type"))).alias("named")
    )
    return g.normalized_imports(own).select("id", "target_name")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 IN (0, 1) THEN '*' ELSE coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END, p_type) END AS target_name FROM part")
def ing_norm_exports(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("all", "namespace", "named", "declaration"))), (F.col("p_size") % 4 + 1).cast("int"))
    local = F.when(F.col("p_size") % 3 != 0, F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), g.export_target(kind, local, F.col("p_type")).alias("target_name"))


@query(
    """SELECT h.id, b.module, CASE WHEN b.module IS NULL THEN h.target WHEN b.imported = '*' AND strpos(h.target, '.') > 0 THEN substr(h.target, strpos(h.target, '.') + 1) ELSE b.imported END AS target_name
    FROM (SELECT p_partkey AS id, p_size AS file_id, p_type || CASE WHEN p_partkey % 3 = 0 THEN '.' || p_name ELSE '' END AS target FROM part) h
    LEFT JOIN (SELECT p_size AS file_id, p_type AS local_name, arg_max('m' || CAST(p_partkey AS STRING), p_partkey) AS module, arg_max(CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE p_name END, p_partkey) AS imported FROM part WHERE p_partkey % 5 <> 0 GROUP BY ALL) b
    ON b.file_id = h.file_id AND b.local_name = string_split(h.target, '.')[1]"""
)
def ing_norm_heritage(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    heritage = t.part.select(k.alias("id"), F.col("p_size").alias("file_id"), F.concat(F.col("p_type"), F.when(k % 3 == 0, F.concat(F.lit("."), F.col("p_name"))).otherwise("")).alias("target"))
    bindings = t.part.filter(k % 5 != 0).select(F.col("p_size").alias("file_id"), F.col("p_type").alias("local_name"), F.concat(F.lit("m"), k.cast("string")).alias("module"), F.when(k % 2 == 0, "*").otherwise(F.col("p_name")).alias("imported"), k.alias("ord"))
    return g.heritage_targets(heritage, bindings).select("id", "module", "target_name")


MODULE_FILES = "SELECT p_partkey AS id, 'src/m' || CAST(p_partkey % 300 AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END AS path FROM part"
MODULE_TRIES = " UNION ALL ".join(f"SELECT {k} AS nth, '{e}' AS ext" for k, e in enumerate([*g.SOURCE_EXTENSIONS, *["/index" + e for e in g.SOURCE_EXTENSIONS]]))


@query(
    f"""SELECT i.id, m.file AS target_file FROM (SELECT s_suppkey AS id, 'src/m' || CAST(s_suppkey * 3 % 310 AS STRING) AS base FROM supplier) i
    LEFT JOIN (SELECT i.id, arg_min(f.id, e.nth) AS file FROM (SELECT s_suppkey AS id, 'src/m' || CAST(s_suppkey * 3 % 310 AS STRING) AS base FROM supplier) i CROSS JOIN ({MODULE_TRIES}) e JOIN (SELECT min(id) AS id, path FROM ({MODULE_FILES}) GROUP BY path) f ON f.path = i.base || e.ext GROUP BY i.id) m ON m.id = i.id"""
)
def join_module_candidates(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    files = t.part.select(k.alias("id"), F.concat(F.lit("src/m"), (k % 300).cast("string"), F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".tsx").otherwise("/index.js")).alias("path")).groupBy("path").agg(F.min("id").alias("id"))
    imports = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("src/deep/own.ts").alias("source_path"), F.concat(F.lit("../x/.././m"), (F.col("s_suppkey") * 3 % 310).cast("string")).alias("specifier"))
    return g.resolved_modules(imports, files).select("id", "target_file")


#: Paths that names of modules in src/deep/own.ts may stand for, in the order they are tried; none outside of the tree, and none of packages.
SPREAD = [*g.SOURCE_EXTENSIONS, *["/index" + e for e in g.SOURCE_EXTENSIONS]]
TRIED = {"./a": ["src/deep/a" + e for e in SPREAD], "../b.js": ["src/b.ts", "src/b.tsx", "src/b.js"], "../../c.jsx": ["c.tsx", "c.jsx"], "../../../up": [], "pkg": [], "./d.spec": ["src/deep/d.spec" + e for e in SPREAD], "./e/./f/../g.ts": ["src/deep/e/g.ts"]}
TRIES = ", ".join(f"('{s}', {k}, '{p}')" for s, own in TRIED.items() for k, p in enumerate(own))


@query(f"SELECT s_suppkey AS id, specifier, nth, path FROM supplier CROSS JOIN (VALUES {TRIES}) AS v(specifier, nth, path)")
def ing_module_paths(t: Tables) -> DataFrame:
    """Candidate paths of module names, with escapes and explicit extensions."""
    own = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("src/deep/own.ts").alias("source_path"), F.explode(F.array(*map(F.lit, TRIED))).alias("specifier"))
    return own.select("id", "specifier", F.posexplode(g.module_candidates(F.col("source_path"), F.col("specifier"))).alias("nth", "path"))


@query(f"SELECT id, coalesce(target_symbol_id, -1 - file_id) AS target FROM ({RESOLVED})")
def ing_resolve_targets(t: Tables) -> DataFrame:
    return _references(t).select("id", F.coalesce("target_symbol_id", -1 - F.col("file_id")).alias("target"))


@query(f"SELECT bool_and(ok) AS accepted, count(*) FILTER (NOT ok) AS violations FROM (SELECT coalesce(s.indexed_file_id = r.file_id, FALSE) AS ok FROM ({RESOLVED}) r LEFT JOIN {{symbols}} s ON s.id = r.target_symbol_id WHERE r.target_symbol_id IS NOT NULL)")
def ing_validate_targets(t: Tables) -> DataFrame:
    own = t.symbols.select(F.col("id").alias("target_symbol_id"), "indexed_file_id")
    ok = F.coalesce(F.col("indexed_file_id") == F.col("file_id"), F.lit(False))
    return _references(t).filter("target_symbol_id is not null").join(own, "target_symbol_id", "left").agg(F.bool_and(ok).alias("accepted"), F.count_if(~ok).alias("violations"))


HASHED = " || ',' || ".join(f"coalesce(CAST({c} AS STRING), 'null')" for c in ("source_symbol_id", "target_symbol_id", "target_indexed_file_id"))


@query(f"""SELECT id, sha256('["' || kind || '",' || {HASHED} || ']') AS identity_hash FROM {{code_dependencies}}""")
def ing_identity_hash(t: Tables) -> DataFrame:
    """Identity of dependencies: SHA-256 of a JSON array, nulls kept."""
    from cairn.functions.canonical import array_hash

    return t.code_dependencies.select("id", array_hash("kind", "source_symbol_id", "target_symbol_id", "target_indexed_file_id").alias("identity_hash"))


# Filters and projections.


@query("SELECT p_partkey AS id FROM part WHERE p_name ILIKE '%r_n%' OR p_type ILIKE '%eco%'")
def flt_ilike(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").ilike("%r_n%") | F.col("p_type").ilike("%eco%")).select(F.col("p_partkey").alias("id"))


@query("SELECT id, outcome FROM {audit} WHERE event_type = 'error' AND outcome = 'failure'")
def flt_enum(t: Tables) -> DataFrame:
    return t.audit.filter((F.col("event_type") == "error") & (F.col("outcome") == "failure")).select("id", "outcome")


@query("SELECT id, kind FROM {symbols} WHERE indexed_file_id IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def flt_in_list(t: Tables) -> DataFrame:
    ids = t.supplier.filter("s_acctbal > 0").select(F.col("s_nationkey").cast("long").alias("indexed_file_id")).distinct()
    return t.symbols.join(ids, "indexed_file_id", "left_semi").select("id", "kind")


@query("SELECT count(*) AS resolved FROM {code_dependencies} WHERE target_symbol_id IS NOT NULL AND target_indexed_file_id IS NULL")
def flt_not_null(t: Tables) -> DataFrame:
    return t.code_dependencies.filter(F.col("target_symbol_id").isNotNull() & F.col("target_indexed_file_id").isNull()).agg(F.count(F.lit(1)).alias("resolved"))


@query("SELECT id FROM {sessions} WHERE expires > 90000 AND revoked IS NULL")
def flt_expiry(t: Tables) -> DataFrame:
    return t.sessions.filter((F.col("expires") > 90_000) & F.col("revoked").isNull()).select("id")


@query("SELECT id, kind FROM {edges} WHERE source_node_id = 100 OR target_node_id = 100")
def flt_or_endpoint(t: Tables) -> DataFrame:
    return t.edges.filter((F.col("source_node_id") == 100) | (F.col("target_node_id") == 100)).select("id", "kind")


@query("SELECT event_id AS id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.name'), '') AS name FROM events")
def prj_json_get(t: Tables) -> DataFrame:
    get = lambda p: F.coalesce(F.get_json_object("props", p), F.lit(""))
    return t.events.select(F.col("event_id").alias("id"), get("$.k").alias("k"), get("$.name").alias("name"))


@query("SELECT id, indexed_file_id AS file_id, start_offset AS range_start, end_offset AS range_end FROM {symbols}")
def prj_nested_dto(t: Tables) -> DataFrame:
    nested = t.symbols.select("id", F.struct(F.col("indexed_file_id").alias("file_id")).alias("source"), F.struct(F.col("start_offset").alias("start"), F.col("end_offset").alias("end")).alias("range"))
    return nested.select("id", "source.file_id", F.col("range.start").alias("range_start"), F.col("range.end").alias("range_end"))


@query("SELECT id, CAST(CASE WHEN status = 'succeeded' THEN 100 WHEN total_files = 0 THEN 0 ELSE least(100, floor((processed_files + skipped_files) * 100 / total_files)) END AS BIGINT) AS progress FROM {jobs}")
def prj_progress_pct(t: Tables) -> DataFrame:
    return t.jobs.select("id", progress(F.col("status"), F.col("processed_files") + F.col("skipped_files"), F.col("total_files")).alias("progress"))


@query("SELECT event_id AS id, strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(date_part('milliseconds', ts) % 1000 AS STRING), 3, '0') || 'Z' AS at FROM events")
def prj_iso_ts(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), iso_utc(F.col("ts")).alias("at"))


@query("SELECT id, error_code IS NOT NULL AS failed, error_code AS code FROM {jobs}")
def prj_failure_null(t: Tables) -> DataFrame:
    failure = F.when(F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code")))
    return t.jobs.select("id", failure.alias("failure")).select("id", F.col("failure").isNotNull().alias("failed"), F.col("failure.code").alias("code"))


@query("SELECT id, CASE WHEN remote_url LIKE '%//github.com/%' THEN 'github' WHEN remote_url LIKE '%//gitlab.com/%' THEN 'gitlab' WHEN remote_url LIKE '%//bitbucket.org/%' THEN 'bitbucket' ELSE 'generic' END AS provider FROM {repositories}")
def prj_provider(t: Tables) -> DataFrame:
    return t.repositories.select("id", provider(F.col("remote_url")).alias("provider"))


@query("SELECT id, CASE WHEN remote_url LIKE 'https://%' AND remote_url NOT LIKE '%@%' AND remote_url NOT LIKE '%?%' THEN replace(regexp_replace(remote_url, '/+$', ''), 'git.Example', 'git.example') END AS url FROM {repositories}")
def prj_normalize_url(t: Tables) -> DataFrame:
    return t.repositories.select("id", normalized_url(F.col("remote_url")).alias("url"))


# Sources and sinks.


@query("SELECT id, path FROM {files} WHERE organization_id = 2 AND id = 102")
def src_point_lookup(t: Tables) -> DataFrame:
    from cairn.scope import Scope

    return Scope(2).of(t.files).filter("id = 102").select("id", "path")


#: Files seen by jobs of scopes (one in five), with jobs that counted all, one too many or nothing.
SNAPSHOT_FILES = """SELECT p_partkey AS id, p_partkey % 500 AS scope, CASE WHEN p_partkey % 13 = 0 THEN 'deleted' ELSE 'active' END AS status, p_partkey % 500 + CASE WHEN p_partkey % 700 = 1 THEN 1 ELSE 0 END AS last_job_id, CASE WHEN p_partkey % 900 <> 2 THEN p_partkey + 1000 END AS hash_id FROM {part}"""
SNAPSHOT_JOBS = """SELECT o_orderkey AS id, o_orderkey AS scope, CASE o_orderstatus WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status, coalesce(n.n, 0) + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS total_files
    FROM {orders} LEFT JOIN (SELECT p_partkey % 500 AS s, count(*) AS n FROM {part} WHERE p_partkey % 13 <> 0 GROUP BY 1) AS n ON n.s = o_orderkey"""


@query(
    f"""WITH f AS ({SNAPSHOT_FILES.replace("{part}", "part")}), j AS ({SNAPSHOT_JOBS.replace("{part}", "part").replace("{orders}", "orders")})
    SELECT id, CASE WHEN status <> 'succeeded' THEN 'unfinished' WHEN (SELECT count(*) FROM f WHERE f.scope = j.scope AND f.status = 'active') = total_files
        AND (SELECT count(*) FROM f WHERE f.scope = j.scope AND f.status = 'active' AND f.last_job_id = j.id AND f.hash_id IS NOT NULL) = total_files THEN 'ready' ELSE 'stale' END AS state FROM j"""
)
def src_code_snapshot(t: Tables) -> DataFrame:
    return g.snapshots(t.spark.sql(SNAPSHOT_JOBS, part=t.part, orders=t.orders), t.spark.sql(SNAPSHOT_FILES, part=t.part)).select("id", "state")


NESTED = "coalesce(string_agg(CAST({x}.id AS STRING) || ':' || coalesce({x}.kind, ''), ',' ORDER BY {x}.start_offset, {x}.id, {x}.kind), '')"


@query(
    f"""WITH f AS (SELECT id FROM {{files}} WHERE id > 20 ORDER BY id LIMIT 250), d AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey % 250 AS hash_id, l_returnflag AS kind, l_suppkey AS start_offset FROM lineitem)
    SELECT f.id, (SELECT {NESTED.replace("{x}", "s")} FROM {{symbols}} s WHERE s.indexed_file_id = f.id) AS symbols, (SELECT {NESTED.replace("{x}", "d")} FROM d WHERE d.hash_id = f.id) AS dependencies FROM f"""
)
def src_stream_files(t: Tables) -> DataFrame:
    """One page of a keyset scan, with nested symbols and dependencies."""
    symbols = t.symbols.select(F.col("indexed_file_id").alias("hash_id"), "start_offset", "id", "kind")
    dependencies = t.lineitem.select((F.col("l_orderkey") % 250).alias("hash_id"), F.col("l_suppkey").alias("start_offset"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("kind"))
    page = g.after(t.files.select("id", F.col("id").alias("hash_id")), 20)
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.coalesce(x["kind"], F.lit("")))), ",")
    return g.code_files(page, symbols, dependencies).select("id", said("symbols").alias("symbols"), said("dependencies").alias("dependencies"))


@query("SELECT CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END) * 1024 AS BIGINT) AS bytes FROM part")
def src_repo_size(t: Tables) -> DataFrame:
    lines = t.part.select(F.concat_ws(": ", F.when(F.col("p_partkey") % 3 == 0, "size-pack").otherwise("count"), F.col("p_size").cast("string")).alias("line"))
    from cairn.sources.git import repository_bytes

    return repository_bytes(lines)


@query("SELECT path, object_id FROM {inventory} UNION ALL SELECT DISTINCT path, 'new' FROM {tree} t WHERE NOT EXISTS (SELECT 1 FROM {inventory} k WHERE k.path = t.path)")
def sink_insert_ignore(t: Tables) -> DataFrame:
    return r.insert_ignore(t.inventory.select("path", "object_id"), t.tree.select("path", F.lit("new").alias("object_id")), ["path"])


@query("SELECT k.path, coalesce(t.object_id, k.object_id) AS object_id FROM {inventory} k LEFT JOIN {tree} t ON t.path = k.path UNION ALL SELECT t.path, t.object_id FROM {tree} t WHERE NOT EXISTS (SELECT 1 FROM {inventory} k WHERE k.path = t.path)")
def sink_upsert_docs(t: Tables) -> DataFrame:
    return r.upsert(t.inventory.select("path", "object_id"), t.tree.select("path", "object_id"), ["path"], "object_id")


@query("SELECT id, array_to_string(list_filter([trim(title), trim(coalesce(kind, '')), trim(content)], lambda x: x <> ''), chr(10)) AS content FROM {search_documents}")
def pj_join_content(t: Tables) -> DataFrame:
    return t.search_documents.select("id", joined([F.col("title"), F.col("kind"), F.col("content")]).alias("content"))


@query("SELECT id, replace(content, chr(0), ' ') AS content FROM {search_documents}")
def pj_sanitize(t: Tables) -> DataFrame:
    return t.search_documents.select("id", sanitized(F.col("content")).alias("content"))


@query("SELECT id, left(content, 512) AS title FROM {search_documents}")
def pj_truncate_chars(t: Tables) -> DataFrame:
    return t.search_documents.select("id", F.left("content", F.lit(512)).alias("title"))
