"""Queries of sources: version control listings, parsed code, storage and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import normalized
from cairn.operators import knowledge as kn
from cairn.operators.rules import Limits, exceeded, measured
from cairn.operators.states import state_facts
from cairn.plans.packs import packed
from cairn.plans.registry import Tables, query
from cairn.plans.search import norm
from cairn.sources import git
from cairn.sources.git_objects import objects
from cairn.sources.store import Store, digest, scratch, stored
from cairn.sources.typescript import parsed


def _parts(t: Tables, name: str) -> DataFrame:
    return parsed(t.sources, only=[name]).select("id", F.explode(name).alias("x")).select("id", "x.*")


K = "'K' || CAST(p_partkey AS STRING)"
S = "'S' || CAST(p_partkey AS STRING) || 'Status'"
OPEN = "SELECT p_partkey AS id, 'function' AS kind, 'open' AS qualified_name, FALSE AS exported FROM part WHERE p_partkey % 10 = 0"


@query(
    f"""SELECT p_partkey AS id, 'class' AS kind, {K} AS qualified_name, TRUE AS exported FROM part UNION ALL SELECT p_partkey, 'method', {K} || '.constructor', FALSE FROM part
    UNION ALL SELECT p_partkey, 'method', {K} || '.run', FALSE FROM part UNION ALL SELECT p_partkey, 'enum', {S}, TRUE FROM part UNION ALL {OPEN}"""
)
def ing_parse_symbols(t: Tables) -> DataFrame:
    return _parts(t, "symbols").select("id", "kind", "qualified_name", "exported")


@query(f"SELECT p_partkey AS id, {K} || '.run' AS qualified_name, 'protected' AS visibility, 'protected run(x: string): void' AS signature, 'Loads.' AS documentation FROM part")
def ing_parse_visibility(t: Tables) -> DataFrame:
    return _parts(t, "symbols").filter("name = 'run'").select("id", "qualified_name", "visibility", "signature", "documentation")


@query("SELECT p_partkey AS id, './m' || CAST(p_partkey % 50 AS STRING) AS module, 'Def' || CAST(p_partkey % 7 AS STRING) AS default_import, 'B,C' AS names FROM part")
def ing_parse_imports(t: Tables) -> DataFrame:
    return _parts(t, "imports").select("id", "module", "default_import", F.array_join(F.transform("named", lambda n: n["local"]), ",").alias("names"))


@query(f"SELECT p_partkey AS id, 'declaration' AS kind, {K} AS exported FROM part UNION ALL SELECT p_partkey, 'declaration', {S} FROM part UNION ALL SELECT p_partkey, 'all', NULL FROM part WHERE p_partkey % 10 <> 0")
def ing_parse_exports(t: Tables) -> DataFrame:
    return _parts(t, "exports").select("id", "kind", "exported")


@query(f"SELECT p_partkey AS id, {K} AS source, 'extends' AS kind, 'ns.Base' || CAST(p_size AS STRING) AS target FROM part")
def ing_parse_heritage(t: Tables) -> DataFrame:
    return _parts(t, "heritage").select("id", "source", "kind", "target")


@query("SELECT p_partkey AS id, 'unclosed ' || chr(123) AS diagnostic FROM part WHERE p_partkey % 10 = 0")
def ing_parse_diag(t: Tables) -> DataFrame:
    return parsed(t.sources, only=["diagnostics"]).select("id", F.explode("diagnostics").alias("diagnostic"))


#: What the files of sources and of technical_sources hold: fact, detail, receiver, member, arguments, optional, target_kind, target_name, token, type_name, literals, module_metadata, container, and the text of it.
TECHNICAL = """w AS (SELECT id, text, 'W' || CAST(id - 1000000000 AS STRING) AS c, id - 1000000000 AS k FROM {technical_sources} WHERE path NOT LIKE '%.json'),
    s AS (SELECT id, text, 'K' || CAST(id AS STRING) AS c, id AS k FROM {sources}), held AS (
        SELECT id, text, 'call' AS fact, 'this.repo.load' || CAST(k % 3 AS STRING) AS detail, 'this.repo' AS receiver, 'load' || CAST(k % 3 AS STRING) AS member, 1 AS arguments, FALSE AS optional, NULL AS target_kind, NULL AS target_name, NULL AS token, NULL AS type_name, NULL AS literals, NULL AS module_metadata,
            c || '.run' AS container, 'this.repo.load' || CAST(k % 3 AS STRING) || '(x)' AS own FROM s
        UNION ALL SELECT id, text, 'call', 'this.bus.emit', 'this.bus', 'emit', 2, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, c || '.run', 'this.bus.emit(' || chr(39) || 'e' || CAST(k % 11 AS STRING) || chr(39) || ', x)' FROM s
        UNION ALL SELECT id, text, 'decorator', c || ':Injectable', NULL, NULL, NULL, NULL, 'class', c, NULL, NULL, '[]', NULL, c, '@Injectable()' FROM s
        UNION ALL SELECT id, text, 'injection', regexp_extract(text, 'repo: (Repo[0-9]+)', 1).replace('Repo', 'repo:Repo'), NULL, NULL, NULL, FALSE, NULL, regexp_extract(text, 'repo: (Repo[0-9]+)', 1), NULL, regexp_extract(text, 'repo: (Repo[0-9]+)', 1), NULL, NULL,
            c || '.constructor', regexp_extract(text, 'private readonly repo: Repo[0-9]+') FROM s
        UNION ALL SELECT id, text, 'decorator', c || ':Module', NULL, NULL, NULL, NULL, 'class', c, NULL, NULL, '[]', '<o>"controllers":[],"imports":["ns.M' || CAST(k % 5 AS STRING) || '"],"providers":["P' || CAST(k % 7 AS STRING) || '"]<c>', c, split_part(text, chr(10), 1) FROM w
        UNION ALL SELECT id, text, 'decorator', 'size:Prop', NULL, NULL, NULL, NULL, 'property', 'size', NULL, NULL, '["p",2,true]', NULL, c, replace('@Prop(#p#, 2, true, x)', '#', chr(39)) FROM w
        UNION ALL SELECT id, text, 'decorator', 'a:Inject', NULL, NULL, NULL, NULL, 'parameter', 'a', NULL, NULL, '["T' || CAST(k % 3 AS STRING) || '"]', NULL, c || '.constructor', '@Inject(' || chr(39) || 'T' || CAST(k % 3 AS STRING) || chr(39) || ')' FROM w
        UNION ALL SELECT id, text, 'decorator', 'a:Optional', NULL, NULL, NULL, NULL, 'parameter', 'a', NULL, NULL, '[]', NULL, c || '.constructor', '@Optional()' FROM w
        UNION ALL SELECT id, text, 'decorator', 'b:Inject', NULL, NULL, NULL, NULL, 'parameter', 'b', NULL, NULL, '[]', NULL, c || '.constructor', '@Inject(cfg.KEY)' FROM w
        UNION ALL SELECT id, text, 'decorator', 'run:web.Get', NULL, NULL, NULL, NULL, 'method', 'run', NULL, NULL, '["/x"]', NULL, c || '.run', replace('@web.Get(#/x#)', '#', chr(39)) FROM w
        UNION ALL SELECT id, text, 'decorator', 'id:Param', NULL, NULL, NULL, NULL, 'parameter', 'id', NULL, NULL, '[]', NULL, c || '.run', '@Param()' FROM w
        UNION ALL SELECT id, text, 'injection', 'a:T' || CAST(k % 3 AS STRING), NULL, NULL, NULL, TRUE, NULL, 'T' || CAST(k % 3 AS STRING), 'T' || CAST(k % 3 AS STRING), NULL, NULL, NULL, c || '.constructor', '@Inject(' || chr(39) || 'T' || CAST(k % 3 AS STRING) || chr(39) || ') @Optional() a: any' FROM w
        UNION ALL SELECT id, text, 'injection', 'b:cfg.KEY', NULL, NULL, NULL, FALSE, NULL, 'cfg.KEY', 'cfg.KEY', 'ns.C', NULL, NULL, c || '.constructor', '@Inject(cfg.KEY) b: ns.C' FROM w
        UNION ALL SELECT id, text, 'injection', 'd:Repo' || CAST(k % 4 AS STRING), NULL, NULL, NULL, FALSE, NULL, 'Repo' || CAST(k % 4 AS STRING), NULL, 'Repo' || CAST(k % 4 AS STRING), NULL, NULL, c || '.constructor', 'd?: Repo' || CAST(k % 4 AS STRING) FROM w
        UNION ALL SELECT id, text, 'call', 'this.d.load', 'this.d', 'load', 2, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, c || '.run', 'this.d?.load(id, 1)' FROM w
        UNION ALL SELECT id, text, 'call', NULL, NULL, NULL, 1, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, c || '.run', 'list[0](id)' FROM w
        UNION ALL SELECT id, text, 'diagnostic', 'unsupported_computed_call_target', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, c || '.run', 'list[0](id)' FROM w
        UNION ALL SELECT id, text, 'call', 'make', NULL, 'make', 1, FALSE, NULL, NULL, NULL, NULL, NULL, NULL, c || '.run', 'make<A>(id)' FROM w
        UNION ALL SELECT id, text, 'call', 'super.run', 'super', 'run', 1, TRUE, NULL, NULL, NULL, NULL, NULL, NULL, c || '.run', 'super.run?.(id)' FROM w
    )"""


@query(f"WITH {TECHNICAL} SELECT * EXCLUDE (text, own), CASE WHEN fact = 'call' THEN detail IS NULL END AS dynamic, strpos(text, own) - 1 AS start_offset, strpos(text, own) - 1 + length(own) AS end_offset FROM held")
def ana_technical(t: Tables) -> DataFrame:
    """Call sites, decorators with the metadata of modules, and constructor injections of TypeScript and JavaScript; and a diagnostic for each call whose target is computed."""
    files = t.sources.unionByName(t.technical_sources)
    files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin("ts", "tsx", "js", "jsx"))
    own = parsed(files, only=["technical"]).select("id", F.explode("technical").alias("x")).select("id", "x.*")
    detail = F.when(F.col("fact") == "decorator", F.concat_ws(":", "target_name", "name")).when(F.col("fact") == "injection", F.concat_ws(":", "name", "target_name")).otherwise(F.col("name"))
    return own.select(
        "id", "fact", detail.alias("detail"), "receiver", "member", "arguments", "optional", F.when(F.col("fact") == "call", F.col("name").isNull()).alias("dynamic"), "target_kind", "target_name", "token", "type_name",
        "literals", "module_metadata", "container", F.col("offset").alias("start_offset"), "end_offset",
    )


ROUNDED = "SELECT p_partkey AS id, 'rounding_call' AS outcome_kind, NULL AS condition, 'o,rate,total' AS outcome, 'Math.round' AS operation, 'due' AS target FROM part UNION ALL SELECT p_partkey, 'rounding_call', NULL, '', 'price.toFixed', 'return' FROM part"


@query(
    f"""SELECT p_partkey AS id, 'throw' AS outcome_kind, 'role,user,x' AS condition, 'Denied,x' AS outcome, NULL AS operation, NULL AS target FROM part
    UNION ALL SELECT p_partkey + 1000000000, 'assignment', CASE p_partkey % 3 WHEN 0 THEN 'Open,Status' || CAST(p_partkey % 7 AS STRING) || ',o,status' ELSE 'state' END, CASE p_partkey % 3 WHEN 0 THEN 'Paid,Status' || CAST(p_partkey % 7 AS STRING) || ',o,status' ELSE 'state' END,
        '=', CASE p_partkey % 3 WHEN 0 THEN 'o.status' ELSE 'this.state' END FROM part WHERE p_partkey % 3 < 2
    UNION ALL SELECT p_partkey + 1000000000, 'assignment', 'Open,Status,o,ok,status', 'Status' || CAST(p_partkey % 7 AS STRING) || ',Void,o,status', '=', 'o.status' FROM part WHERE p_partkey % 3 = 2
    UNION ALL SELECT id + 1000000000, outcome_kind, condition, outcome, operation, target FROM ({ROUNDED})"""
)
def ana_rule_extract(t: Tables) -> DataFrame:
    """Guards with what follows where they hold, and calls that round."""
    read = parsed(t.sources.select("id", "text").unionByName(t.machines.select((F.col("id") + 1_000_000_000).alias("id"), "text")), only=["guards", "roundings"])
    guards = F.transform("guards", lambda g: F.struct(g["outcome_kind"].alias("outcome_kind"), F.array_join(g["condition"], ",").alias("condition"), F.array_join(g["outcome"], ",").alias("outcome"), g["outcome_operation"].alias("operation"), g["outcome_target"].alias("target")))
    rounded = F.transform("roundings", lambda r: F.struct(F.lit("rounding_call").alias("outcome_kind"), F.lit(None).cast("string").alias("condition"), F.array_join(r["identifiers"], ",").alias("outcome"), r["operation"].alias("operation"), r["target"].alias("target")))
    return read.select("id", F.explode(F.concat(guards, rounded)).alias("x")).select("id", "x.*")


SK = lambda state_set, name: f"""'state:' || sha256('["' || lower({state_set}) || '","' || lower({name}) || '"]')"""
#: States and transitions of the machines: which of its three kinds a file is follows from its key.
MACHINES = f"""m AS (SELECT p_partkey AS k, 'Status' || CAST(p_partkey % 7 AS STRING) AS e, 'M' || CAST(p_partkey AS STRING) AS c, 'src/m' || CAST(p_partkey AS STRING) || '.ts' AS path, 'done-' || CAST(p_partkey % 5 AS STRING) AS d FROM part),
    st AS (
        SELECT k, e AS value, 'Open' AS name, 100 AS sure, 2 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS n FROM m
        UNION ALL SELECT k, e, 'Paid', 100, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END FROM m UNION ALL SELECT k, e, 'Void', 100, CASE WHEN k % 3 = 2 THEN 2 ELSE 1 END FROM m
        UNION ALL SELECT k, 'this.state', d, 90, 1 FROM m WHERE k % 3 = 1 UNION ALL SELECT k, 'this.state', 'open', 90, 1 FROM m WHERE k % 3 = 1
    ), mv AS (
        SELECT k, path, c || '.step' AS container, 'status' AS field, 'o' AS subject, e AS fs, 'Open' AS fn, e AS ts, 'Paid' AS tn, 100 AS sure, TRUE AS det, 0 AS nth FROM m WHERE k % 3 = 0
        UNION ALL SELECT k, path, c || '.step', 'state', 'this', 'this.state', 'open', 'this.state', d, 90, FALSE, 0 FROM m WHERE k % 3 = 1
        UNION ALL SELECT k, path, c || '.step', 'status', 'o', NULL, NULL, e, 'Void', 100, FALSE, 0 FROM m WHERE k % 3 = 2
        UNION ALL SELECT k, path, c || '.reset', 'status', 'this', NULL, NULL, e, 'Open', 100, FALSE, 0 FROM m
        UNION ALL SELECT k, path, c || '.reset', 'status', 'this', NULL, NULL, e, 'Open', 100, FALSE, 1 FROM m WHERE k % 4 = 0
    ), keyed AS (SELECT *, CASE WHEN fn IS NOT NULL THEN {SK("fs", "fn")} END AS fk, {SK("ts", "tn")} AS tk FROM mv),
    moves AS (
        SELECT *, 'state_transition:' || sha256('["' || path || '","' || replace('<o>"containingSymbol":"' || container || '","field":"' || field || '","from":' || coalesce('"' || fk || '"', 'null') || ',"subject":"' || subject || '","to":"' || tk || '"<c>', '"', chr(92) || '"') || '","' || CAST(nth AS STRING) || '"]') AS identity_key
        FROM keyed
    )"""


@query(
    f"""WITH {MACHINES} SELECT k AS id, 'state' AS kind, {SK("value", "name")} AS identity_key, name, value, NULL AS source_key, NULL AS target_key, NULL AS container, CAST(sure AS BIGINT) AS confidence_pct, sure = 100 AS deterministic, CAST(n AS BIGINT) AS evidence FROM st
    UNION ALL SELECT k, 'state_transition', identity_key, fn, tn, fk, tk, container, sure, det, CASE WHEN fk IS NULL THEN 1 ELSE 2 END FROM moves"""
)
def ana_state(t: Tables) -> DataFrame:
    facts, evidence = state_facts(machines_read(t))
    first = evidence.groupBy("fact_id").agg(F.min("file_id").alias("id"), F.count(F.lit(1)).alias("evidence"))
    # both grow with the sources, though they may be small when stored: no side is for the driver to hold
    return facts.join(first.hint("merge"), "fact_id").select("id", "kind", "identity_key", "name", "value", "source_key", "target_key", "container", "confidence_pct", "deterministic", "evidence")


def machines_read(t: Tables) -> DataFrame:
    return stored(parsed(t.machines, only=["states", "transitions"], keep=["path"]), "parsed")


@query(
    f"""WITH {MACHINES} SELECT 'node' AS part, 'state' AS kind, {SK("value", "name")} AS identity_key, any_value(value || '.' || name) AS name, NULL AS source_key, NULL AS target_key, CAST(max(sure) AS BIGINT) AS confidence_pct, bool_or(sure = 100) AS deterministic, CAST(sum(n) AS BIGINT) AS evidence FROM st GROUP BY value, name
    UNION ALL SELECT 'node', 'state_transition', identity_key, coalesce(fn || ' ', '') || '→ ' || tn, NULL, NULL, sure, det, CASE WHEN fk IS NULL THEN 1 ELSE 2 END FROM moves
    UNION ALL SELECT DISTINCT 'edge', 'transitions_to', 'knowledge_edge:' || sha256('["' || fk || '","' || tk || '","transitions_to"]'), NULL, fk, tk, sure, det, 2 FROM moves WHERE fk IS NOT NULL"""
)
def kg_state_machines(t: Tables) -> DataFrame:
    """Sources to a graph of states: the reader's facts through the projector of states."""
    facts, evidence = state_facts(machines_read(t))
    return kn.flat(kn.states(stored(facts, "facts"), stored(evidence, "evidence")))


@query("SELECT p_partkey AS id, 'e' || CAST(p_partkey % 11 AS STRING) AS event, 'emit' AS operation FROM part")
def ana_event(t: Tables) -> DataFrame:
    return _parts(t, "events").select("id", "event", "operation")


@query("SELECT mode, object_id, size_bytes, path FROM {tree} WHERE mode <> '120000'")
def src_git_tree(t: Tables) -> DataFrame:
    kind = F.when(F.col("mode") == "120000", "commit").otherwise("blob")
    lines = t.tree.select(F.concat(F.col("mode"), F.lit(" "), kind, F.lit(" "), F.col("object_id"), F.lit("    "), F.col("size_bytes").cast("string"), F.lit("\t"), F.col("path")).alias("value"))
    return git.tree_entries(lines)


@query("SELECT name, substr(head || head, 1, 40) AS head FROM {branches} WHERE status = 'active'")
def src_git_refs(t: Tables) -> DataFrame:
    head = F.substring(F.concat("head", "head"), 1, 40)
    lines = t.branches.select(F.concat(head, F.lit("\t"), F.when(F.col("status") == "active", "refs/heads/").otherwise("refs/tags/"), F.col("name")).alias("value"))
    return git.refs(lines)


@query(
    """SELECT repository_id, arg_max(name, id) AS default_branch, arg_max(substr(head || head, 1, 40), id) AS head FROM {branches} WHERE id % 7 <> 0 GROUP BY 1
    UNION ALL SELECT repository_id, NULL, NULL FROM {branches} GROUP BY 1 HAVING bool_and(id % 7 = 0)"""
)
def wr_remote_probe(t: Tables) -> DataFrame:
    """The default branch of each repository, from the listing of its branches; one of seven branches can't be it."""
    able = F.when(F.col("id") % 7 != 0, F.col("id"))
    first = t.branches.groupBy("repository_id").agg(F.max(able).alias("first"))
    head = F.substring(F.concat("head", "head"), 1, 40)
    own = F.when(F.col("id") == F.col("first"), F.array(F.concat(F.lit("ref: refs/heads/"), F.col("name"), F.lit("\tHEAD")), F.concat(head, F.lit("\tHEAD")))).otherwise(F.array().cast("array<string>"))
    lines = t.branches.join(first, "repository_id").select("repository_id", F.explode(F.concat(own, F.array(F.concat(head, F.lit("\trefs/heads/"), F.col("name"))))).alias("value"))
    return git.remote_probe(lines, "repository_id")


BLOB = "sha1('blob ' || CAST(strlen(html) AS VARCHAR) || chr(0) || html)"


@query(f"SELECT DISTINCT {BLOB} AS object_id, 'blob' AS type, strlen(html) AS size, CASE WHEN strlen(html) <= 5000 THEN sha256(html) END AS content_sha256, strlen(html) <= 5000 AS readable FROM pages")
def src_git_blob(t: Tables) -> DataFrame:
    """Pages as blobs of a repository, some of them deltas, read back from its packs."""
    root = packed(t.pages.select(F.col("html").cast("binary").alias("content")))
    own = objects(t.spark, root, 5000, "blob", part_objects="50")
    readable = F.coalesce(git.readable(F.col("content").cast("string"), 5000), F.lit(False))
    return own.select("object_id", "type", "size", F.sha2("content", 256).alias("content_sha256"), readable.alias("readable"))


@query("SELECT page_id AS id FROM pages WHERE strlen(html) <= 9000 AND page_id % 2 = 0")
def src_source_text(t: Tables) -> DataFrame:
    # what was read must be the object that was asked for: here, the even ones
    same = F.md5("html") == F.when(F.col("page_id") % 2 == 0, F.md5("html")).otherwise(F.lit("another"))
    return t.pages.filter(git.readable(F.col("html"), 9000) & same).select(F.col("page_id").alias("id"))


@query("SELECT doc_id AS id, strlen(text) > 2000 AS refused FROM documents")
def wr_parse_guard(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), (~git.readable(F.col("text"), 2000)).alias("refused"))


@query(f"SELECT doc_id AS id, length(q) <= 200 AND {norm('q')} <> '' AS accepted FROM (SELECT doc_id, trim(CASE WHEN doc_id % 5 = 0 THEN ' --- ' ELSE text END) AS q FROM documents)")
def sea_validate(t: Tables) -> DataFrame:
    q = F.trim(F.when(F.col("doc_id") % 5 == 0, " --- ").otherwise(F.col("text")))
    return t.documents.select(F.col("doc_id").alias("id"), ((F.length(q) <= 200) & (normalized(q) != "")).alias("accepted"))


@query(
    """WITH per AS (
        SELECT CAST(indexed_file_id AS VARCHAR) AS scope, 'symbols_per_file' AS "limit", count(*) AS value FROM {symbols} GROUP BY 1
        UNION ALL SELECT CAST(source_indexed_file_id AS VARCHAR), 'dependencies_per_file', count(*) FROM {code_dependencies} GROUP BY 1
        UNION ALL SELECT path, 'path_length', length(path) FROM {files} UNION ALL SELECT path, 'path_depth', len(string_split(path, '/')) FROM {files} UNION ALL SELECT path, 'file_bytes', size_bytes FROM {files}
        UNION ALL SELECT CAST(id AS VARCHAR), 'document_bytes', strlen(content) FROM {search_documents}
        UNION ALL SELECT NULL, 'files', count(*) FROM {files} UNION ALL SELECT NULL, 'total_bytes', sum(size_bytes) FROM {files}
        UNION ALL SELECT NULL, 'search_documents', count(*) FROM {search_documents} UNION ALL SELECT NULL, 'content_bytes', sum(strlen(content)) FROM {search_documents}
    ), most AS (SELECT unnest(['symbols_per_file', 'dependencies_per_file', 'path_length', 'path_depth', 'file_bytes', 'document_bytes', 'files', 'total_bytes', 'search_documents', 'content_bytes']) AS "limit", unnest([40, 620, 40, 3, 6000, 6000, 100, 100000, 1000000, 1000000]) AS most)
    SELECT scope, "limit", CAST(value AS BIGINT) AS value, CAST(most AS BIGINT) AS most FROM per JOIN most USING ("limit") WHERE value > most"""
)
def dq_limits(t: Tables) -> DataFrame:
    limits = Limits(symbols_per_file=40, dependencies_per_file=620, path_length=40, path_depth=3, file_bytes=6000, document_bytes=6000, files=100, total_bytes=100_000, search_documents=1_000_000, content_bytes=1_000_000)
    count = F.count(F.lit(1))
    of = lambda df, key, **sizes: measured(df.groupBy(key).agg(count.alias("n")), key, **sizes)
    parts = [
        of(t.symbols, "indexed_file_id", symbols_per_file=F.col("n")), of(t.code_dependencies, "source_indexed_file_id", dependencies_per_file=F.col("n")),
        measured(t.files, "path", path_length=F.length("path"), path_depth=F.size(F.split("path", "/")), file_bytes=F.col("size_bytes")), measured(t.search_documents, "id", document_bytes=F.octet_length("content")),
        measured(t.files, files=count, total_bytes=F.sum("size_bytes")), measured(t.search_documents, search_documents=count, content_bytes=F.sum(F.octet_length("content"))),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return exceeded(every, limits)


@query("SELECT id, CASE WHEN status = 'running' AND worker = 'w1' THEN 'hashing' ELSE phase END AS phase, CASE WHEN status = 'running' AND worker = 'w1' THEN processed_files + 10 ELSE processed_files END AS processed_files FROM {jobs}")
def job_phase_progress(t: Tables) -> DataFrame:
    own = (F.col("status") == "running") & (F.col("worker") == "w1")
    return t.jobs.select("id", F.when(own, "hashing").otherwise(F.col("phase")).alias("phase"), F.when(own, F.col("processed_files") + 10).otherwise(F.col("processed_files")).alias("processed_files"))


def _store(t: Tables) -> Store:
    return Store(t.spark, scratch(t.spark, "store"))


@query("SELECT id, source_type, TRUE AS within_chunk FROM {search_documents}")
def sink_chunked_save(t: Tables) -> DataFrame:
    store = _store(t)
    store.write(1, t.search_documents.select("id", "source_type"), 500)
    own = store.read(1).withColumn("file", F.input_file_name())
    sizes = own.groupBy("file").agg((F.count(F.lit(1)) <= 500).alias("within_chunk"))
    return own.join(sizes, "file").select("id", "source_type", "within_chunk")


@query("SELECT id FROM {search_documents} WHERE source_type = 'file'")
def pj_reset(t: Tables) -> DataFrame:
    store = _store(t)
    store.write(1, t.search_documents.select("id"))
    store.reset(1)
    store.write(1, t.search_documents.filter("source_type = 'file'").select("id"))
    return store.read(1)


@query("SELECT TRUE AS refused")
def dq_immutable(t: Tables) -> DataFrame:
    from cairn.sources.store import ImmutableVersion

    store = _store(t)
    store.write(1, t.roles)
    store.publish(1)
    try:
        store.write(1, t.roles)
        refused = False
    except ImmutableVersion:
        refused = True
    return t.spark.range(1).select(F.lit(refused).alias("refused"))


@query("SELECT sha256('{\"a\":[1,null],\"b\":\"x\"}') AS digest".replace("{", "<o>").replace("}", "<c>"))
def pj_digest(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(digest({"b": "x", "a": [1.0, None]})).alias("digest"))


@query("SELECT TRUE AS refused, TRUE AS released")
def pj_lock(t: Tables) -> DataFrame:
    from cairn.sources.store import lock

    name = f"branch-{id(t)}"
    with lock(name):
        try:
            with lock(name):
                refused = False
        except RuntimeError:
            refused = True
    with lock(name):
        released = True
    return t.spark.range(1).select(F.lit(refused).alias("refused"), F.lit(released).alias("released"))
