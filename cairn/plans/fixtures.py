"""The engine's datasets derived from the driver's tables, in SQL that Spark and DuckDB read alike.

Only integer arithmetic and CASE derive columns, so both engines agree. Names in braces are driver
tables or other fixtures.
"""

FIXTURES: dict[str, str] = {
    "search_documents": """
        SELECT doc_id AS id, CAST(1 AS BIGINT) AS search_index_id, 'symbol' AS source_type, source || '_' || lang || CAST(doc_id % 50 AS STRING) AS name,
            substr(text, 1, 24) AS title, text AS content, source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path, lang AS language,
            CASE doc_id % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS kind,
            doc_id % 100 AS indexed_file_id, doc_id % 100 + 1000 AS file_hash_id, doc_id AS code_symbol_id, CAST(NULL AS BIGINT) AS knowledge_node_id
        FROM {documents}
        UNION ALL
        SELECT page_id + 100000000, CAST(1 AS BIGINT), 'file', '', url, html, url, 'html', CAST(NULL AS STRING), page_id, page_id + 1000, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM {pages}
        UNION ALL
        SELECT item_id + 200000000, CAST(1 AS BIGINT), 'knowledge_node', 'item' || CAST(item_id AS STRING), substr(text, 1, 24), text, CAST(NULL AS STRING), CAST(NULL AS STRING), 'domain_concept',
            CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), item_id FROM {benchmark}
    """,
    "code_dependencies": """
        SELECT l_orderkey * 100 + l_linenumber AS id, l_partkey % 5 AS organization_id,
            CASE l_linenumber % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'export' WHEN 2 THEN 'extends' ELSE 'implements' END AS kind,
            CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS source_symbol_id, l_suppkey AS source_indexed_file_id, l_suppkey + 1000 AS source_file_hash_id,
            CASE WHEN l_returnflag <> 'N' THEN l_orderkey % 997 END AS target_symbol_id,
            CASE WHEN l_linestatus = 'O' THEN l_partkey % 250 END AS target_indexed_file_id, CASE WHEN l_linestatus = 'O' THEN l_partkey % 250 + 1000 END AS target_file_hash_id
        FROM {lineitem}
    """,
    "knowledge_edges": """
        SELECT o_orderkey AS id, o_custkey % 5 AS snapshot_id, (o_orderkey * 7) % 40 AS source_node_id, o_custkey % 40 AS target_node_id,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'calls' WHEN '2-HIGH' THEN 'depends_on' WHEN '3-MEDIUM' THEN 'contains' WHEN '4-NOT SPECIFIED' THEN 'triggers' ELSE 'enforces' END AS kind,
            o_orderkey % 100 AS confidence_pct
        FROM {orders}
    """,
    "seeds": """
        SELECT id AS seed_id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS seed_order, code_symbol_id, indexed_file_id, file_hash_id, knowledge_node_id
        FROM {search_documents} WHERE id IN (3, 8, 21, 40, 77, 100000001, 100000005, 200000002, 200000007, 200000011)
    """,
    "nodes": """
        SELECT p_partkey AS id, CAST(p_size % 5 AS BIGINT) AS snapshot_id, p_type || ':' || CAST(p_partkey AS STRING) AS identity_key, p_name AS name,
            CASE p_size % 5 WHEN 0 THEN 'architectural_component' WHEN 1 THEN 'workflow' WHEN 2 THEN 'domain_concept' WHEN 3 THEN 'business_rule' ELSE 'domain_event' END AS kind,
            p_size AS size, p_brand AS brand
        FROM {part}
    """,
    "edges": """
        SELECT l_orderkey * 100 + l_linenumber AS id, CAST(l_linenumber % 5 AS BIGINT) AS snapshot_id, l_partkey AS source_node_id, (l_suppkey * 20 + l_linenumber) AS target_node_id,
            CASE l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'contains' ELSE 'triggers' END AS kind, CAST(l_quantity AS BIGINT) AS weight
        FROM {lineitem}
    """,
    "evidence": """
        SELECT o_orderkey AS id, o_custkey % 1000 AS node_id, (o_orderkey * 3) % 250 AS indexed_file_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 4000 END AS start_offset,
            CASE WHEN o_orderkey % 3 = 0 THEN 'primary' ELSE 'supporting' END AS role
        FROM {orders}
    """,
    "files": """
        SELECT page_id AS id, page_id % 5 AS organization_id, substr(url, 9, 60) AS path, CAST(length(html) AS BIGINT) AS size_bytes, page_id + 1000 AS current_file_hash_id,
            CASE WHEN page_id % 11 = 0 THEN 'deleted' ELSE 'active' END AS status
        FROM {pages}
    """,
    "tree": """
        SELECT CASE WHEN p_partkey % 37 = 0 THEN '120000' WHEN p_partkey % 2 = 0 THEN '100644' ELSE '100755' END AS mode,
            CASE p_size % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'dist' WHEN 2 THEN 'lib/Node_Modules' WHEN 3 THEN 'docs/build.d' ELSE 'app/core' END || '/' || replace(p_name, ' ', '-') || CAST(p_partkey AS STRING)
                || CASE p_partkey % 9 WHEN 0 THEN '.ts' WHEN 1 THEN '.TSX' WHEN 2 THEN '.js' WHEN 3 THEN '.md' WHEN 4 THEN '.yml' WHEN 5 THEN '.bin' WHEN 6 THEN '' WHEN 7 THEN '.json' ELSE '.spec.jsx' END AS path,
            p_partkey % 1000 * 3000 AS size_bytes, md5(p_name || CAST(p_partkey AS STRING)) AS object_id
        FROM {part}
    """,
    "inventory": """
        SELECT id, path, object_id, size_bytes, CASE WHEN id % 13 = 0 THEN 'deleted' ELSE 'active' END AS status
        FROM (
            SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'gone/' || CAST(p_partkey AS STRING) ELSE
                CASE p_size % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'dist' WHEN 2 THEN 'lib/Node_Modules' WHEN 3 THEN 'docs/build.d' ELSE 'app/core' END || '/' || replace(p_name, ' ', '-') || CAST(p_partkey AS STRING)
                || CASE p_partkey % 9 WHEN 0 THEN '.ts' WHEN 1 THEN '.TSX' WHEN 2 THEN '.js' WHEN 3 THEN '.md' WHEN 4 THEN '.yml' WHEN 5 THEN '.bin' WHEN 6 THEN '' WHEN 7 THEN '.json' ELSE '.spec.jsx' END END AS path,
                CASE WHEN p_partkey % 4 = 0 THEN 'old' ELSE md5(p_name || CAST(p_partkey AS STRING)) END AS object_id, p_partkey % 1000 * 3000 AS size_bytes
            FROM {part} WHERE p_size <> 7
        ) AS known
    """,
    "symbols": """
        SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS indexed_file_id, p_name AS name, p_brand || '.' || p_name AS qualified_name,
            CASE p_size % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'function' ELSE 'method' END AS kind, p_partkey % 3 = 0 AS exported, p_partkey % 17 = 0 AS default_export,
            p_partkey % 500 * 10 AS start_offset, p_partkey % 500 * 10 + p_size * 40 AS end_offset
        FROM {part}
    """,
    "references_to": """
        SELECT l_orderkey * 100 + l_linenumber AS id, CAST(l_quantity AS BIGINT) AS file_id, l_linenumber,
            CASE WHEN l_linenumber = 1 THEN '*' WHEN l_linenumber = 2 THEN 'default' WHEN l_linenumber = 3 THEN CAST(NULL AS STRING) WHEN l_linenumber = 4 THEN 'Brand#' || CAST(l_suppkey % 25 AS STRING) || '.' || n.n ELSE n.n END AS target_name,
            l_suppkey * 37 % 5000 AS at_offset
        FROM {lineitem} JOIN (SELECT p_partkey AS k, p_name AS n FROM {part}) AS n ON n.k = l_partkey
    """,
    "users": """
        SELECT c_custkey AS id, c_nationkey AS organization_id, c_name AS name, lower(c_name) || '@example.org' AS email,
            CASE c_mktsegment WHEN 'BUILDING' THEN 'invited' WHEN 'MACHINERY' THEN 'disabled' ELSE 'active' END AS status, (c_custkey * 7919) % 10000 AS created
        FROM {customer}
    """,
    "user_roles": """
        SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 8000 THEN 0 WHEN c_acctbal > 4000 THEN 1 ELSE 2 END AS role_id FROM {customer}
        UNION ALL SELECT c_custkey, 3 FROM {customer} WHERE c_custkey % 4 = 0
    """,
    "roles": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, CASE r_regionkey WHEN 0 THEN 'OWNER' WHEN 1 THEN 'ADMIN' WHEN 2 THEN 'MEMBER' WHEN 3 THEN 'AUDITOR' ELSE 'GUEST' END AS name FROM {region}
    """,
    "role_permissions": """
        SELECT CAST(n_regionkey AS BIGINT) AS role_id, CASE n_nationkey % 6 WHEN 0 THEN 'search:read' WHEN 1 THEN 'repository:read' WHEN 2 THEN 'repository:write' WHEN 3 THEN 'users:read' WHEN 4 THEN 'users:write' ELSE 'audit:read' END AS permission
        FROM {nation}
    """,
    "sessions": """
        SELECT event_id AS id, user_id, user_id % 25 AS organization_id, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 31 % 100000 END AS last_used,
            event_id * 17 % 200000 AS expires, CASE WHEN event_type = 'error' THEN event_id % 1000 END AS revoked, event_id % 50 AS token, event_id % 49 AS previous_token
        FROM {events}
    """,
    "audit": """
        SELECT event_id AS id, user_id % 5 AS organization_id, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'failure' ELSE 'success' END AS outcome, ts AS created_at, props
        FROM {events}
    """,
    "jobs": """
        SELECT o_orderkey AS id, o_custkey % 20 AS repository_id, o_custkey % 100 AS branch_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status,
            o_orderkey % 500 AS total_files, o_orderkey % 400 AS processed_files, o_orderkey % 61 AS skipped_files, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 40 ELSE 0 END AS failed_files,
            o_orderkey % 5 AS attempt_count, CAST(3 AS BIGINT) AS max_attempts, o_custkey * 131 % 1000 AS lease_expires, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey * 37 % 1000 END AS next_attempt,
            o_orderkey % 10 = 0 AS cancel_requested, o_orderkey * 7919 % 100000 AS created, o_orderdate AS created_at, CASE WHEN o_orderkey % 9 = 0 THEN 'E' || CAST(o_orderkey % 7 AS STRING) END AS error_code,
            CASE o_orderkey % 4 WHEN 0 THEN 'finalizing' ELSE 'parsing' END AS phase, 'w' || CAST(o_custkey % 3 AS STRING) AS worker
        FROM {orders}
    """,
    "repositories": """
        SELECT s_suppkey AS id, s_nationkey AS organization_id, s_name AS name,
            CASE s_suppkey % 6 WHEN 0 THEN 'https://github.com/Acme/' WHEN 1 THEN 'https://gitlab.com/acme/' WHEN 2 THEN 'https://bitbucket.org/acme/' WHEN 3 THEN 'http://github.com/acme/' WHEN 4 THEN 'https://user@git.example.org/acme/' ELSE 'https://git.Example.org/acme/' END
                || CAST(s_suppkey AS STRING) || CASE s_suppkey % 4 WHEN 0 THEN '/' WHEN 1 THEN '?x=1' WHEN 2 THEN '//' ELSE '' END AS remote_url,
            CASE s_suppkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'synced' ELSE 'failed' END AS status, s_suppkey * 13 % 97 AS created
        FROM {supplier}
    """,
    "branches": """
        SELECT c_custkey AS id, c_custkey % 100 AS repository_id, 'branch-' || CAST(c_custkey AS STRING) AS name, md5(CAST(c_custkey AS STRING)) AS head,
            CASE WHEN c_custkey % 5 = 0 THEN 'deleted' ELSE 'active' END AS status, c_custkey % 3 = 0 AS is_default, c_custkey * 13 % 1000 AS synced
        FROM {customer}
    """,
    "remote_branches": """
        SELECT 'branch-' || CAST(p_partkey * 2 AS STRING) AS name, md5(CAST(p_partkey * 2 + p_size % 2 AS STRING)) AS head FROM {part}
    """,
    "facts": """
        SELECT l_orderkey * 100 + l_linenumber AS ord, l_partkey % 300 AS identity_key, CASE l_linenumber % 3 WHEN 0 THEN 'domain_concept' WHEN 1 THEN 'business_rule' ELSE 'domain_event' END AS kind,
            CAST(l_quantity AS BIGINT) AS confidence_pct, l_returnflag = 'R' AS deterministic, 'n' || CAST(l_suppkey % 9 AS STRING) AS alias, l_suppkey AS evidence_file, l_suppkey % 4 AS fingerprint
        FROM {lineitem}
    """,
    "graph_facts": """
        SELECT p_partkey AS fact_id, 'architecture_component' AS kind, 'c' || CAST(p_partkey AS STRING) AS identity_key, p_name AS name, CAST(NULL AS STRING) AS value, CAST(NULL AS STRING) AS source_key, CAST(NULL AS STRING) AS target_key,
            CAST(NULL AS STRING) AS relation, CAST(NULL AS STRING) AS container, CAST(NULL AS STRING) AS path, TRUE AS resolved, CAST(70 + p_size % 31 AS BIGINT) AS confidence_pct, p_size % 3 = 0 AS deterministic, 'f' || CAST(p_size AS STRING) AS fingerprint
        FROM {part}
        UNION ALL
        SELECT 1000000000 + p_partkey, 'architecture_component', 'c' || CAST(p_partkey AS STRING), p_name, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), TRUE,
            CAST(70 + p_size % 31 AS BIGINT), p_size % 3 = 0, 'f' || CAST(p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS STRING)
        FROM {part} WHERE p_partkey % 101 = 0
        UNION ALL
        SELECT 2000000000 + o_orderkey, 'architecture_relationship', 'r' || CAST(o_orderkey AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), 'c' || CAST(o_custkey AS STRING), 'c' || CAST(o_custkey + o_orderkey % 600 AS STRING),
            CASE o_orderkey % 3 WHEN 0 THEN 'contains' WHEN 1 THEN 'depends_on' ELSE 'calls' END, CAST(NULL AS STRING), CAST(NULL AS STRING), TRUE, CAST(60 + o_orderkey % 41 AS BIGINT), o_orderkey % 2 = 0, 'f' || CAST(o_orderkey % 9 AS STRING)
        FROM {orders}
        UNION ALL
        SELECT 4000000000 + o_orderkey,
            CASE o_orderkey % 6 WHEN 0 THEN 'domain_concept' WHEN 1 THEN 'business_rule' WHEN 2 THEN 'state' WHEN 3 THEN 'state_transition' WHEN 4 THEN 'domain_event' ELSE 'event_handler' END,
            CASE o_orderkey % 6 WHEN 0 THEN 'd' || CAST(o_custkey % 97 AS STRING) WHEN 1 THEN 'rule' || CAST(o_orderkey AS STRING) WHEN 2 THEN 's' || CAST(o_custkey % 50 AS STRING) WHEN 3 THEN 't' || CAST(o_orderkey - CASE WHEN o_custkey % 500 = 0 THEN 6 ELSE 0 END AS STRING)
                WHEN 4 THEN 'e' || CAST(o_custkey % 40 AS STRING) ELSE 'h' || CAST(o_orderkey AS STRING) END,
            CASE o_orderkey % 6 WHEN 0 THEN 'Concept ' || CAST(o_custkey % 97 AS STRING) || CASE WHEN o_custkey % 971 = 0 THEN '!' ELSE '' END WHEN 1 THEN o_orderpriority WHEN 2 THEN 'S' || CAST(o_custkey % 50 AS STRING)
                WHEN 3 THEN CASE WHEN o_custkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'S' || CAST(o_custkey % 53 AS STRING) END WHEN 4 THEN 'ev' || CAST(o_custkey % 40 AS STRING) ELSE 'on' || CAST(o_orderkey AS STRING) END,
            CASE o_orderkey % 6 WHEN 0 THEN 'concept ' || CAST(o_custkey % 97 AS STRING) WHEN 1 THEN 'p' || CAST(o_custkey % 13 AS STRING) || o_orderpriority WHEN 2 THEN 'Set' || CAST(o_custkey % 5 AS STRING) WHEN 3 THEN 'S' || CAST(o_orderkey % 51 AS STRING)
                WHEN 4 THEN 'key' || CAST(o_custkey % 40 AS STRING) ELSE CAST(NULL AS STRING) END,
            CASE WHEN o_orderkey % 6 = 3 AND o_custkey % 4 <> 0 THEN 's' || CAST(o_custkey % 53 AS STRING) END,
            CASE WHEN o_orderkey % 6 = 3 THEN 's' || CAST(o_orderkey % 51 AS STRING) WHEN o_orderkey % 6 = 5 AND o_custkey % 5 <> 0 THEN 'e' || CAST(o_custkey % 41 AS STRING) END,
            CAST(NULL AS STRING), CASE WHEN o_custkey % 3 = 0 THEN 'fn' || CAST(o_custkey % 7 AS STRING) END, CASE WHEN o_custkey % 5 <> 1 THEN 'src/f' || CAST((o_custkey - o_custkey % 8) AS STRING) || '.ts' END,
            o_custkey % 7 <> 0, CAST(50 + o_orderkey % 51 AS BIGINT), o_custkey % 4 = 1, 'f' || CAST(o_orderkey AS STRING)
        FROM {orders}
    """,
    "graph_evidence": """
        SELECT p_partkey AS fact_id, CAST(0 AS BIGINT) AS nth, CAST(p_partkey - p_partkey % 8 AS BIGINT) AS file_id, CAST(p_partkey % 8 * 100 AS BIGINT) AS start_offset, CAST(p_partkey % 8 * 100 + 50 + p_size * 40 AS BIGINT) AS end_offset, 'declaration' AS role FROM {part}
        UNION ALL SELECT 1000000000 + p_partkey, CAST(0 AS BIGINT), CAST(p_partkey - p_partkey % 8 AS BIGINT), CAST(p_partkey % 8 * 100 AS BIGINT), CAST(p_partkey % 8 * 100 + 50 + p_size * 40 AS BIGINT), 'declaration' FROM {part} WHERE p_partkey % 101 = 0
        UNION ALL SELECT 2000000000 + o_orderkey, CAST(0 AS BIGINT), CAST(o_custkey - o_custkey % 8 AS BIGINT), CAST(o_orderkey % 700 AS BIGINT), CAST(o_orderkey % 700 + 9 AS BIGINT), 'injection' FROM {orders}
        UNION ALL SELECT 4000000000 + o_orderkey, CAST(0 AS BIGINT), CAST(o_custkey - o_custkey % 8 AS BIGINT), CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 7 % 5000 AS BIGINT) END, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 7 % 5000 + 20 AS BIGINT) END,
            CASE WHEN o_orderkey % 12 = 4 THEN 'event_publication' ELSE 'call_site' END FROM {orders}
        UNION ALL SELECT 4000000000 + o_orderkey, CAST(1 AS BIGINT), CAST(o_custkey - o_custkey % 8 AS BIGINT), CAST(o_orderkey * 3 % 1000 AS BIGINT), CAST(o_orderkey * 3 % 1000 + 5 AS BIGINT), 'call_site' FROM {orders} WHERE o_orderkey % 2 = 0
    """,
    "sources": """
        SELECT p_partkey AS id, 'src/f' || CAST(p_partkey AS STRING) || '.ts' AS path,
            'import Def' || CAST(p_partkey % 7 AS STRING) || ', ' || chr(123) || ' A as B, type C ' || chr(125) || ' from ' || chr(39) || './m' || CAST(p_partkey % 50 AS STRING) || chr(39) || ';' || chr(10)
            || '@Injectable()' || chr(10) || 'export class K' || CAST(p_partkey AS STRING) || ' extends ns.Base' || CAST(p_size AS STRING) || ' ' || chr(123) || chr(10)
            || '  constructor(private readonly repo: Repo' || CAST(p_size AS STRING) || ') ' || chr(123) || chr(125) || chr(10)
            || '  /** Loads. */' || chr(10) || '  protected run(x: string): void ' || chr(123) || chr(10)
            || '    if (user.role && x) ' || chr(123) || ' throw new Denied(x); ' || chr(125) || chr(10)
            || '    this.repo.load' || CAST(p_partkey % 3 AS STRING) || '(x); this.status = S.Done; this.bus.emit(' || chr(39) || 'e' || CAST(p_partkey % 11 AS STRING) || chr(39) || ', x);' || chr(10)
            || '  ' || chr(125) || chr(10) || chr(125) || chr(10)
            || 'export enum S' || CAST(p_partkey AS STRING) || 'Status ' || chr(123) || ' On, Off ' || chr(125) || chr(10)
            || CASE WHEN p_partkey % 10 = 0 THEN 'function open() ' || chr(123) ELSE 'export * from ' || chr(39) || './all' || chr(39) || '; ' END AS text
        FROM {part}
    """,
    "technical_sources": """
        SELECT 1000000000 + p_partkey AS id, 'src/w' || CAST(p_partkey AS STRING) || CASE p_partkey % 10 WHEN 0 THEN '.json' WHEN 1 THEN '.JSX' ELSE '.ts' END AS path,
            translate('@Module(~ imports: [ns.M' || CAST(p_partkey % 5 AS STRING) || ', Lazy.forRoot()], #providers#: [P' || CAST(p_partkey % 7 AS STRING) || ', ~ provide: X, useValue: make(1) ^], controllers: [], exports: ALL ^)|'
            || 'export class W' || CAST(p_partkey AS STRING) || ' ~|  @Prop(#p#, 2, true, x) size: number;|'
            || '  constructor(@Inject(#T' || CAST(p_partkey % 3 AS STRING) || '#) @Optional() a: any, @Inject(cfg.KEY) b: ns.C, c: string, d?: Repo' || CAST(p_partkey % 4 AS STRING) || ') ~^|'
            || '  @web.Get(#/x#) run(@Param() id: string) ~|    this.d?.load(id, 1); list[0](id); make<A>(id); super.run?.(id);|  ^|^|', '~^#|', chr(123) || chr(125) || chr(39) || chr(10)) AS text
        FROM {part}
    """,
    "code_symbols": """
        SELECT p_partkey * 100 AS id, p_partkey - p_partkey % 4 AS file_id, 'C' || CAST(p_partkey % 1500 AS STRING) AS name,
            CASE WHEN p_partkey % 36 = 3 THEN 'C' || CAST((p_partkey - 1) % 1500 AS STRING) || '.' ELSE '' END || 'C' || CAST(p_partkey % 1500 AS STRING) AS qualified_name,
            CASE WHEN p_partkey % 10 = 7 THEN 'function' ELSE 'class' END AS kind, CASE p_partkey % 9 WHEN 5 THEN NULL WHEN 0 THEN 'controller' WHEN 1 THEN 'repository' ELSE 'service' END AS type,
            CASE WHEN p_partkey % 36 = 3 THEN 2500 ELSE p_partkey % 4 * 1000 END AS start_offset, CASE WHEN p_partkey % 36 = 3 THEN 2800 ELSE p_partkey % 4 * 1000 + 900 END AS end_offset
        FROM {part}
        UNION ALL
        SELECT 1000000000 + o_orderkey, o_custkey - o_custkey % 4, CASE WHEN o_orderkey % 11 = 7 THEN 'fn' || CAST(o_orderkey % 5 AS STRING) ELSE 'm' || CAST(o_orderkey * 7 % 24 AS STRING) END,
            CASE WHEN o_orderkey % 11 = 7 THEN 'fn' || CAST(o_orderkey % 5 AS STRING) ELSE
                CASE WHEN o_custkey % 36 = 3 THEN 'C' || CAST((o_custkey - 1) % 1500 AS STRING) || '.' ELSE '' END || 'C' || CAST(o_custkey % 1500 AS STRING) || '.m' || CAST(o_orderkey * 7 % 24 AS STRING) END,
            CASE WHEN o_orderkey % 11 = 7 THEN 'function' ELSE 'method' END, CAST(NULL AS STRING),
            CASE WHEN o_orderkey % 11 = 7 THEN 3950 WHEN o_custkey % 36 = 3 THEN 2510 + o_orderkey % 28 * 10 ELSE o_custkey % 4 * 1000 + 20 + o_orderkey % 80 * 10 END,
            CASE WHEN o_orderkey % 11 = 7 THEN 3953 WHEN o_custkey % 36 = 3 THEN 2518 + o_orderkey % 28 * 10 ELSE o_custkey % 4 * 1000 + 28 + o_orderkey % 80 * 10 END
        FROM {orders}
    """,
    "code_imports": """
        SELECT o_orderkey AS id, o_custkey - o_custkey % 4 AS file_id,
            CASE o_orderkey % 4 WHEN 2 THEN 'ns' || CAST(o_orderkey % 3 AS STRING) WHEN 3 THEN 'm' || CAST(o_orderkey % 24 AS STRING) ELSE 'C' || CAST((o_orderkey * 7 % 1900 + 1) % 1500 AS STRING) END AS local_name,
            CASE o_orderkey % 4 WHEN 2 THEN NULL WHEN 3 THEN 1000000000 + o_orderkey ELSE (o_orderkey * 7 % 1900 + 1) * 100 END AS target_symbol,
            CASE WHEN o_orderkey % 4 = 2 THEN o_orderkey * 7 % 1900 - o_orderkey * 7 % 1900 % 4 END AS target_file
        FROM {orders}
    """,
    "code_extends": """
        SELECT p_partkey * 100 AS child, CASE p_partkey % 3 WHEN 0 THEN (p_partkey * 13 % 1900 + 1) * 100 WHEN 1 THEN (p_partkey % 5 + 1) * 100 END AS parent FROM {part}
    """,
    "code_injections": """
        SELECT p_partkey * 10 AS ord, p_partkey * 100 AS symbol_id, 'dep0' AS parameter, 'C' || CAST(p_partkey * 17 % 1500 AS STRING) AS type_name, CAST(NULL AS STRING) AS target_name FROM {part}
        UNION ALL SELECT p_partkey * 10 + 1, p_partkey * 100, CASE WHEN p_partkey % 10 = 0 THEN 'dep0' ELSE 'dep1' END, CASE WHEN p_partkey % 4 = 1 THEN ' ' END, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN 'C' || CAST((p_partkey - p_partkey % 36 + 2) % 1500 AS STRING) || '.C' || CAST((p_partkey - p_partkey % 36 + 3) % 1500 AS STRING)
            ELSE 'C' || CAST(p_partkey * 19 % 1500 AS STRING) END FROM {part}
    """,
    "code_calls": """
        SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey - o_custkey % 4 AS file_id, 1000000000 + o_orderkey AS symbol_id, 'call' || CAST(l_orderkey * 10 + l_linenumber AS STRING) AS identity_key,
            CASE supp % 8 WHEN 0 THEN 'this' WHEN 1 THEN 'this' WHEN 2 THEN 'this.dep' || CAST(l_orderkey % 2 AS STRING) WHEN 3 THEN 'super' WHEN 4 THEN 'C' || CAST(named % 1500 AS STRING) WHEN 5 THEN 'ns' || CAST(l_orderkey % 3 AS STRING)
                WHEN 6 THEN NULL ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'a.b' ELSE ' ' END END AS receiver,
            CASE WHEN supp % 8 = 6 AND l_linenumber % 2 = 0 THEN 'fn' || CAST(supp % 5 AS STRING) WHEN named % 50 = 0 THEN ' ' ELSE 'm' || CAST(named % 24 AS STRING) END AS member,
            CASE WHEN named % 7 = 0 THEN NULL ELSE 'f' || CAST(named % 60 AS STRING) END AS callee,
            CASE WHEN quantity < 3 THEN NULL ELSE named % 500 END AS start_offset, CASE WHEN quantity < 3 THEN NULL ELSE named % 500 + 4 END AS end_offset
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS named, min(l_suppkey) AS supp, min(l_quantity) AS quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS sites JOIN {orders} ON o_orderkey = l_orderkey
    """,
    "code_decorators": """
        SELECT o_orderkey AS fact_id, CASE o_orderkey % 5 WHEN 0 THEN 'Get' WHEN 1 THEN 'web.Post' WHEN 2 THEN 'Injectable' WHEN 3 THEN 'All' ELSE 'Getter' END AS name, CASE WHEN o_orderkey % 11 = 7 THEN 'class' ELSE 'method' END AS target_kind,
            CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'm' || CAST(o_orderkey * 7 % 24 AS STRING) END AS target_name, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE '/r' || CAST(o_orderkey % 2000 AS STRING) END AS path,
            1000000000 + o_orderkey AS symbol_id, o_custkey - o_custkey % 4 AS file_id,
            CASE WHEN o_custkey % 36 = 3 THEN 2510 + o_orderkey % 28 * 10 ELSE o_custkey % 4 * 1000 + 20 + o_orderkey % 80 * 10 END AS start_offset, CASE WHEN o_custkey % 36 = 3 THEN 2518 + o_orderkey % 28 * 10 ELSE o_custkey % 4 * 1000 + 28 + o_orderkey % 80 * 10 END AS end_offset
        FROM {orders}
    """,
    "machines": """
        SELECT p_partkey AS id, 'src/m' || CAST(p_partkey AS STRING) || '.ts' AS path,
            'enum Status' || CAST(p_partkey % 7 AS STRING) || ' ' || chr(123) || ' Open, Paid = 2, ' || chr(39) || 'Void' || chr(39) || ' ' || chr(125) || chr(10)
            || 'class M' || CAST(p_partkey AS STRING) || ' ' || chr(123) || ' step(o: Order) ' || chr(123) || ' '
            || CASE p_partkey % 3 WHEN 0 THEN 'if (o.status === Status' || CAST(p_partkey % 7 AS STRING) || '.Open) ' || chr(123) || ' o.status = Status' || CAST(p_partkey % 7 AS STRING) || '.Paid; ' || chr(125) || ' else o.status = open();'
                WHEN 1 THEN 'if (' || chr(39) || 'open' || chr(39) || ' == this.state) this.state = ' || chr(39) || 'done-' || CAST(p_partkey % 5 AS STRING) || chr(39) || ';'
                ELSE 'if (o.status !== Status.Open && ok) ' || chr(123) || ' const status = Status.Open; o.status = Status' || CAST(p_partkey % 7 AS STRING) || '.Void; ' || chr(125) END
            || ' const due = Math.round(o.total * rate); ' || chr(125) || chr(10) || ' reset() ' || chr(123) || ' this.status = Status' || CAST(p_partkey % 7 AS STRING) || '.Open; '
            || CASE WHEN p_partkey % 4 = 0 THEN 'this.status = Status' || CAST(p_partkey % 7 AS STRING) || '.Open; ' ELSE '' END || 'return price.toFixed(2); ' || chr(125) || ' ' || chr(125) || chr(10) AS text
        FROM {part}
    """,
    "code_modules": """
        SELECT p_partkey AS id, p_partkey * 100 AS symbol_id, CASE p_partkey % 4 WHEN 0 THEN 'Module' WHEN 1 THEN 'core.Module' ELSE 'Injectable' END AS name, 'controllers' AS field, 'C' || CAST(p_partkey * 3 % 1500 AS STRING) AS reference FROM {part}
        UNION ALL SELECT p_partkey, p_partkey * 100, CASE p_partkey % 4 WHEN 0 THEN 'Module' WHEN 1 THEN 'core.Module' ELSE 'Injectable' END, 'providers', 'C' || CAST(p_partkey % 1500 AS STRING) FROM {part}
        UNION ALL SELECT p_partkey, p_partkey * 100, CASE p_partkey % 4 WHEN 0 THEN 'Module' WHEN 1 THEN 'core.Module' ELSE 'Injectable' END, 'imports', CASE WHEN p_partkey % 5 = 0 THEN 'Gone' ELSE 'C' || CAST((p_partkey * 7 % 1900 + 1) % 1500 AS STRING) || CASE WHEN p_partkey % 6 = 0 THEN '.forRoot' ELSE '' END END FROM {part}
        UNION ALL SELECT p_partkey, p_partkey * 100, CASE p_partkey % 4 WHEN 0 THEN 'Module' WHEN 1 THEN 'core.Module' ELSE 'Injectable' END, 'exports', 'C1' FROM {part}
    """,
}
