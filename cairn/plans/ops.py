"""Queries of tenancy, lifecycles, writes and constraints; and the remaining joins and aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import jobs as j
from cairn.operators import reconcile as r
from cairn.operators import rules as q
from cairn.operators import tenancy as n
from cairn.operators import writes as w
from cairn.operators.search import optional_filters, page
from cairn.plans.registry import Tables, query
from cairn.scope import Scope

NOW = 500


def rows() -> Column:
    return F.count(F.lit(1))


# Tenancy.

GRANTED = "SELECT DISTINCT u.user_id, p.permission FROM {user_roles} u JOIN {role_permissions} p ON p.role_id = u.role_id"


@query("SELECT id, name FROM {users} WHERE organization_id = 7")
def ten_scope(t: Tables) -> DataFrame:
    return Scope(7).of(t.users).select("id", "name")


@query(GRANTED)
def ten_permissions(t: Tables) -> DataFrame:
    return n.permissions(t.user_roles, t.role_permissions)


@query("SELECT DISTINCT u.user_id, r.name AS role, p.permission FROM {user_roles} u JOIN {roles} r ON r.id = u.role_id JOIN {role_permissions} p ON p.role_id = r.id")
def join_permissions(t: Tables) -> DataFrame:
    roles = t.roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    return t.user_roles.join(roles, "role_id").join(t.role_permissions, "role_id").select("user_id", "role", "permission").distinct()


@query(f"SELECT user_id, list_has_all(list(permission), ['search:read', 'audit:read']) AS allowed FROM ({GRANTED}) GROUP BY user_id")
def ten_has_all(t: Tables) -> DataFrame:
    return n.has_all(n.permissions(t.user_roles, t.role_permissions), ["search:read", "audit:read"])


OWNERS = "SELECT u.organization_id, count(DISTINCT u.id) AS owners FROM {users} u JOIN {user_roles} x ON x.user_id = u.id JOIN {roles} r ON r.id = x.role_id AND r.name = 'OWNER' WHERE u.status = 'active' GROUP BY 1"


@query(OWNERS)
def agg_owner_count(t: Tables) -> DataFrame:
    return n.owners(t.users, t.user_roles, t.roles)


@query(f"SELECT u.id, coalesce(o.owners, 0) - CASE WHEN u.status = 'active' THEN 1 ELSE 0 END > 0 AS removable FROM {{users}} u JOIN {{user_roles}} x ON x.user_id = u.id AND x.role_id = 0 LEFT JOIN ({OWNERS}) o ON o.organization_id = u.organization_id")
def ten_last_owner(t: Tables) -> DataFrame:
    return n.last_owner_guard(t.users, t.user_roles, t.roles)


USERS = "SELECT id, name, created FROM {users} WHERE status = 'active' AND (name ILIKE '%00%' OR email ILIKE '%1@%') ORDER BY created DESC, id LIMIT 20"


def _users(t: Tables) -> DataFrame:
    found = t.users.filter((F.col("status") == "active") & (F.col("name").ilike("%00%") | F.col("email").ilike("%1@%")))
    return page(found, [F.desc("created"), F.asc("id")])


@query(USERS)
def ten_users_page(t: Tables) -> DataFrame:
    return _users(t).select("id", "name", "created")


@query(f"SELECT p.id, p.name, coalesce(string_agg(DISTINCT r.name, ',' ORDER BY r.name), '') AS roles FROM ({USERS}) p LEFT JOIN {{user_roles}} x ON x.user_id = p.id LEFT JOIN {{roles}} r ON r.id = x.role_id GROUP BY ALL")
def join_users_roles(t: Tables) -> DataFrame:
    return n.with_roles(_users(t).select("id", "name"), t.user_roles, t.roles).select("id", "name", F.array_join("roles", ",").alias("roles"))


@query("SELECT id, name, created FROM {repositories} WHERE status = 'synced' AND remote_url ILIKE '%git%' ORDER BY created DESC, id LIMIT 20")
def ten_repos_page(t: Tables) -> DataFrame:
    return page(t.repositories.filter((F.col("status") == "synced") & F.col("remote_url").ilike("%git%")), [F.desc("created"), F.asc("id")]).select("id", "name", "created")


MEMBERS = "SELECT u.id, u.name, u.email, coalesce(string_agg(DISTINCT r.name, ',' ORDER BY r.name), '') AS roles FROM {repositories} p JOIN {users} u ON u.organization_id = p.organization_id LEFT JOIN {user_roles} x ON x.user_id = u.id LEFT JOIN {roles} r ON r.id = x.role_id WHERE p.id = 3 GROUP BY ALL"


@query(MEMBERS)
def join_member_users(t: Tables) -> DataFrame:
    members = t.users.join(t.repositories.filter("id = 3").select("organization_id"), "organization_id")
    return n.with_roles(members, t.user_roles, t.roles).select("id", "name", "email", F.array_join("roles", ",").alias("roles"))


@query("SELECT u.id, u.name, u.email FROM {users} u JOIN {repositories} p ON p.organization_id = u.organization_id WHERE p.id = 3 ORDER BY u.name, u.email, u.id LIMIT 20")
def ten_members(t: Tables) -> DataFrame:
    members = t.users.join(t.repositories.filter("id = 3").select("organization_id"), "organization_id")
    return page(members, [F.asc("name"), F.asc("email"), F.asc("id")]).select("id", "name", "email")


@query("SELECT id, name FROM {roles} ORDER BY name")
def ten_roles(t: Tables) -> DataFrame:
    return t.roles.orderBy("name").select("id", "name")


@query("SELECT id, user_id FROM {sessions} WHERE expires > 90000 AND revoked IS NULL ORDER BY last_used DESC NULLS LAST, created_at DESC, id DESC LIMIT 20")
def ten_sessions(t: Tables) -> DataFrame:
    return page(n.active_sessions(t.sessions, 90_000), n.session_order()).select("id", "user_id")


@query("SELECT id, CASE WHEN revoked IS NOT NULL OR expires <= 90000 THEN 'invalid' WHEN token <> previous_token THEN 'reused' ELSE 'rotated' END AS result FROM {sessions}")
def ten_session_rotate(t: Tables) -> DataFrame:
    return t.sessions.select("id", n.rotation(F.lit(90_000), F.col("previous_token")).alias("result"))


@query("SELECT s.id, u.email FROM {sessions} s JOIN {users} u ON u.id = s.user_id AND u.status = 'active' WHERE s.expires > 90000 AND s.revoked IS NULL")
def ten_identity(t: Tables) -> DataFrame:
    return n.identities(t.sessions, t.users, 90_000).select("id", "email")


@query("SELECT id, CASE WHEN user_id = 7 AND revoked IS NULL THEN 500 ELSE revoked END AS revoked FROM {sessions}")
def ten_revoke(t: Tables) -> DataFrame:
    return n.revoked(t.sessions, F.lit(7), NOW).select("id", "revoked")


@query("SELECT id, event_type FROM {audit} WHERE organization_id = 2 AND outcome = 'failure' ORDER BY created_at DESC, id DESC LIMIT 20")
def ten_audit_page(t: Tables) -> DataFrame:
    own = optional_filters(Scope(2).of(t.audit), outcome="failure", event_type=None)
    return page(own, [F.desc("created_at"), F.desc("id")]).select("id", "event_type")


HEALTH = "SELECT repository_id, count(*) AS branches, count(*) FILTER (status = 'active') AS active, count(*) FILTER (is_default) AS defaults, max(synced) AS last_synced FROM {branches} GROUP BY repository_id"


@query(HEALTH)
def agg_branch_health(t: Tables) -> DataFrame:
    return n.branch_health(t.branches)


@query(f"SELECT p.id, p.status, coalesce(h.branches, 0) AS branches, coalesce(h.active, 0) AS active FROM {{repositories}} p LEFT JOIN ({HEALTH}) h ON h.repository_id = p.id")
def ten_repo_status(t: Tables) -> DataFrame:
    return n.with_branch_health(t.repositories, t.branches).select("id", "status", "branches", "active")


# Lifecycles.


@query("SELECT id FROM {jobs} WHERE status = 'queued' AND NOT cancel_requested AND attempt_count < max_attempts AND (next_attempt IS NULL OR next_attempt <= 500) ORDER BY created, id LIMIT 1")
def job_claim_next(t: Tables) -> DataFrame:
    return j.claim_next(t.jobs, NOW).select("id")


NEXT = "CASE WHEN cancel_requested THEN 'cancelled' WHEN {retry} AND attempt_count < max_attempts THEN 'queued' ELSE 'failed' END"


@query(f"SELECT id, {NEXT.replace('{retry}', 'TRUE')} AS next_status FROM (SELECT * FROM {{jobs}} WHERE status = 'running' AND lease_expires <= 500 ORDER BY lease_expires, id LIMIT 50)")
def job_recover(t: Tables) -> DataFrame:
    return j.recovered(t.jobs, NOW, 50).select("id", "next_status")


@query(f"SELECT id, {NEXT.replace('{retry}', 'id % 2 = 0')} AS next_status FROM {{jobs}} WHERE status = 'running'")
def job_fail(t: Tables) -> DataFrame:
    return j.failed(t.jobs, F.col("id") % 2 == 0).select("id", "next_status")


@query("SELECT id FROM (SELECT *, id % 3 AS x FROM {jobs}) WHERE status = 'running' AND phase = 'finalizing' AND NOT cancel_requested AND processed_files + skipped_files + failed_files = total_files AND failed_files = 0")
def job_complete(t: Tables) -> DataFrame:
    return j.completable(t.jobs).select("id")


@query("SELECT repository_id, count(*) AS jobs, count(*) FILTER (processed_files + skipped_files + failed_files = total_files) AS balanced, CAST(sum(failed_files) AS BIGINT) AS failed FROM {jobs} GROUP BY 1")
def agg_job_progress(t: Tables) -> DataFrame:
    even = F.col("processed_files") + F.col("skipped_files") + F.col("failed_files") == F.col("total_files")
    return t.jobs.groupBy("repository_id").agg(rows().alias("jobs"), F.count_if(even).alias("balanced"), F.sum("failed_files").alias("failed"))


@query("SELECT id, CASE WHEN status = 'queued' THEN 'cancelled' ELSE status END AS next_status, status IN ('queued', 'running') OR cancel_requested AS flagged FROM {jobs}")
def job_cancel(t: Tables) -> DataFrame:
    return j.cancelled(t.jobs).select("id", "next_status", "flagged")


@query("SELECT id, CASE WHEN status = 'running' AND worker = 'w1' AND lease_expires > 500 THEN 560 ELSE lease_expires END AS lease_expires FROM {jobs}")
def job_heartbeat(t: Tables) -> DataFrame:
    return j.heartbeat(t.jobs, "w1", NOW, 60).select("id", "lease_expires")


@query("SELECT id, status, created FROM {jobs} WHERE repository_id = 4 AND status = 'running' ORDER BY created DESC, id DESC LIMIT 20")
def job_list(t: Tables) -> DataFrame:
    return page(optional_filters(t.jobs, repository_id=4, status="running"), [F.desc("created"), F.desc("id")]).select("id", "status", "created")


@query("SELECT id, status FROM {jobs} WHERE branch_id = 42 AND status IN ('queued', 'running') ORDER BY created DESC, id DESC LIMIT 1")
def job_active(t: Tables) -> DataFrame:
    return page(t.jobs.filter("branch_id = 42 AND status IN ('queued', 'running')"), [F.desc("created"), F.desc("id")], 1, 1).select("id", "status")


@query("SELECT id AS retry_of, 'queued' AS status, CAST(0 AS BIGINT) AS attempt_count FROM {jobs} WHERE status = 'running' AND lease_expires <= 500 AND (cancel_requested OR attempt_count >= max_attempts)")
def job_retry(t: Tables) -> DataFrame:
    ended = j.expired(t.jobs, NOW).drop("status").withColumnRenamed("next_status", "status")
    return j.retried(ended).select("retry_of", "status", "attempt_count")


# Writes.


@query("SELECT u.id FROM {users} u WHERE EXISTS (SELECT 1 FROM {audit} a WHERE a.user_id = u.id AND a.event_type = 'signup')")
def wr_existence(t: Tables) -> DataFrame:
    return t.users.join(t.audit.filter("event_type = 'signup'").select(F.col("user_id").alias("id")), "id", "left_semi").select("id")


SEED = "(SELECT n_name AS name, 'about ' || CAST(n_regionkey AS STRING) AS description FROM nation WHERE n_nationkey < 20)"


@query(f"SELECT coalesce(k.name, s.name) AS name, CASE WHEN k.name IS NULL THEN 'created' WHEN s.name IS NULL THEN 'removed' WHEN k.description = s.description THEN 'unchanged' ELSE 'updated' END AS action FROM (SELECT n_name AS name, 'about ' || CAST(n_nationkey % 5 AS STRING) AS description FROM nation WHERE n_nationkey > 4) k FULL JOIN {SEED} s ON s.name = k.name")
def wr_seed_permissions(t: Tables) -> DataFrame:
    about = lambda c: F.concat(F.lit("about "), c.cast("string")).alias("description")
    known = t.nation.filter("n_nationkey > 4").select(F.col("n_name").alias("name"), about(F.col("n_nationkey") % 5))
    return r.reconcile(known, t.nation.filter("n_nationkey < 20").select(F.col("n_name").alias("name"), about(F.col("n_regionkey"))), ["name"], ["description"]).select("name", "action")


@query("SELECT user_id, role_id FROM {user_roles} UNION SELECT c_custkey, 4 FROM customer WHERE c_custkey % 10 = 0")
def wr_seed_roles(t: Tables) -> DataFrame:
    more = t.customer.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(4).alias("role_id"))
    return r.insert_ignore(t.user_roles, more, ["user_id", "role_id"])


@query("SELECT user_id, role_id FROM {user_roles} WHERE user_id <> 12 UNION ALL SELECT CAST(12 AS BIGINT), CAST(id AS INTEGER) FROM {roles} WHERE name IN ('ADMIN', 'GUEST')")
def wr_replace_roles(t: Tables) -> DataFrame:
    new = t.roles.filter(F.col("name").isin("ADMIN", "GUEST")).select(F.lit(12).cast("long").alias("user_id"), F.col("id").cast("int").alias("role_id"))
    return t.user_roles.filter("user_id <> 12").unionByName(new)


@query("SELECT id, CASE WHEN id = 5 THEN 'renamed' ELSE name END AS name FROM {repositories} WHERE NOT (id = 9 AND organization_id >= 0)")
def wr_repo_crud(t: Tables) -> DataFrame:
    kept = t.repositories.filter("NOT (id = 9 AND organization_id >= 0)")
    return kept.select("id", F.when(F.col("id") == 5, "renamed").otherwise(F.col("name")).alias("name"))


@query("SELECT user_id, role_id FROM {user_roles} WHERE NOT (user_id = 3 AND role_id = 2) UNION SELECT CAST(3 AS BIGINT), 1")
def wr_member_crud(t: Tables) -> DataFrame:
    new = t.roles.limit(1).select(F.lit(3).cast("long").alias("user_id"), F.lit(1).alias("role_id"))
    return r.insert_ignore(t.user_roles.filter("NOT (user_id = 3 AND role_id = 2)"), new, ["user_id", "role_id"])


#: Repositories before, and what attempts saw of some of them.
BEFORE = "SELECT id, status, CAST(NULL AS BIGINT) AS attempted_at, created AS synced_at, id * 10 AS size_bytes, 'main' AS default_branch FROM {repositories}"
ATTEMPTS = "SELECT s_suppkey AS id, s_acctbal > 0 AS ok, CASE WHEN s_nationkey % 2 = 0 THEN 'trunk' END AS seen_branch, s_suppkey * 1024 AS seen_bytes FROM {supplier} WHERE s_nationkey % 5 <> 0"


@query(
    f"""SELECT id, CASE WHEN ok THEN 'synced' WHEN NOT ok THEN 'failed' ELSE status END AS status, CASE WHEN ok IS NOT NULL THEN CAST(500 AS BIGINT) END AS attempted_at, CASE WHEN ok THEN 500 ELSE synced_at END AS synced_at,
    CASE WHEN ok THEN seen_bytes ELSE size_bytes END AS size_bytes, CASE WHEN ok AND seen_branch IS NOT NULL THEN seen_branch ELSE default_branch END AS default_branch
    FROM ({BEFORE}) LEFT JOIN ({ATTEMPTS.replace("{supplier}", "supplier")}) USING (id)"""
)
def wr_sync_state(t: Tables) -> DataFrame:
    return w.synchronized(t.spark.sql(BEFORE, repositories=t.repositories), t.spark.sql(ATTEMPTS, supplier=t.supplier), NOW)


@query("SELECT f.id, k.id IS NOT NULL AS stamped FROM {files} f LEFT JOIN (SELECT page_id AS id, page_id % 3 + page_id + 999 AS hash FROM pages) k ON k.id = f.id AND k.hash = f.current_file_hash_id")
def wr_file_complete(t: Tables) -> DataFrame:
    done = t.pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 3 + F.col("page_id") + 999).alias("current_file_hash_id"), F.lit(True).alias("done"))
    return t.files.join(done, ["id", "current_file_hash_id"], "left").select("id", F.coalesce("done", F.lit(False)).alias("stamped"))


#: Errors that workers report, some of jobs that another worker holds; and those that are there.
REPORTED = "SELECT id AS job_id, CASE WHEN id % 4 = 0 THEN 'w1' ELSE worker END AS worker, error_code AS code FROM {jobs} WHERE error_code IS NOT NULL"
HELD = "SELECT id AS job_id, worker, 'E0' AS code FROM {jobs} WHERE status = 'succeeded' AND id % 50 = 0"


@query(f"{HELD} UNION ALL SELECT r.job_id, r.worker, r.code FROM ({REPORTED}) r JOIN {{jobs}} j ON j.id = r.job_id AND j.worker = r.worker AND j.status = 'running' AND j.lease_expires > 500")
def wr_errors(t: Tables) -> DataFrame:
    return w.with_errors(t.spark.sql(HELD, jobs=t.jobs), t.spark.sql(REPORTED, jobs=t.jobs), t.jobs, NOW)


#: Invitations by nation, to addresses of which some are taken or asked for twice, with roles of which some are another organisation's.
INVITATIONS = """SELECT s_nationkey AS organization_id, CASE WHEN s_suppkey % 10 = 0 THEN ' Customer#' || lpad(CAST(s_suppkey AS STRING), 9, '0') || '@Example.org' ELSE 'new' || CAST(s_suppkey % 77 AS STRING) || '@example.org' END AS email,
    'token' || CAST(s_suppkey AS STRING) AS token, s_suppkey % 3 AS a, s_suppkey % 7 AS b FROM {supplier}"""
ORGANISATION_ROLES = "SELECT n_nationkey AS organization_id, CAST(x.id AS BIGINT) AS id FROM {nation} CROSS JOIN {roles} x WHERE x.id <= 1 + n_nationkey % 4"


@query(
    f"""WITH i AS (SELECT organization_id, lower(trim(email)) AS email, token, a, b FROM ({INVITATIONS.replace("{supplier}", "supplier")})), r AS ({ORGANISATION_ROLES.replace("{nation}", "nation")}),
    x AS (SELECT i.*, CASE WHEN email IN (SELECT lower(email) FROM {{users}}) OR token <> (SELECT min(k.token) FROM i k WHERE k.email = i.email) THEN 'email_taken'
        WHEN (a, organization_id) IN (SELECT (id, organization_id) FROM r) AND (b, organization_id) IN (SELECT (id, organization_id) FROM r) AND a <> b THEN 'created' ELSE 'unknown_role' END AS result FROM i)
    SELECT organization_id, email, result, CASE WHEN result = 'created' THEN sha256(token) END AS token_hash, CASE WHEN result = 'created' THEN CAST(572 AS BIGINT) END AS expires FROM x"""
)
def wr_invite(t: Tables) -> DataFrame:
    asked = t.spark.sql(INVITATIONS, supplier=t.supplier).withColumn("role_ids", F.array("a", "b"))
    return w.invited(asked, t.users, t.spark.sql(ORGANISATION_ROLES, nation=t.nation, roles=t.roles), NOW, 72)


INVITED = "SELECT id, status, CASE WHEN status = 'invited' THEN sha2('token' || CAST(id AS STRING), 256) END AS token_hash, CASE WHEN status = 'invited' THEN created END AS token_expires FROM {users}"


@query(
    """SELECT id, CASE WHEN fine THEN 'active' ELSE status END AS status, CASE WHEN NOT fine AND status = 'invited' THEN sha256('token' || CAST(id AS STRING)) END AS token_hash, CASE WHEN NOT fine AND status = 'invited' THEN created END AS token_expires, CASE WHEN fine THEN CAST(500 AS BIGINT) END AS accepted_at
    FROM (SELECT *, status = 'invited' AND created > 500 AND id % 2 = 0 AS fine FROM {users})"""
)
def wr_invite_accept(t: Tables) -> DataFrame:
    tokens = t.users.filter("id % 2 = 0").select(F.concat(F.lit("token"), F.col("id").cast("string")).alias("token"))
    return w.accepted(t.spark.sql(INVITED, users=t.users), tokens, NOW)


#: Rows that are there, and events of which some have a type that isn't known.
AUDITED = "SELECT id, event_type, outcome, sha2('old', 256) AS identifier_hash FROM {audit} WHERE id % 100 = 0"


@query(
    f"""{AUDITED.replace("sha2('old', 256)", "sha256('old')")} UNION ALL SELECT id, event_type, outcome, sha256('user' || CAST(user_id AS STRING)) FROM {{audit}} WHERE id % 100 <> 0 AND event_type IN ('signup', 'purchase', 'error')"""
)
def wr_audit_append(t: Tables) -> DataFrame:
    new = t.audit.filter("id % 100 <> 0").select("id", "event_type", "outcome", F.concat(F.lit(" User"), F.col("user_id").cast("string")).alias("identifier"))
    return w.with_audit(t.spark.sql(AUDITED, audit=t.audit), new, ["signup", "purchase", "error"])


@query("SELECT 1 AS healthy")
def wr_health(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).alias("healthy"))


@query("SELECT count(*) AS total FROM {users} WHERE status = 'active'")
def agg_count_total(t: Tables) -> DataFrame:
    return t.users.filter("status = 'active'").agg(rows().alias("total"))


# Constraints.


@query(
    """SELECT id FROM {search_documents} WHERE NOT (CASE source_type WHEN 'file' THEN indexed_file_id IS NOT NULL AND code_symbol_id IS NULL AND knowledge_node_id IS NULL
    WHEN 'symbol' THEN indexed_file_id IS NOT NULL AND code_symbol_id IS NOT NULL AND knowledge_node_id IS NULL ELSE knowledge_node_id IS NOT NULL AND code_symbol_id IS NULL AND indexed_file_id IS NULL END) OR length(trim(name)) = 0"""
)
def dq_doc_shape(t: Tables) -> DataFrame:
    return q.violations(t.search_documents, shape=q.shape(), named=~q.blank("name")).select("id")


@query("SELECT id FROM {search_documents} WHERE strlen(content) > 8192 OR length(trim(title)) = 0")
def dq_sizes(t: Tables) -> DataFrame:
    return q.violations(t.search_documents, content=F.octet_length("content") <= 8192, title=~q.blank("title")).select("id")


@query("SELECT path FROM {inventory} WHERE NOT regexp_matches(object_id, '^[0-9a-f]{32}$')".replace("{32}", "<32>"))
def dq_hex(t: Tables) -> DataFrame:
    return q.violations(t.inventory, object_id=F.col("object_id").rlike("^[0-9a-f]{32}$")).select("path")


@query("SELECT id FROM {symbols} WHERE NOT (start_offset >= 10 AND end_offset - start_offset <= 1800)")
def dq_ranges(t: Tables) -> DataFrame:
    return q.violations(t.symbols, start=F.col("start_offset") >= 10, width=F.col("end_offset") - F.col("start_offset") <= 1800).select("id")


@query("SELECT id FROM {jobs} WHERE NOT (attempt_count <= max_attempts) OR (status <> 'running' AND phase = 'finalizing')")
def dq_state_machine(t: Tables) -> DataFrame:
    phase = (F.col("status") == "running") | (F.col("phase") != "finalizing")
    return q.violations(t.jobs, attempts=F.col("attempt_count") <= F.col("max_attempts"), phase=phase).select("id")


SCOPED = "FROM {edges} e WHERE {no}EXISTS (SELECT 1 FROM {nodes} x WHERE x.id = e.source_node_id AND x.snapshot_id = e.snapshot_id)"


@query(f"SELECT e.id, e.kind, e.weight {SCOPED.replace('{no}', 'NOT ')}")
def dq_scope(t: Tables) -> DataFrame:
    return q.out_of_scope(t.edges, t.nodes, "source_node_id", ["snapshot_id"]).select("id", "kind", "weight")


@query(f"SELECT count(*) AS n {SCOPED.replace('{no}', '')}")
def join_semi_exists(t: Tables) -> DataFrame:
    own = t.nodes.select(F.col("id").alias("source_node_id"), "snapshot_id")
    return t.edges.join(own, ["source_node_id", "snapshot_id"], "left_semi").agg(rows().alias("n"))


@query(f"SELECT count(*) AS n {SCOPED.replace('{no}', 'NOT ')}")
def join_anti_not_exists(t: Tables) -> DataFrame:
    return q.out_of_scope(t.edges, t.nodes, "source_node_id", ["snapshot_id"]).agg(rows().alias("n"))


@query("SELECT id, count(*) AS n FROM {edges} GROUP BY id HAVING count(*) > 1")
def dq_unique(t: Tables) -> DataFrame:
    return q.duplicates(t.edges, "id")
