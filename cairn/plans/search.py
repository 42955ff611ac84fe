"""Search queries: retrieval, expansion, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.cover_density import rank, weighted_terms
from cairn.functions.text import normalized, query_terms, round6
from cairn.operators import search as s
from cairn.plans.registry import Tables, query
from cairn.sources.store import scratch

#: The query of the examples: raw for the exact signals, its terms for the lexical one.
Q = "The"
NORM = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace({c}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z\d])([A-Z])', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')))"""
norm = lambda c: NORM.replace("{c}", c).replace("{L}", "<L>").replace("{N}", "<N>")  # noqa: E731  braces name fixtures

FLAGS = """lower(coalesce(name, '')) = lower('The') AS exact_identifier, lower(title) = lower('The') AS exact_title, lower(coalesce(path, '')) = lower('The') AS exact_path,
    starts_with(lower(title), lower('The')) AS title_prefix, starts_with(lower(coalesce(name, '')), lower('The')) AS identifier_prefix, contains(lower(coalesce(path, '')), lower('The')) AS path_contains"""
SCORE = "CAST(120 * exact_identifier::INT + 110 * exact_title::INT + 100 * exact_path::INT + 70 * title_prefix::INT + 65 * identifier_prefix::INT + 40 * path_contains::INT AS INTEGER)"
#: How often the term stands in fields of each weight class; a single term's rank is made of that alone.
CLASSES = {"n_a": "concat_ws(' ', title, path)", "n_b": "concat_ws(' ', kind, language)", "n_c": "coalesce(content, '')"}
COUNTS = ", ".join(f"len(list_filter(string_split({norm(c)}, ' '), lambda x: x = 'the')) AS {n}" for n, c in CLASSES.items())
WEIGHT = "(1.0::DOUBLE * n_a + 0.4::DOUBLE * n_b + 0.2::DOUBLE * n_c)"
RANK = f"(50.0::DOUBLE * {WEIGHT} / ({WEIGHT} + 1))"
LEXICAL = "(n_a + n_b + n_c > 0)"
FOUND = f"SELECT *, {FLAGS}, {LEXICAL} AS lexical, {RANK} AS rank FROM (SELECT *, {COUNTS} FROM {{search_documents}})"
CANDIDATES = f"SELECT * FROM (SELECT *, floor(({SCORE} + rank) * 1e6 + 0.5) / 1e6 AS score FROM ({FOUND})) WHERE exact_identifier OR exact_title OR exact_path OR title_prefix OR identifier_prefix OR path_contains OR lexical"
TYPE_ORDER = "CASE source_type WHEN 'file' THEN 0 WHEN 'symbol' THEN 1 ELSE 2 END"
SIGNAL_NAMES = [n for n, _ in s.SIGNALS]


@query(f"SELECT id, {', '.join(SIGNAL_NAMES[:3])} FROM (SELECT id, {FLAGS} FROM {{search_documents}})")
def sea_exact_signals(t: Tables) -> DataFrame:
    return s.exact_signals(t.search_documents, Q).select("id", *SIGNAL_NAMES[:3])


@query(f"SELECT id, title_prefix, identifier_prefix FROM (SELECT id, {FLAGS} FROM {{search_documents}})")
def sea_prefix_signals(t: Tables) -> DataFrame:
    return s.exact_signals(t.search_documents, Q).select("id", "title_prefix", "identifier_prefix")


@query(f"SELECT id, path_contains FROM (SELECT id, {FLAGS} FROM {{search_documents}})")
def sea_contains_signal(t: Tables) -> DataFrame:
    return s.exact_signals(t.search_documents, Q).select("id", "path_contains")


@query(f"SELECT id, lexical FROM ({FOUND})")
def sea_lexical_match(t: Tables) -> DataFrame:
    return t.search_documents.select("id", s.lexical_match(t.search_documents, Q).alias("lexical"))


@query(f"SELECT id FROM ({FOUND}) WHERE lexical")
def sea_inverted_lookup(t: Tables) -> DataFrame:
    return s.lookup(t.search_index.postings, query_terms(Q))


@query(f"SELECT id, {SCORE} AS exact, floor(rank * 1e6 + 0.5) / 1e6 AS rank, score FROM ({CANDIDATES})")
def sea_score(t: Tables) -> DataFrame:
    return s.candidates(t.search_index, Q).select("id", "exact", round6(F.col("rank")).alias("rank"), "score")


@query(f"SELECT id, score FROM ({CANDIDATES})")
def sea_match_filter(t: Tables) -> DataFrame:
    return s.candidates(t.search_index, Q).select("id", "score")


@query(f"SELECT id, source_type, title, score FROM ({CANDIDATES}) ORDER BY score DESC, {TYPE_ORDER}, title, id LIMIT 20")
def sea_order_page(t: Tables) -> DataFrame:
    return s.first_page(t.search_index, Q).select("id", "source_type", "title", "score")


@query(f"SELECT CAST(2 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_limit, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM ({CANDIDATES})")
def sea_pagination(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return s.candidates(t.search_index, Q).agg(F.lit(2).cast("long").alias("page"), F.lit(20).cast("long").alias("page_limit"), n.alias("total"), F.ceil(n / 20).cast("long").alias("total_pages"))


@query("SELECT id, brand FROM {nodes} WHERE snapshot_id = 1 AND kind = 'workflow'")
def flt_optional(t: Tables) -> DataFrame:
    return s.optional_filters(t.nodes, snapshot_id=1, kind="workflow", brand=None).select("id", "brand")


@query(
    "SELECT id, branch_id FROM (SELECT o_orderkey AS id, o_custkey % 100 AS branch_id, o_orderstatus, o_orderkey % 50 AS k FROM orders) WHERE o_orderstatus = 'F' AND k = 7"
)
def sea_current_index(t: Tables) -> DataFrame:
    indexes = t.jobs.select("id", "branch_id", F.col("status"), (F.col("id") % 50 == 7).alias("is_current"))
    return indexes.filter((F.col("status") == "succeeded") & F.col("is_current")).select("id", "branch_id")


DEP = """SELECT s.seed_id, s.seed_order, n.id AS document_id, 'code_dependency' AS graph_source, d.kind AS relationship_kind, '{dir}' AS direction, d.id AS relationship_id
    FROM {seeds} s JOIN {code_dependencies} d ON (s.code_symbol_id IS NOT NULL AND d.{near}_symbol_id = s.code_symbol_id)
        OR (s.code_symbol_id IS NULL AND s.indexed_file_id IS NOT NULL AND d.{near}_indexed_file_id = s.indexed_file_id AND d.{near}_file_hash_id = s.file_hash_id)
    JOIN {search_documents} n ON ((d.{far}_symbol_id IS NOT NULL AND n.code_symbol_id = d.{far}_symbol_id)
        OR (d.{far}_symbol_id IS NULL AND d.{far}_indexed_file_id IS NOT NULL AND n.source_type = 'file' AND n.indexed_file_id = d.{far}_indexed_file_id AND n.file_hash_id = d.{far}_file_hash_id)) AND n.id <> s.seed_id"""
EDGE = """SELECT s.seed_id, s.seed_order, n.id AS document_id, 'knowledge_edge' AS graph_source, e.kind AS relationship_kind, '{dir}' AS direction, e.id AS relationship_id
    FROM {seeds} s JOIN {knowledge_edges} e ON e.{near}_node_id = s.knowledge_node_id JOIN {search_documents} n ON n.knowledge_node_id = e.{far}_node_id AND n.id <> s.seed_id"""


def _way(text: str, outgoing: bool) -> str:
    near, far = ("source", "target") if outgoing else ("target", "source")
    return text.replace("{near}", near).replace("{far}", far).replace("{dir}", "outgoing" if outgoing else "incoming")


REL = " UNION ALL ".join(_way(x, o) for x in (DEP, EDGE) for o in (True, False))
DEDUP = f"SELECT * FROM ({REL}) QUALIFY row_number() OVER (PARTITION BY seed_id, document_id ORDER BY graph_source, relationship_kind, direction, relationship_id) = 1"
RANKED = f"SELECT *, CAST(count(*) OVER (PARTITION BY seed_id) AS BIGINT) AS seed_candidates, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY graph_source, relationship_kind, direction, document_id) AS INTEGER) AS neighbour_rank FROM ({DEDUP})"
TOP = f"SELECT * FROM ({RANKED}) WHERE neighbour_rank <= 5 ORDER BY seed_order, neighbour_rank, document_id LIMIT 51"


def _relations(t: Tables) -> DataFrame:
    return s.relations(s.pinned(t.seeds), t.code_dependencies, t.knowledge_edges, t.search_index.heads)


def _ranked(t: Tables) -> DataFrame:
    return s.ranked_neighbours(s.deduplicated(_relations(t)))


@query("SELECT d.id, d.title, s.seed_order FROM {seeds} s JOIN {search_documents} d ON d.id = s.seed_id")
def join_seed_docs(t: Tables) -> DataFrame:
    ids = t.seeds.agg(F.transform(F.array_sort(F.collect_list(F.struct("seed_order", "seed_id"))), lambda x: x["seed_id"]).alias("ids"))
    seeds = ids.select(F.posexplode("ids").alias("pos", "id")).select("id", (F.col("pos") + 1).cast("long").alias("seed_order"))
    return t.search_documents.join(F.broadcast(seeds), "id").select("id", "title", "seed_order")


@query(_way(DEP, True))
def join_dep_out(t: Tables) -> DataFrame:
    return s.dependency_relations(t.seeds, t.code_dependencies, t.search_documents, True)


@query(_way(DEP, False))
def join_dep_in(t: Tables) -> DataFrame:
    return s.dependency_relations(t.seeds, t.code_dependencies, t.search_documents, False)


@query(_way(EDGE, True))
def join_edge_out(t: Tables) -> DataFrame:
    return s.edge_relations(t.seeds, t.knowledge_edges, t.search_documents, True)


@query(_way(EDGE, False))
def join_edge_in(t: Tables) -> DataFrame:
    return s.edge_relations(t.seeds, t.knowledge_edges, t.search_documents, False)


@query(f"SELECT id, source_type, CAST(row_number() OVER (ORDER BY score DESC, {TYPE_ORDER}, title, id) AS INTEGER) AS seed_order FROM ({CANDIDATES}) ORDER BY score DESC, {TYPE_ORDER}, title, id LIMIT 10")
def gx_seeds(t: Tables) -> DataFrame:
    first = s.first_page(t.search_index, Q, 1, s.GRAPH_SEEDS)
    rows = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), F.array_position(F.array(*map(F.lit, ("file", "symbol", "knowledge_node"))), F.col("source_type")).alias("b"), "title", "id", "source_type"))).alias("x"))
    return rows.select(F.posexplode("x").alias("pos", "x")).select("x.id", "x.source_type", (F.col("pos") + 1).alias("seed_order"))


@query(REL)
def gx_relations(t: Tables) -> DataFrame:
    return _relations(t)


@query(DEDUP)
def gx_dedupe(t: Tables) -> DataFrame:
    return s.deduplicated(_relations(t))


@query(f"SELECT r.seed_id, r.document_id, r.direction FROM ({DEDUP}) r JOIN {{search_documents}} d ON d.id = r.document_id WHERE d.language = 'en' AND d.kind = 'class'")
def gx_filter(t: Tables) -> DataFrame:
    docs = s.optional_filters(t.search_documents, language="en", kind="class", source_type=None).select(F.col("id").alias("document_id"))
    return s.deduplicated(_relations(t)).join(docs, "document_id").select("seed_id", "document_id", "direction")


@query(f"SELECT seed_id, document_id, neighbour_rank FROM ({RANKED})")
def gx_rank(t: Tables) -> DataFrame:
    return _ranked(t).select("seed_id", "document_id", "neighbour_rank")


@query(f"SELECT DISTINCT seed_id, seed_candidates FROM ({RANKED})")
def gx_seed_count(t: Tables) -> DataFrame:
    return _ranked(t).select("seed_id", "seed_candidates").distinct()


@query(f"SELECT seed_id, document_id, graph_source, relationship_kind, direction, neighbour_rank FROM ({TOP})")
def gx_topn(t: Tables) -> DataFrame:
    return s.top_neighbours(_ranked(t)).select("seed_id", "document_id", "graph_source", "relationship_kind", "direction", "neighbour_rank")


@query(f"SELECT count(*) > 50 OR bool_or(seed_candidates > 5) AS truncated FROM ({TOP})")
def gx_truncated(t: Tables) -> DataFrame:
    return s.truncated(s.top_neighbours(_ranked(t)))


@query(" UNION ALL ".join(f"SELECT id, '{n}' AS name, CAST({w} AS DOUBLE) AS contribution FROM ({CANDIDATES}) WHERE {n}" for n, w in s.SIGNALS))
def rk_signals(t: Tables) -> DataFrame:
    return s.signal_rows(s.candidates(t.search_index, Q))


ROUND = "floor(({}) * 1e6 + 0.5) / 1e6"


@query(f"SELECT id, {ROUND.format('greatest(0.0, score - exact)')} AS residual FROM (SELECT *, {SCORE} AS exact FROM ({CANDIDATES}))")
def rk_lexical_residual(t: Tables) -> DataFrame:
    return s.candidates(t.search_index, Q).select("id", round6(F.greatest(F.lit(0.0), F.col("score") - F.col("exact"))).alias("residual"))


CONTRIB = "floor((CASE graph_source WHEN 'knowledge_edge' THEN 25 ELSE 20 END + CASE direction WHEN 'outgoing' THEN 2 ELSE 0 END) * least(1.0, greatest(0.0, seed_score / 100)) * 1e6 + 0.5) / 1e6"
SEEDED = f"SELECT *, {CONTRIB} AS contribution FROM (SELECT *, CAST(seed_id % 130 AS DOUBLE) AS seed_score FROM ({TOP}))"


def _contributions(t: Tables) -> DataFrame:
    top = s.top_neighbours(_ranked(t)).withColumn("seed_score", (F.col("seed_id") % 130).cast("double"))
    return top.withColumn("contribution", s.contribution(F.col("seed_score")))


@query(f"SELECT seed_id, document_id, contribution FROM ({SEEDED})")
def rk_graph_contrib(t: Tables) -> DataFrame:
    return _contributions(t).select("seed_id", "document_id", "contribution")


@query(
    f"""SELECT seed_id, document_id, floor(greatest(0.0, least(contribution, 50.0 - coalesce(sum(contribution) OVER (PARTITION BY document_id ORDER BY seed_order, neighbour_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) * 1e6 + 0.5) / 1e6 AS accepted
    FROM ({SEEDED})"""
)
def rk_graph_cap(t: Tables) -> DataFrame:
    return s.capped(_contributions(t)).select("seed_id", "document_id", "accepted")


PAGE = f"SELECT id, CAST(score AS DOUBLE) AS score FROM ({CANDIDATES}) ORDER BY score DESC, {TYPE_ORDER}, title, id LIMIT 20"
FUSED = f"""SELECT id, lexical_score, graph_score, floor((lexical_score + graph_score) * 1e6 + 0.5) / 1e6 AS total_score, d.source_type, d.title
    FROM (SELECT id, coalesce(p.score, 0.0) AS lexical_score, coalesce(g.graph_score, 0.0) AS graph_score FROM ({PAGE}) p
        FULL JOIN (SELECT document_id AS id, least(50.0, floor(sum(contribution) * 1e6 + 0.5) / 1e6) AS graph_score FROM ({SEEDED}) GROUP BY document_id) g USING (id)) JOIN {{search_documents}} d USING (id)"""


def _fused(t: Tables) -> DataFrame:
    lexical = s.page(s.candidates(t.search_index, Q), s.page_order()).select("id", "score")
    return s.fused(lexical, _contributions(t), t.search_index.heads)


@query(f"SELECT id, lexical_score, graph_score FROM ({FUSED})")
def rk_dedupe(t: Tables) -> DataFrame:
    return _fused(t).select("id", "lexical_score", "graph_score")


@query(f"SELECT id, total_score, source_type, title FROM ({FUSED}) ORDER BY total_score DESC, lexical_score DESC, source_type, title, id LIMIT 20")
def rk_total_sort(t: Tables) -> DataFrame:
    return s.page(_fused(t), s.fused_order()).select("id", "total_score", "source_type", "title")


@query(f"SELECT count(*) AS deduplicated, least(count(*), 20) AS returned, count(*) > 20 AS truncated FROM ({FUSED})")
def rk_meta(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return _fused(t).agg(n.alias("deduplicated"), F.least(n, F.lit(20)).cast("long").alias("returned"), (n > 20).alias("truncated"))


@query("SELECT c_custkey AS id, floor(c_acctbal / 7 * 1e6 + 0.5) / 1e6 AS rounded FROM customer")
def rk_round(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), round6(F.col("c_acctbal") / 7).alias("rounded"))


@query(f"SELECT doc_id, {norm('text')} AS normalized FROM documents")
def pj_text_norm(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", normalized(F.col("text")).alias("normalized"))


@query("SELECT id, left(content, 500) AS preview FROM {search_documents}")
def prj_preview(t: Tables) -> DataFrame:
    return t.search_documents.select("id", F.left("content", F.lit(500)).alias("preview"))


VECTOR = " + ".join(f"len(list_filter(string_split({norm(f"coalesce({c}, '')")}, ' '), lambda x: x <> ''))" for c in ("title", "path", "kind", "language", "content"))


@query(f"SELECT id, CAST({VECTOR} AS INTEGER) AS positions FROM {{search_documents}}")
def sea_vector(t: Tables) -> DataFrame:
    """Weighted positions of a document's terms: title and path A, kind and language B, content C."""
    return t.search_documents.select("id", F.size(weighted_terms()).alias("positions"))


#: Places of two terms in the order of positions; a cover ends at each place, begins at the earlier of the two last places, and counts if it begins later than all before.
PAIR = f"""WITH d AS (
        SELECT id, string_split(trim({norm("coalesce(title, '')")} || ' ' || {norm("coalesce(path, '')")}), ' ') AS a, string_split({norm("concat_ws(' ', kind, language)")}, ' ') AS b, string_split({norm("coalesce(content, '')")}, ' ') AS c FROM {{search_documents}}
    ), w AS (
        SELECT id, list_filter(a, lambda x: x <> '') AS a, list_filter(b, lambda x: x <> '') AS b, list_filter(c, lambda x: x <> '') AS c FROM d
    ), p AS (
        SELECT id, unnest(a || b || c) AS term, unnest(range(1, len(a) + len(b) + len(c) + 1)) AS position, len(a) AS na, len(b) AS nb FROM w
    ), h AS (
        SELECT id, term, position, CASE WHEN position <= na THEN 1.0::DOUBLE WHEN position <= na + nb THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS weight FROM p WHERE term IN ('the', 'of')
    ), l AS (
        SELECT id, position, arg_max(position, position) FILTER (term = 'the') OVER o AS p1, arg_max(weight, position) FILTER (term = 'the') OVER o AS w1, arg_max(position, position) FILTER (term = 'of') OVER o AS p2, arg_max(weight, position) FILTER (term = 'of') OVER o AS w2
        FROM h WINDOW o AS (PARTITION BY id ORDER BY position ROWS UNBOUNDED PRECEDING)
    ), f AS (SELECT *, least(p1, p2) AS first, lag(least(p1, p2)) OVER (PARTITION BY id ORDER BY position) AS before FROM l WHERE p1 IS NOT NULL AND p2 IS NOT NULL),
    s AS (SELECT id, sum(2.0 / (1 / w1 + 1 / w2) / (1 + greatest(0, position - first - 1)) ORDER BY position) AS r FROM f WHERE before IS NULL OR first > before GROUP BY id)
    SELECT id, floor(50 * r / (r + 1) * 1e6 + 0.5) / 1e6 AS rank FROM s"""


@query(PAIR)
def sea_rank_cd(t: Tables) -> DataFrame:
    """Cover-density rank of the documents that hold both terms of a query."""
    return rank(t.search_index.postings, query_terms("the of")).select("id", round6(F.col("rank")).alias("rank"))


@query("SELECT id FROM {search_documents} WHERE contains(lower(coalesce(path, '')), 'en/1')")
def sea_contains_lookup(t: Tables) -> DataFrame:
    """Paths that hold a needle: its grams are looked up, and what has them all is tested."""
    index, needle = t.search_index, s.lowered(t.spark, "En/1")
    return index.heads.join(s.with_needle(index.grams, needle), "id").filter(F.contains(F.lower("path"), F.lit(needle))).select("id")


@query(f"SELECT id, {', '.join(SIGNAL_NAMES[:5])} FROM (SELECT id, {FLAGS} FROM {{search_documents}}) WHERE exact_path OR title_prefix OR identifier_prefix")
def sea_prefix_lookup(t: Tables) -> DataFrame:
    """The signals of equal fields and beginnings, from ranges of the sorted keys."""
    return s.key_signals(t.search_index.keys, s.lowered(t.spark, Q))


#: Documents after an upsert: one of 97 has another title, path and content, one of 101 is gone, and some are new.
CHANGED = """SELECT id, search_index_id, source_type, name, 'The new title' AS title, content || ' the renewed' AS content, 'new/' || CAST(id AS STRING) AS path, language, kind, indexed_file_id, file_hash_id, code_symbol_id, knowledge_node_id FROM {search_documents} WHERE id % 97 = 0
    UNION ALL SELECT id + 900000000, search_index_id, source_type, name, title, 'only the new', 'added/' || CAST(id AS STRING), language, kind, indexed_file_id, file_hash_id, code_symbol_id, knowledge_node_id FROM {search_documents} WHERE id % 211 = 0"""
AFTER = f"(SELECT * FROM {{search_documents}} WHERE id % 97 <> 0 AND id % 101 <> 0 UNION ALL BY NAME {CHANGED})"


@query(
    f"""SELECT id, lexical, title_prefix, path_contains FROM (SELECT id, {LEXICAL} AS lexical, starts_with(lower(coalesce(title, '')), 'the') AS title_prefix, contains(lower(coalesce(path, '')), 'the') AS path_contains, starts_with(lower(coalesce(name, '')), 'the') AS own FROM (SELECT *, {COUNTS} FROM {AFTER}))
    WHERE lexical OR title_prefix OR path_contains OR own"""
)
def sink_upsert_index(t: Tables) -> DataFrame:
    """The index after an upsert and removals, which write a segment of their own."""
    changed = t.spark.sql(CHANGED, search_documents=t.search_documents)
    index = s.SegmentedIndex(t.spark, scratch(t.spark, "segments"))
    index.upsert(t.search_documents)
    index.upsert(changed, t.search_documents.filter("id % 101 = 0 and id % 97 <> 0").select("id"))
    return s.candidates(index.read(), Q).select("id", "lexical", "title_prefix", "path_contains")
