import subprocess

import pytest
from pyspark.sql import functions as F

from cairn.functions import canonical
from cairn.functions.cover_density import WEIGHTS, covers, rank
from cairn.functions.text import extension, normalized, normalized_url, provider, query_terms, round6, terms
from cairn.operators import analysis, ingest, jobs, reconcile, rules, tenancy
from cairn.operators import search as s
from cairn.scope import Scope
from cairn.sources import git
from cairn.sources.store import ImmutableVersion, Store, digest, lock
from cairn.sources.typescript import parsed, read_source
from cairn.streaming.follow import follow


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("getHTTPServer", "get http server"), ("  foo_bar-baz ", "foo bar baz"), ("ÉcoleNormale", "école normale"), ("v2Beta", "v2 beta"), ("---", ""), ("", "")],
)
def test_normalized(spark, text, want):
    assert one(spark, normalized(F.lit(text))) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.TS", "ts"), ("a/.gitignore", None), ("a.b/c", None), ("x.", None), ("a/b.spec.ts", "ts"), ("a." + "x" * 33, None)])
def test_extension(spark, path, want):
    assert one(spark, extension(F.lit(path))) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://GitHub.com/a/b/", "https://github.com/a/b"), ("http://github.com/a", None), ("https://u:p@x.org/a", None), ("https://x.org/a?b=1", None), ("https://x.org/a#b", None), ("not a url", None)],
)
def test_urls(spark, url, want):
    assert one(spark, normalized_url(F.lit(url))) == want


def test_provider(spark):
    assert [one(spark, provider(F.lit(u))) for u in ("https://github.com/a", "https://gitlab.com/a", "https://bitbucket.org/a", "https://own.org/github.com")] == ["github", "gitlab", "bitbucket", "generic"]


def test_round_halves_go_up(spark):
    assert one(spark, round6(F.lit(201.66666716337204))) == 201.666667
    assert one(spark, round6(F.lit(-0.0000005))) == 0.0


# Search.

DOCS = [
    (1, "symbol", "findOrder", "OrderService", "src/order.service.ts", "find order by id", "en", "class", 10, None, None, None),
    (2, "file", "", "src/order.service.ts", "src/order.service.ts", "order service 100% findOrder", "ts", None, None, 1, 2, None),
    (3, "knowledge_node", "order", "Order", None, "an order", None, "concept", None, None, None, 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, source_type string, name string, title string, path string, content string, language string, kind string, code_symbol_id long, indexed_file_id long, file_hash_id long, knowledge_node_id long").withColumn("search_index_id", F.lit(1))


def test_scores_add_up(docs):
    got = {r["id"]: r for r in s.candidates(docs, "ORDER").collect()}
    assert {k: r["exact"] for k, r in got.items()} == {1: 70 + 40, 2: 40, 3: 120 + 110 + 70 + 65}
    # 1: title and path A, content C; 2: title and path A, content C twice; 3: title A, content C
    assert {k: r["rank"] for k, r in got.items()} == {k: pytest.approx(50 * w / (w + 1)) for k, w in {1: 2.2, 2: 2.4, 3: 1.2}.items()}
    assert all(r["score"] == pytest.approx(r["exact"] + r["rank"], abs=1e-6) for r in got.values())
    order = [r["id"] for r in s.page(s.candidates(docs, "order"), s.page_order()).collect()]
    assert order == [3, 1, 2]


def test_wildcards_are_literal_in_signals(docs):
    assert s.candidates(docs, "%").count() == 0
    assert s.candidates(docs, "100%").select("id", "lexical").collect() == [(2, True)]


def test_all_terms_must_match(docs):
    assert [r["id"] for r in s.candidates(docs, "find missing").collect()] == []
    assert {r["id"] for r in s.lookup(s.postings(docs), ["order", "find"]).collect()} == {1, 2}
    assert s.candidates(docs, " - ").count() == 0


def test_optional_filters(docs):
    assert s.candidates(docs, "order", source_type="file", language=None).count() == 1


def test_graph_score_is_capped_at_the_last_accepted(spark):
    rows = [(9, 1, 1, 25.2), (9, 2, 1, 20.1), (9, 3, 1, 27.0), (9, 4, 1, 3.0)]
    got = s.capped(spark.createDataFrame(rows, "document_id long, seed_order long, neighbour_rank int, contribution double"))
    assert [r["accepted"] for r in got.orderBy("seed_order").collect()] == [25.2, 20.1, 4.7, 0.0]


def test_a_graph_only_document_scores_27(spark, docs):
    rel = spark.createDataFrame([(1, "knowledge_edge", "outgoing")], "document_id long, graph_source string, direction string")
    assert rel.select(s.contribution(F.lit(150.0)).alias("x")).first()["x"] == 27.0
    graph = spark.createDataFrame([(3, 27.0)], "document_id long, contribution double")
    lexical = spark.createDataFrame([(1, 110.0)], "id long, score double")
    assert [(r["id"], r["total_score"]) for r in s.fused(lexical, graph, docs).orderBy(*s.fused_order()).collect()] == [(1, 110.0), (3, 27.0)]


def test_covers():
    assert covers([(1, "a", 1.0), (2, "b", 1.0)], {"a", "b"}) == 1.0
    near, far = covers([(1, "a", 0.2), (2, "b", 0.2)], {"a", "b"}), covers([(1, "a", 0.2), (9, "b", 0.2)], {"a", "b"})
    assert near > far > 0 and covers([(1, "a", 1.0)], {"a", "b"}) == 0.0


def test_rank_is_bounded_and_ordered(docs):
    got = {r["id"]: r["rank"] for r in rank(s.postings(docs), ["order"]).collect()}
    assert all(0 < v < 50 for v in got.values()) and set(got) == {1, 2, 3}
    two = {r["id"]: r["rank"] for r in rank(s.postings(docs), ["order", "find"]).collect()}
    assert set(two) == {1, 2} and all(0 < v < 50 for v in two.values())
    assert rank(s.postings(docs), []).count() == 0


def test_a_single_terms_rank_is_that_of_its_covers(docs):
    own = s.postings(docs).filter("term = 'order'").collect()
    got = {r["id"]: r["rank"] for r in rank(s.postings(docs), ["order"]).collect()}
    for r in own:
        w = covers([(x["position"], "order", WEIGHTS[x["weight"]]) for x in r["positions"]], {"order"})
        assert got[r["id"]] == pytest.approx(50 * w / (w + 1))


def test_written_index_answers_alike_and_terms_reach_its_scan(spark, docs, tmp_path):
    index = s.SearchIndex.write(docs, str(tmp_path / "index"))
    for raw in ("order", "find order", "%", "src/order.service.ts"):
        assert sorted(s.candidates(index, raw).select("id", "score").collect()) == sorted(s.candidates(docs, raw).select("id", "score").collect())
    text = s.lookup(index.postings, ["order"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,order)" in text and "content" not in s.candidates(index, "order")._jdf.queryExecution().executedPlan().toString()


def test_query_terms_are_those_of_the_expressions(spark):
    for raw in ("findOrderById HTTPServer2Go", " - % ", "", "Straße ÉCOLE日本 x_y", "a a b"):
        assert query_terms(raw) == spark.range(1).select(terms(F.lit(raw)).alias("x")).first()["x"], raw


# Reconciliation and ingestion.


def test_branch_sync(spark):
    known = spark.createDataFrame([(1, "main", "a", "active"), (2, "gone", "b", "active"), (3, "back", "c", "deleted"), (4, "old", "d", "deleted")], "id long, name string, head string, status string")
    seen = spark.createDataFrame([("main", "a2"), ("back", "c"), ("new", "e")], "name string, head string")
    got = {r["name"]: (r["id"], r["head"], r["status"], r["action"]) for r in reconcile.soft_deleted(known, seen, ["name"], ["head"]).collect()}
    assert got == {"main": (1, "a2", "active", "seen"), "gone": (2, "b", "deleted", "deleted"), "back": (3, "c", "active", "restored"), "new": (None, "e", "active", "created"), "old": (4, "d", "deleted", "gone")}


def test_reconcile_empty_sides(spark):
    some = spark.createDataFrame([("k", 1)], "key string, v int")
    none = some.limit(0)
    assert [r["action"] for r in reconcile.reconcile(none, some, ["key"], ["v"]).collect()] == ["created"]
    assert [r["action"] for r in reconcile.reconcile(some, none, ["key"], ["v"]).collect()] == ["removed"]
    assert [r["action"] for r in reconcile.reconcile(some, some, ["key"], ["v"]).collect()] == ["unchanged"]


@pytest.mark.parametrize(
    ("source", "name", "want"),
    [
        ("src/a/b.ts", "./c.js", ["src/a/c.ts", "src/a/c.tsx", "src/a/c.js"]),
        ("src/a/b.ts", "../c.jsx", ["src/c.tsx", "src/c.jsx"]),
        ("b.ts", "../c", []),
        ("b.ts", "./c.ts", ["c.ts"]),
        ("src/b.ts", "pkg", []),
        ("src/b.ts", "./x/../y.spec", [f"src/y.spec{e}" for e in ingest.SOURCE_EXTENSIONS] + [f"src/y.spec/index{e}" for e in ingest.SOURCE_EXTENSIONS]),
    ],
)
def test_module_candidates(spark, source, name, want):
    assert one(spark, ingest.module_candidates(F.lit(source), F.lit(name))) == want


def test_symbol_resolution_never_guesses(spark):
    symbols = spark.createDataFrame(
        [(1, 7, "A", "A", True, False), (2, 7, "A", "N.A", False, False), (3, 7, "B", "B", False, True), (4, 7, "C", "C", False, False), (5, 7, "C", "M.C", False, False), (6, 8, "D", "D", False, True), (7, 8, "E", "E", False, True)],
        "id long, indexed_file_id long, name string, qualified_name string, exported boolean, default_export boolean",
    )
    refs = spark.createDataFrame([(1, 7, "N.A"), (2, 7, "X.A"), (3, 7, "C"), (4, 7, "default"), (5, 8, "default"), (6, 7, "*"), (7, 7, None), (8, 7, "Z.C"), (9, 9, "A")], "id long, file_id long, target_name string")
    got = {r["id"]: r["target_symbol_id"] for r in ingest.resolved_symbols(refs, symbols).collect()}
    assert got == {1: 2, 2: 1, 3: 4, 4: 3, 5: None, 6: None, 7: None, 8: None, 9: None}


def test_unsafe_paths(spark):
    good, bad = ["a/b.ts", "a.b/..c"], ["", "/a", "a//b", "a/../b", "./a", "a\\b", "a\x01", "a/" * 70 + "b", "x" * 1025, "a�"]
    tree = spark.createDataFrame([(p,) for p in good + bad], "path string")
    assert {r["path"] for r in ingest.path_violations(tree).collect()} == set(bad)


def test_discovery_order(spark):
    tree = spark.createDataFrame([("120000", "dist/a.ts", 1), ("100644", "Dist/a.bin", 1), ("100644", "a.bin", 10**9), ("100755", "a.ts", 10**9), ("100644", "a.ts", 5)], "mode string, path string, size_bytes long")
    assert [r["o"] for r in tree.select(ingest.outcome().alias("o")).collect()] == ["special", "ignored", "unsupported", "oversized", "selected"]


# Analysis.


def test_concept_names(spark):
    got = [one(spark, analysis.concept_name(F.lit(x))) for x in ("OrderService", "Service", "HTTPClientDto", "order_line", "___")]
    assert got == ["Order", "Service", "HTTP Client", "order line", None]


def test_rule_cascade_order(spark):
    kind = lambda c, e, o="throw": one(spark, analysis.rule_type(F.lit(c), F.lit(e), F.lit(o)))
    assert kind("status eligible", "") == "state_constraint" and kind("", "status eligible") == "eligibility"
    assert kind("x", "y") == "validation" and kind("x", "y", "log") is None


def test_last_part_of_a_decorator_counts_and_conflicts_are_told(spark):
    symbols = spark.createDataFrame([(1, "A", "x.ts"), (2, "BService", "x.ts"), (3, "C", "config/x.ts"), (4, "D", "x.ts")], "id long, name string, path string")
    decorators = spark.createDataFrame([(1, "n.Module"), (1, "Controller"), (2, "Injectable"), (4, "Other")], "symbol_id long, name string")
    got = {r["id"]: (r["type"], r["confidence"], r["conflict"]) for r in analysis.component_type(symbols, decorators).collect()}
    assert got == {1: (None, None, True), 2: ("service", 0.95, False), 3: ("configuration", 0.85, False), 4: (None, None, False)}


def test_names_go_to_the_first_tier_that_has_any(spark):
    from cairn.operators.calls import resolved_names

    components = spark.createDataFrame([(1, 1, "A", "A"), (2, 1, "A", "ns.A"), (3, 2, "A", "A"), (4, 2, "B", "B"), (5, 3, "C", "C"), (6, 3, "C", "C")], "component long, file_id long, name string, qualified_name string")
    imports = spark.createDataFrame([(9, "X", 4, None), (9, "ns", 1, None), (2, "A", 1, None), (2, "A", 3, None), (9, "Gone", 99, None)], "file_id long, local_name string, target_symbol long, target_file long")
    refs = spark.createDataFrame([(1, 9, "X"), (2, 9, "ns.A.q"), (3, 1, "A"), (4, 1, "ns.A"), (5, 2, "A"), (6, 9, "B"), (7, 9, "C"), (8, 9, "Gone"), (9, 7, "ns.A")], "id long, file_id long, name string")
    got = {r["id"]: (r["tier"], r["status"], r["target"]) for r in resolved_names(refs, components, imports).collect()}
    assert got == {1: (0, "resolved", 4), 2: (0, "resolved", 1), 3: (1, "ambiguous", None), 4: (1, "resolved", 2), 5: (0, "ambiguous", None), 6: (2, "resolved", 4), 7: (2, "ambiguous", None), 8: (None, "unresolved", None), 9: (2, "resolved", 2)}


def test_ties_of_confidence(spark):
    facts = spark.createDataFrame([("k", 50, 1, "a"), ("k", 90, 2, "b"), ("k", 90, 3, "c")], "key string, confidence_pct long, ord long, v string")
    assert analysis.most_confident(facts, ["key"], ["v"], "ord").first()["v"] == "b"
    assert analysis.last_wins(facts, ["key"], ["v"], "ord").first()["v"] == "c"
    assert analysis.first_wins(facts, ["key"], "v", "ord").first()["v"] == "a"


SOURCE = """import Def, { A, type B as C } from './a';
import * as ns from "../b.js";
import './side';
/** Orders. */
@Controller('orders')
export class OrderService extends ns.Base<{ a: Foo }> implements X {
  private readonly re = /a\\/b[/"]/g;
  constructor(private readonly repo: OrderRepository, @Inject(T) other?: ns.Thing) { super(); }
  @Get() async find(id: string): Promise<{ a: number }> {
    if (!user.hasRole) { throw new ForbiddenError('no'); }
    const rows = await this.repo.load(id, (x) => helper(x));
    this.status = OrderStatus.Paid; this.bus.emit('order.paid', rows);
    return `a ${fmt(`b }`)} c`;
  }
  get total() { return this.sum(1); }
  @OnEvent('order.paid') private handle(e) { log(e) }
}
export enum OrderStatus { Draft = 'd', Paid = 'p' }
export type Alias = { a: string } | null;
export const make = async (x: number) => { return x; };
export default function main() { make(1); }
export { A as Z } from './z';
export * from './all';
"""


def test_reading_a_source():
    got = read_source(SOURCE)
    assert [(x["kind"], x["qualified_name"]) for x in got.symbols] == [
        ("class", "OrderService"), ("method", "OrderService.constructor"), ("method", "OrderService.find"), ("method", "OrderService.total"), ("method", "OrderService.handle"), ("enum", "OrderStatus"), ("type_alias", "Alias"), ("function", "make"), ("function", "main"),
    ]
    find = got.symbols[2]
    assert SOURCE[find["start_offset"] :].startswith("@Get()") and SOURCE[: find["end_offset"]].endswith("c`;\n  }")
    assert [(x["default_import"], x["namespace_import"], x["module"]) for x in got.imports] == [("Def", None, "./a"), (None, "ns", "../b.js"), (None, None, "./side")]
    assert [(x["kind"], x["exported"]) for x in got.exports][-3:] == [("default", "default"), ("re_export", "Z"), ("all", None)]
    assert [x["target"] for x in got.heritage] == ["ns.Base", "X"]
    assert {"this.repo.load", "helper", "this.bus.emit", "this.sum", "log", "make"} <= {x["callee"] for x in got.calls}
    assert [x["type"] for x in got.injections] == ["OrderRepository", "ns.Thing"]
    assert [(x["event"], x["operation"]) for x in got.events] == [("order.paid", "emit"), ("order.paid", "handle")]
    assert got.guards[0]["condition"] == ["hasRole", "user"] and not got.diagnostics


def test_reading_never_fails(spark, data):
    import random

    draw = random.Random(1)
    parts = ["class", "A", "{", "}", "(", ")", "export", "default", "import", "from", "'x'", "`", "${", "/", "*", "@", "=>", "=", ";", "\n", "enum", "if", "<", ">", ",", ".", "function", "const", "type", "/**", "*/", "\\", '"', "async", "😀"]
    for _ in range(3000):
        read_source(" ".join(draw.choice(parts) for _ in range(draw.randint(1, 40))))
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "id long, text string"))
    assert parsed(docs).count() == docs.count()


# Lifecycles, tenancy, rules.

JOB = "id long, status string, phase string, cancel_requested boolean, attempt_count long, max_attempts long, next_attempt long, lease_expires long, created long, processed_files long, skipped_files long, failed_files long, total_files long, worker string"


def test_jobs(spark):
    rows = [
        (1, "queued", "queued", False, 0, 3, 900, None, 1, 0, 0, 0, 0, None), (2, "queued", "queued", False, 3, 3, None, None, 2, 0, 0, 0, 0, None), (3, "queued", "queued", False, 0, 3, None, None, 4, 0, 0, 0, 0, None), (4, "queued", "queued", True, 0, 3, None, None, 0, 0, 0, 0, 0, None),
        (5, "running", "finalizing", False, 1, 3, None, 100, 5, 2, 1, 0, 3, "w"), (6, "running", "finalizing", False, 3, 3, None, 50, 6, 2, 0, 1, 3, "w"), (7, "running", "hashing", True, 1, 3, None, 900, 7, 0, 0, 0, 3, "v"),
    ]
    table = spark.createDataFrame(rows, JOB)
    assert jobs.claim_next(table, 500).first()["id"] == 3
    assert [(r["id"], r["next_status"]) for r in jobs.recovered(table, 500, 10).collect()] == [(6, "failed"), (5, "queued")]
    assert [r["id"] for r in jobs.completable(table).collect()] == [5]
    assert {r["id"]: r["next_status"] for r in jobs.failed(table, F.lit(False)).collect()} == {5: "failed", 6: "failed", 7: "cancelled"}
    assert {r["id"]: r["lease_expires"] for r in jobs.heartbeat(table, "w", 60, 30).collect() if r["worker"]} == {5: 90, 6: 50, 7: 900}


def test_relational_division(spark):
    granted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "user_id long, permission string")
    assert {r["user_id"]: r["allowed"] for r in tenancy.has_all(granted, ["a", "b"]).collect()} == {1: True, 2: False}
    assert all(r["allowed"] for r in tenancy.has_all(granted, []).collect())


def test_scope_of_a_frame_without_the_column_is_an_error(spark):
    with pytest.raises(Exception, match="organization_id"):
        Scope(1).of(spark.range(3)).collect()


def test_rules_with_nulls(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id long, n long")
    assert {r["id"]: r["broken"] for r in rules.violations(rows, small=F.col("n") < 10, set=F.col("n").isNotNull()).collect()} == {2: ["small", "set"], 3: ["small"]}
    with pytest.raises(ValueError, match="files"):
        rules.Limits(files=0)


# Functions, sources, storage, streams.


def test_canonical_json():
    assert canonical.canonical({"b": None, "a": [1.0, 2.5, "é"]}) == '{"a":[1,2.5,"é"],"b":null}'
    with pytest.raises(ValueError, match="number"):
        canonical.canonical([float("nan")])
    assert canonical.property_terms('{"b": {"x": [1, true, null]}, "a": "v"}') == ["a", "v", "b", "x", "1", "true"]
    assert canonical.property_terms("broken") == [] and canonical.truncated_utf8("aé😀", 6) == "aé" and canonical.truncated_utf8(None, 3) is None
    assert digest({"a": 1, "b": 2}) == digest({"b": 2, "a": 1.0})


def test_identity_hash_keeps_nulls(spark):
    import hashlib

    got = spark.createDataFrame([("x", None, 3)], "a string, b long, c long").select(canonical.array_hash("a", "b", "c").alias("h")).first()["h"]
    assert got == hashlib.sha256(b'["x",null,3]').hexdigest()


def test_git(spark, tmp_path):
    origin = tmp_path / "origin"
    run = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True, text=True).stdout
    origin.mkdir()
    run("init", "-q", "-b", "main")
    (origin / "a b.ts").write_text("class A {}")
    run("add", ".")
    run("commit", "-qm", "one")
    copy = git.sync(str(origin), str(tmp_path / "copies"), "org-1", 7)
    (origin / "c.md").write_text("text")
    run("add", ".")
    run("commit", "-qm", "two")
    assert git.sync(str(origin), str(tmp_path / "copies"), "org-1", 7) == copy
    listing = tmp_path / "tree"
    listing.write_bytes(subprocess.run(["git", "--git-dir", copy, "ls-tree", "-r", "-z", "--long", "main"], check=True, capture_output=True).stdout)
    got = {(r["path"], r["size_bytes"], r["mode"]) for r in git.tree(spark, str(listing)).collect()}
    assert got == {("a b.ts", 10, "100644"), ("c.md", 4, "100644")}
    with pytest.raises(ValueError, match="organisation"):
        git.sync(str(origin), str(tmp_path), "../up", 1)
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs/ok").write_text("é")
    (tmp_path / "blobs/bad").write_bytes(b"\xff\xfe")
    (tmp_path / "blobs/big").write_text("x" * 99)
    assert sorted((r["path"].rsplit("/", 1)[1], r["text"], r["refused"]) for r in git.blobs(spark, str(tmp_path / "blobs"), 10).collect()) == [("bad", None, True), ("big", None, True), ("ok", "é", False)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(1, spark.range(3))
    store.write(1, spark.range(5))
    store.publish(1)
    for change in (lambda: store.write(1, spark.range(1)), lambda: store.reset(1)):
        with pytest.raises(ImmutableVersion):
            change()
    assert store.read(1).count() == 5
    store.write(2, spark.range(0))
    with pytest.raises(ValueError, match="empty"):
        store.publish(2)
    with lock("b"), pytest.raises(RuntimeError), lock("b"):
        pass


def test_follow(spark, tmp_path):
    store, incoming = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(incoming)
        follow(spark, incoming, "id long", store, str(tmp_path / "checkpoint"), lambda df: df.withColumn("twice", F.col("id") * 2)).awaitTermination(60)
    assert store.read(1).count() == 3 and store.read(2).agg(F.sum("twice")).first()[0] == 12


def test_batches_persist_wholly_once_or_not_at_all(spark):
    from cairn.operators import knowledge as kn

    node = lambda key, print_, kind="state": (kind, key, key.upper(), 90, True, print_, 1)
    edge = lambda key, a, b: ("transitions_to", key, "state", a, "state", b, 80, True, "p" + key, 1)
    nodes = lambda *rows: spark.createDataFrame(rows, "kind string, identity_key string, name string, confidence_pct long, deterministic boolean, fingerprint string, evidence long")
    edges = lambda *rows: spark.createDataFrame(rows, "kind string, identity_key string, source_kind string, source_key string, target_kind string, target_key string, confidence_pct long, deterministic boolean, fingerprint string, evidence long")
    old = nodes(node("a", "1"))
    batch = nodes(node("a", "1"), node("b", "2"), node("a", "9", "workflow")), edges(edge("ab", "a", "b"))
    own = kn.persisted(old, edges(), *batch)
    keys = lambda df: sorted((r["kind"], r["identity_key"]) for r in df.collect())
    assert keys(own[0]) == [("state", "a"), ("state", "b"), ("workflow", "a")] and keys(own[1]) == [("transitions_to", "ab")]
    again = kn.persisted(*own, *batch)
    assert [keys(x) for x in again] == [keys(x) for x in own]
    for bad in ((nodes(node("a", "other")), edges()), (nodes(node("c", "1"), node("c", "2")), edges()), (nodes(), edges(edge("ax", "a", "x"))), (nodes(), edges(edge("ab", "a", "b"), ("transitions_to", "ab", "state", "a", "state", "b", 70, True, "q", 1)))):
        with pytest.raises(kn.Conflict):
            kn.persisted(*own, *bad)
    assert {(r["identity_key"], r["action"]) for r in kn.outcomes(old, nodes(node("a", "1"), node("b", "2"))).collect()} == {("a", "kept"), ("b", "inserted")}


def test_components_around_evidence_are_the_narrowest_of_the_file(spark):
    from cairn.operators.ingest import enclosing

    ranges = spark.createDataFrame([("wide", 1, 0, 90_000), ("mid", 1, 8_000, 12_300), ("tie", 1, 8_000, 12_300), ("other", 2, 0, 10)], "component string, file_id long, start_offset long, end_offset long")
    items = spark.createDataFrame([(1, 1, 8_100, 12_000), (2, 1, 8_100, 12_301), (3, 1, 89_999, 90_001), (4, 2, 0, 10), (5, 3, 1, 1)], "fact_id long, file_id long, start_offset long, end_offset long")
    assert {r["fact_id"]: r["component"] for r in enclosing(items, ranges, ["fact_id"], "component").collect()} == {1: "mid", 2: "wide", 4: "other"}
