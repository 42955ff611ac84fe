import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from cairn.operators import calls as c
from cairn.operators import knowledge as kn
from cairn.operators.analysis import fact_violations, rule_text
from cairn.operators.ranges import numbered
from cairn.operators.rules import Limits, exceeded, measured
from cairn.operators.states import state_facts
from cairn.plans.packs import packed
from cairn.sources import git_objects as g
from cairn.sources.store import stored
from cairn.sources.typescript import read_source

SYMBOLS = "id long, file_id long, name string, qualified_name string, kind string, start_offset int, end_offset int"
#: File 1: class A (1) with load and save, nested class A.In (2) with keep; file 2: class B (3) extends A, class C (4) extends B; file 3: class A (5), function free.
ROWS = [
    (1, 1, "A", "A", "class", 0, 100), (2, 1, "In", "A.In", "class", 50, 90), (3, 2, "B", "B", "class", 0, 100), (4, 2, "C", "C", "class", 200, 300), (5, 3, "A", "A", "class", 0, 50),
    (11, 1, "load", "A.load", "method", 5, 10), (12, 1, "save", "A.save", "method", 12, 20), (13, 1, "keep", "A.In.keep", "method", 60, 70), (14, 2, "run", "B.run", "method", 5, 50),
    (15, 2, "go", "C.go", "method", 210, 250), (16, 3, "load", "A.load", "method", 5, 10), (17, 3, "free", "free", "function", 60, 70), (18, 2, "free", "free", "function", 400, 410), (19, 4, "loose", "loose", "method", 0, 5),
]
COMPONENTS = {1: "service", 2: "service", 3: "controller", 4: "service", 5: "repository"}


@pytest.fixture(scope="module")
def code(spark):
    symbols = spark.createDataFrame(ROWS, SYMBOLS)
    types = spark.createDataFrame(list(COMPONENTS.items()), "id long, type string")
    components = symbols.join(types, "id").select(F.col("id").alias("component"), "file_id", "name", "qualified_name", "kind", "type", "start_offset", "end_offset", F.concat(F.lit("c"), "id").alias("identity_key"), F.lit("p.ts").alias("path"))
    # file 2 imports A of file 1, a namespace of file 3, and a function
    imports = spark.createDataFrame([(2, "A", 1, None), (2, "ns", None, 3), (2, "fn", 17, None), (2, "gone", 999, None)], "file_id long, local_name string, target_symbol long, target_file long")
    extends = spark.createDataFrame([(3, 1), (4, 3), (1, 4), (5, 5), (2, None)], "child long, parent long")  # a ring, and one that extends itself
    injections = spark.createDataFrame([(1, 14, "repo", "Gone", None), (2, 14, "repo", "A", None), (3, 15, "any", " ", "A.In"), (4, 15, " ", "A", None), (5, 19, "repo", "A", None)], "ord long, symbol_id long, parameter string, type_name string, target_name string")
    return symbols, components, imports, extends, injections


CALLS = [
    (1, 2, 14, "this", "run", ("resolved", 14)), (2, 2, 14, "this", "load", ("unresolved", None)), (3, 2, 14, "this.repo", "load", ("resolved", 11)), (4, 2, 14, "super", "load", ("resolved", 11)),
    (5, 2, 15, "super", "load", ("unresolved", None)), (6, 2, 14, "A", "save", ("resolved", 12)), (7, 2, 14, "ns", "free", ("resolved", 17)), (8, 2, 14, None, "fn", ("resolved", 17)), (9, 2, 14, None, "free", ("resolved", 18)),
    (10, 2, 14, "x.y", "run", ("unresolved", None)), (11, 2, 14, " ", "free", ("resolved", 18)), (12, 2, 14, "this", " ", ("unresolved", None)), (13, 4, 19, "A", "load", ("ambiguous", None)), (14, 4, 19, "A", "save", ("resolved", 12)),
    (15, 4, 19, "this", "loose", ("unresolved", None)), (16, 2, 15, "this.any", "save", ("resolved", 12)), (17, 1, 13, "this", "keep", ("resolved", 13)), (18, 1, 12, "this", "save", ("resolved", 12)), (19, 2, None, "B", "run", ("resolved", 14)), (20, 2, 15, "this.none", "run", ("unresolved", None)),
]


def calls_of(spark, rows=CALLS):
    return spark.createDataFrame([r[:5] for r in rows], "id long, file_id long, symbol_id long, receiver string, member string")


def test_calls_by_each_receiver(spark, code):
    got = {r["id"]: (r["status"], r["target"]) for r in c.resolved_calls(calls_of(spark), *code).collect()}
    assert got == {r[0]: r[5] for r in CALLS}
    out = {(r["id"], r["output"], r["kind"], r["target"]) for r in c.call_outputs(c.resolved_calls(calls_of(spark), *code)).collect()}
    assert (1, "relationship", "calls", 3) in out and (13, "diagnostic", "ambiguous_call_target", None) in out and not any(r[0] in (2, 7, 19) for r in out)
    assert c.resolved_calls(calls_of(spark, []), *code).count() == 0


def test_inherited_members_are_of_the_nearest_class_above(spark, code):
    line = {(r["component"], r["ancestor"]): r["level"] for r in c.lineage(code[3]).collect()}
    assert line == {(3, 1): 1, (4, 3): 1, (1, 4): 1, (3, 4): 2, (4, 1): 2, (1, 3): 2}  # the ring ends, and what extends itself has nothing above
    got = {r["id"]: r["target"] for r in c.resolved_calls(calls_of(spark), *code, climb=4).collect()}
    assert got[2] == 11 and got[5] == 11 and got[1] == 14 and got[17] == 13
    none = code[3].filter("false")
    assert c.lineage(none).count() == 0 and c.resolved_calls(calls_of(spark), *code[:3], none, code[4], climb=4).filter("id = 2").first()["status"] == "unresolved"


def test_calls_without_a_target_are_many_tasks(spark, code):
    set_, held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}, {}
    calls = calls_of(spark, [(k, 2, 14, "zz", "q", None) for k in range(400)] + [(400, 2, 14, "A", "load", None)])
    try:
        for k, v in set_.items():
            held[k] = spark.conf.get(k)
            spark.conf.set(k, v)
        got = c.resolved_calls(calls, *code).select("id", "status", "target", "target_component", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    by = {}
    for r in got:
        by[r["task"]] = by.get(r["task"], 0) + 1
    assert len(got) == 401 and max(by.values()) < 250
    assert [(r["status"], r["target"], r["target_component"]) for r in sorted(got)[-1:]] == [("resolved", 11, 1)] and {r["target_component"] for r in got if r["id"] < 400} == {None}


@pytest.mark.parametrize("range_rows", [1_000, 7])
def test_numbers_within_keys_over_ranges(spark, range_rows):
    rows = [("hot" if k % 2 else f"k{k % 5}", k * 7 % 101) for k in range(101)] + [(None, 500), (None, 501)]
    got = numbered(spark.createDataFrame(rows, "key string, at int").repartition(3), "key", ["at"], "nth", len(rows), range_rows).collect()
    by = {}
    for r in got:
        by.setdefault(r["key"], []).append((r["nth"], r["at"]))
    assert len(got) == 103 and all([x[0] for x in sorted(v)] == list(range(len(v))) and sorted(v) == sorted(v, key=lambda x: x[1]) for v in by.values())


def test_workflows_and_their_graph(spark, code):
    symbols, components, *rest = code
    rows = [(1, 2, 14, "this", "run", None), (2, 2, 14, "A", "load", None), (3, 2, 14, "A", "save", None), (4, 2, 14, "zz", "q", None), (5, 2, 14, "A", "save", None)]
    sites = {1: (30, "this.run"), 2: (10, "A.load"), 3: (None, None), 4: (5, "zz.q"), 5: (20, "A.save")}
    calls = calls_of(spark, rows).join(spark.createDataFrame([(k, f"call{k}", v[1], v[0], v[0]) for k, v in sites.items()], "id long, identity_key string, callee string, start_offset int, end_offset int"), "id")
    decorators = spark.createDataFrame(
        [(1, "web.Get", "method", "run", "/x", 14, 2, 5, 50), (2, "Get", "class", "run", "/x", 14, 2, 5, 50), (3, "Inject", "method", "run", None, 14, 2, 5, 50), (4, "Post", "method", " ", None, 15, 2, 210, 250), (5, "Put", "method", "run", None, None, 2, 5, 50)],
        "fact_id long, name string, target_kind string, target_name string, path string, symbol_id long, file_id long, start_offset int, end_offset int",
    )
    facts = stored(c.workflows(decorators, components, calls, c.resolved_calls(calls, symbols, components, *rest)), "wf")
    got = facts.orderBy("kind", "step").collect()
    assert [(r["kind"], r["name"], r["step"], r["component_key"]) for r in got] == [
        ("workflow", "GET /x → run", None, "c3"), ("workflow_step", "run", 0, "c3"), ("workflow_step", "A.load", 1, "c1"), ("workflow_step", "A.save", 2, "c1"), ("workflow_step", "this.run", 3, "c3"), ("workflow_step", "symbol:12", 4, "c1")
    ]
    assert (got[0]["steps"], got[0]["unresolved"], got[0]["ambiguous"]) == (5, 1, 0)
    p = kn.workflows(facts, components)
    assert p.violations.count() == 0 and p.nodes.count() == 6
    kinds = sorted((r["kind"], r["evidence"]) for r in p.edges.collect())
    assert kinds == sorted([("contains", 1)] * 6 + [("calls", 1)] * 4 + [("precedes", 2)] * 4)
    # without its head, without a step, twice, and with an unknown component
    bad = lambda df, known=components: {(r["rule"]) for r in kn.workflows(df, known).violations.collect()}
    assert bad(facts.filter("kind = 'workflow_step'")) == {"orphan_step"} and bad(facts.filter("step is null or step <> 2")) == {"invalid_steps"}
    assert bad(facts.unionByName(facts.filter("kind = 'workflow'"))) == {"repeated_workflow"} and bad(facts, components.filter("component <> 1")) == {"unknown_component"}
    assert {r["rule"] for r in c.beyond_limits(facts, 0, 4, 4).collect()} == {"too_many_workflows", "too_many_steps", "too_many_steps_of_one"} and c.beyond_limits(facts, 1, 5, 5).count() == 0


SOURCE = """
enum OrderStatus { Open = 'open', Paid, "Void" }
class M { status = S.Init;
  go(o: Order): void {
    if (o.status === OrderStatus.Open) { o.status = OrderStatus.Paid; } else { o.status = 'void'; }
    if ('a-b' == this.state) this.state = 'done';
    if (o.status === S.A && x) { o.status = S.B }
    if (o.status === S.A) { list.forEach(i => { o.status = S.C; }); if (y) o.status = S.D; }
    get(x).status = S.F; const status = S.H; o.status = S.next(); o.status = S.I || S.J; o.status = flag;
    let a = 1, state = S.R;
    status = S.T;
  }
  free = (state = S.P) => { this.status = `tpl`; this.state = 'has space'; };
  f() { const p = Math.round(a.b * c); this.total = price.toFixed(2); return Math.floor(n / 2); x = 1 + Math.ceil(q); (a+b).toFixed(1);
    if (!user.role) { audit(user); throw new Denied(user); }
    if (k) { await this.svc.run(k); }
  }
}
"""


def test_reader_follows_guards_to_assignments():
    s = read_source(SOURCE)
    moves = [(t["subject"], t["field"], t["from_state"], t["to_state"], t["container"], t["confidence_pct"], t["deterministic"]) for t in s.transitions]
    assert moves == [
        ("o", "status", "Open", "Paid", "M.go", 100, True), ("o", "status", None, "void", "M.go", 90, False), ("this", "state", "a-b", "done", "M.go", 90, False), ("o", "status", None, "B", "M.go", 100, False),
        ("o", "status", None, "C", "M.go", 100, False), ("o", "status", "A", "D", "M.go", 100, True), ("local", "status", None, "F", "M.go", 100, False), ("local", "status", None, "T", "M.go", 100, False), ("this", "status", None, "tpl", "M", 90, False),
    ]
    assert [(r["operation"], r["target"]) for r in s.roundings] == [("Math.round", "p"), ("price.toFixed", "this.total"), ("Math.floor", "return"), ("Math.ceil", None)]
    assert [(x["outcome_kind"], x["outcome_operation"], x["operation"]) for x in s.guards[-2:]] == [("throw", None, "!"), ("call", "this.svc.run", None)]
    at = s.transitions[0]
    assert SOURCE[at["offset"] : at["end_offset"]] == "o.status = OrderStatus.Paid" and SOURCE[at["condition_offset"] : at["condition_end"]] == "o.status === OrderStatus.Open"


@pytest.mark.parametrize("text", ["if (", "x.status =", "if (a) ", "status = ", "a.status = b.", "=> status = S.A", "if (x.status === ) x.status = S.A", "enum", "(status = S.A) =>", "x?.status = S.A;" * 3, "Math.round(", "if (a) if (b) if (c) x.state = S.A; else y()"])
def test_reader_takes_broken_sources(text):
    read_source(text)


def test_reader_takes_any_tokens():
    draw = random.Random(3)
    parts = ["class", "A", "{", "}", "(", ")", "if", "else", "status", "x.status", "this", ".", "?.", "=", "==", "===", "S.A", "'a'", "`b`", "=>", "function", "return", "throw", ";", "\n", ",", "[", "]", "for", "try", "catch", "do", "while", "Math.round", "a.toFixed", "const", ":", "!", "&&", "+=", "enum", "await", "super", "super."]
    for _ in range(4000):
        read_source(" ".join(draw.choice(parts) for _ in range(draw.randint(1, 50))))
    deep = "if (a) { " * 3000 + "x.status = S.A" + " }" * 3000
    read_source(deep)
    read_source("if (a) " * 5000 + "x.status = S.A;")
    read_source("x.status = S.A; " * 20_000)


def test_state_facts_of_files(spark):
    from cairn.sources.typescript import parsed

    files = spark.createDataFrame([(1, "a.ts", SOURCE), (2, "b.ts", "class B { r() { this.state = S.A; this.state = S.A; } }"), (3, "c.ts", None)], "id long, path string, text string")
    facts, evidence = state_facts(stored(parsed(files).join(files.select("id", "path"), "id"), "read"))
    rows = facts.collect()
    assert len({r["identity_key"] for r in rows if r["kind"] == "state_transition"}) == 11 and len({r["fact_id"] for r in rows}) == len(rows)
    twice = [r for r in rows if r["path"] == "b.ts" and r["kind"] == "state"]
    assert len(twice) == 1 and evidence.filter(F.col("fact_id") == twice[0]["fact_id"]).count() == 2
    assert kn.states(facts, evidence).violations.count() == 0


def test_rule_texts(spark):
    rows = [
        ("permission", ("b", "!", "user.role", ["user"]), ("throw", None, None, ["Denied"]), "K.run", "Reject with Denied when not user.role in K.run", "When not user.role, the code rejects execution with Denied in K.run."),
        ("some_rule", None, None, None, "Some rule rule", "The code enforces a Some rule rule."), ("x", ("binaryExpression", "===", None, []), ("return", None, None, []), None, "Return early when Binary expression", "When Binary expression, the code returns early."),
        ("x", ("b", None, None, ["a", "b", "c", "d"]), ("call", "go", None, []), "A\nB", "Call go when a and b and c in A B", "When a and b and c, the code calls go in A B."),
    ]
    kind = "struct<kind:string,operation:string,target:string,identifiers:array<string>>"
    got = rule_text(spark.createDataFrame([r[:4] for r in rows], f"rule_type string, condition {kind}, outcome {kind}, container string")).select("name", "summary").collect()
    assert sorted(tuple(r) for r in got) == sorted(r[4:] for r in rows)


def test_fact_rules(spark):
    good = (1, "k", "a", "1", 1.0, "{}")
    rows = [good, (2, "\n", "", None, float("nan"), None), (3, "x" * 511 + "\U0001f600", "a", "1", 0.5, "{}"), (4, "k", "a", "1", 0.0, "é" * 10)]
    facts = spark.createDataFrame(rows, "fact_id long, identity_key string, analyzer string, version string, confidence double, canonical string")
    kinds = "fact_id long, file_id long, hash_id long, symbol_id long, start_line int, start_column int, start_offset int, end_line int, end_column int, end_offset int"
    evidence = spark.createDataFrame([(1, 1, 1, None, None, None, None, None, None, None), (3, 1, 1, 1, 1, 1, 0, 1, 1, 0), (4, 1, 1, 1, 2, 1, 0, 1, 1, 0), (4, 1, 1, 1, 1, 1, 0, 1, 1, 0)], kinds)
    got = {(r["fact_id"], r["rule"]) for r in fact_violations(facts, evidence, 19).collect()}
    assert got == {(2, x) for x in ("invalid_identity", "invalid_analyzer", "invalid_confidence", "missing_evidence", "invalid_properties")} | {(3, "invalid_identity"), (4, "invalid_evidence"), (4, "properties_too_large")}


def test_limits(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 7)], "name string, n int")
    measures = measured(rows, "name", steps_per_workflow=F.col("n")).unionByName(measured(rows, workflows=F.count(F.lit(1))))
    assert {tuple(r) for r in exceeded(measures, Limits(steps_per_workflow=6, workflows=1)).collect()} == {("b", "steps_per_workflow", 7, 6), (None, "workflows", 2, 1)}
    with pytest.raises(Exception, match="no such limit"):
        exceeded(measured(rows, nothing=F.count(F.lit(1))), Limits()).collect()


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """Six commits, some packed with deltas, the last ones loose."""
    d = tmp_path_factory.mktemp("repository")
    run = lambda *a: subprocess.run(["git", "-C", str(d), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True).stdout
    draw = random.Random(1)
    run("init", "-q")
    for commit in range(6):
        for k in range(30):
            path = d / f"src/d{k % 5}/e{k % 3}/f{k}.txt"
            path.parent.mkdir(parents=True, exist_ok=True)
            if commit == 0 or draw.random() < 0.4:
                base = path.read_text() if path.exists() else "\n".join(f"line {i} {draw.random()}" for i in range(draw.randint(0, 300)))
                path.write_text(base + f"\nchange {commit} {draw.random()}")
        (d / "big.bin").write_bytes(draw.randbytes(120_000))
        (d / "é.txt").write_text("x" * commit)
        run("add", "-A")
        run("commit", "-qm", f"c{commit}")
        if commit in (2, 4):
            run("gc", "-q", "--aggressive")
    return f"{d}/.git", run


def test_git_objects_equal_the_tool(spark, repository):
    path, run = repository
    want = {x[0]: (x[1], int(x[2])) for x in map(str.split, run("cat-file", "--batch-all-objects", "--batch-check").decode().splitlines())}
    got = g.objects(spark, path, 50_000, part_objects="37").collect()
    assert {r["object_id"]: (r["type"], r["size"]) for r in got} == want
    assert {r["size"] for r in got if r["content"] is None} == {120_000}
    for r in got[::11]:
        assert r["content"] is None or bytes(r["content"]) == run("cat-file", r["type"], r["object_id"])
    assert {r["type"] for r in g.objects(spark, path, 10, "tree").collect()} == {"tree"}
    with pytest.raises(Exception, match="no bare repository"):
        g.objects(spark, "/nowhere").collect()


def test_tree_of_a_commit_equals_the_tool(spark, repository):
    path, run = repository
    commit = run("rev-parse", "HEAD").decode().strip()
    every = g.objects(spark, path)
    known = stored(g.entries(every.filter("type = 'tree'").dropDuplicates(["object_id"])), "entries")
    got = {(r["mode"], r["object_id"], r["path"]) for r in g.listing(known, g.tree_of(every.filter("type = 'commit'"), commit)).collect()}
    parted = (x.split("\t") for x in run("ls-tree", "-r", "-z", "--full-tree", commit).decode().split("\0")[:-1])
    assert got == {(a.split()[0], a.split()[2], p) for a, p in parted}
    with pytest.raises(ValueError, match="no commit"):
        g.tree_of(every.filter("type = 'commit'"), "0" * 40)


def test_written_packs_pass_the_tool(spark):
    blobs = spark.createDataFrame([(f"<p>{'same ' * (k % 40)}{k}</p>".encode(),) for k in range(200)] + [(b"",), (b"",), (None,)], "content binary")
    root = packed(blobs)
    packs = [x for x in os.listdir(f"{root}/objects/pack") if x.endswith(".idx")]
    told = "".join(subprocess.run(["git", "verify-pack", "-v", f"{root}/objects/pack/{x}"], check=True, capture_output=True, text=True).stdout for x in packs)
    assert " blob " in told and "chain length = 2" in told
    assert g.objects(spark, root, part_objects="9").count() == 201


def test_broken_objects_are_told():
    assert g.applied(b"hello", bytes([5, 7, 0x90, 5, 2]) + b"!!") == b"hello!!"
    for delta in (bytes([4, 5, 0x90, 5]), bytes([5, 9, 0x90, 5]), bytes([5, 5, 0]), b"\x85"):
        with pytest.raises(g.Broken):
            g.applied(b"hello", delta)
