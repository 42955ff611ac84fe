import random

import pytest
from pyspark.sql import functions as F

from cairn.functions.cover_density import WEIGHTS, covered, covers, rank
from cairn.operators import search as s

DOC = "id long, search_index_id long, source_type string, name string, title string, path string, kind string, language string, content string"
WORDS = ["order", "find", "Paid", "parseHTTPRequest", "x_y", "é", "İstanbul", "100%", "a.b"]


def drawn(n=120):
    draw = random.Random(7)
    text = lambda k: " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, k)))
    rows = [(k, 1, draw.choice(["file", "symbol"]), draw.choice([None, "", "Find", text(2)]), draw.choice(["", None, "order", text(3)]), draw.choice([None, "", "a", "src/Ord.ts", f"src/{text(1)}/f{k}.ts"]), "class", "ts", text(40)) for k in range(n)]
    return rows + [(1000, 1, "file", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(drawn(), DOC).repartition(3)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return s.SearchIndex.write(docs, str(tmp_path_factory.mktemp("index")))


def slow(docs, raw):
    """Signals of every document by a scan."""
    names = [n for n, _ in s.SIGNALS]
    return {r["id"]: tuple(r[n] for n in names) for r in s.exact_signals(docs, raw).collect()}


@pytest.mark.parametrize("raw", ["Find", "src/Ord.ts", "s", "rc", "/ord.TS", "%", "İ", "", "src/ord.tsx"])
def test_candidates_equal_a_scan(docs, index, raw):
    names = [n for n, _ in s.SIGNALS]
    found = {r["id"]: r for r in s.candidates(index, raw).collect()}
    lexical = {r["id"] for r in s.lookup(index.postings, s.query_terms(raw)).collect()} if s.query_terms(raw) else set()
    want = {i: flags for i, flags in slow(docs, raw).items() if any(flags) or i in lexical}
    assert {i: tuple(r[n] for n in names) for i, r in found.items()} == want
    assert {i for i, r in found.items() if r["lexical"]} == lexical
    assert {r["id"] for r in s.candidates(docs, raw).collect()} == set(want)  # without a written index


def test_filters_of_lookups_reach_the_scans(index):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [/or,ord])]" in plan(s.with_needle(index.grams, "/ord")) or "In(gram" in plan(s.with_needle(index.grams, "/ord"))
    assert "StringStartsWith(gram,/o)" in plan(s.with_needle(index.grams, "/o"))
    assert "StringStartsWith(key,ord)" in plan(s.key_signals(index.keys, "ord"))
    page = plan(s.page(s.candidates(index, "order"), s.page_order()))
    assert "Python" not in page and "content" not in page


def test_a_written_index_is_that_of_its_documents(docs, index):
    flat = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert flat(s.postings(docs)) == flat(index.postings) and flat(s.keys(docs)) == flat(index.keys) and flat(s.grams(docs)) == flat(index.grams)
    slow_postings = docs.select("id", F.explode(s.weighted_terms()).alias("x")).groupBy("id", "x.term").agg(*[F.count_if(F.col("x.weight") == c) for c in "ABC"], F.array_sort(F.collect_list("x.position")))
    want = sorted(tuple(r) for r in slow_postings.collect())
    got = index.postings.select("id", "term", "n_a", "n_b", "n_c", F.transform("positions", lambda x: x["position"]).alias("p"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_covers_as_an_expression(spark):
    draw = random.Random(5)
    rows, want = [], {}
    for k in range(400):
        n = draw.randint(2, 4)
        places = sorted(draw.sample(range(1, 60), draw.randint(1, 30)))
        hits = [(p, draw.randint(1, n), draw.choice([1.0, 0.4, 0.2])) for p in places]
        rows.append((k, n, hits))
        want[k] = covers([(p, str(t), w) for p, t, w in hits], {str(t) for t in range(1, n + 1)})
    df = spark.createDataFrame(rows, "id long, n int, hits array<struct<position:int,term:int,weight:double>>")
    got = {}
    for n in (2, 3, 4):
        got |= {r["id"]: r["r"] for r in df.filter(F.col("n") == n).select("id", covered(F.col("hits"), n).alias("r")).collect()}
    assert got == want and len(set(want.values())) > 50


def test_rank_of_several_terms(docs):
    own = {}
    for r in s.postings(docs).collect():
        own.setdefault(r["id"], {})[r["term"]] = [(x["position"], r["term"], WEIGHTS[x["weight"]]) for x in r["positions"]]
    wanted = {"order", "find", "paid"}
    want = {}
    for i, terms in own.items():
        if wanted <= set(terms):
            total = covers(sorted(p for t in wanted for p in terms[t]), wanted)
            want[i] = 50 * total / (total + 1)
    ranked = rank(s.postings(docs), ["paid", "order", "find"])
    assert {r["id"]: r["rank"] for r in ranked.collect()} == want and want
    assert "Python" not in ranked.select("rank")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_neighbours_of_all_kinds_are_one_join(spark):
    docs = spark.createDataFrame(
        [(1, "symbol", 10, 5, 50, None), (2, "symbol", 11, 5, 50, None), (3, "file", None, 5, 50, None), (4, "file", None, 6, None, None), (5, "knowledge_node", None, None, None, 7), (6, "knowledge_node", None, None, None, 8), (7, "symbol", None, 5, 50, None)],
        "id long, source_type string, code_symbol_id long, indexed_file_id long, file_hash_id long, knowledge_node_id long",
    )
    seeds = docs.filter("id in (1, 3, 5)").select(F.col("id").alias("seed_id"), F.col("id").alias("seed_order"), "code_symbol_id", "indexed_file_id", "file_hash_id", "knowledge_node_id")
    deps = spark.createDataFrame(
        [(100, "import", 10, 5, 50, 11, 6, 60), (101, "import", None, 5, 50, None, 5, 50), (102, "extends", 11, 5, 50, 10, None, None), (103, "import", 10, 5, 50, 10, None, None), (104, "import", 10, 9, None, None, None, None)],
        "id long, kind string, source_symbol_id long, source_indexed_file_id long, source_file_hash_id long, target_symbol_id long, target_indexed_file_id long, target_file_hash_id long",
    )
    edges = spark.createDataFrame([(200, "calls", 7, 8), (201, "calls", 8, 7), (202, "calls", 7, 7)], "id long, kind string, source_node_id long, target_node_id long")
    got = {(r["seed_id"], r["document_id"], r["relationship_id"], r["direction"]) for r in s.relations(seeds, deps, edges, docs).collect()}
    # a dependency leads to its symbol, or else to the file; a symbol that isn't a file's document has no part in file keys
    assert got == {(1, 2, 100, "outgoing"), (1, 2, 102, "incoming"), (5, 6, 200, "outgoing"), (5, 6, 201, "incoming"), (3, 2, 100, "outgoing"), (3, 1, 102, "outgoing"), (3, 1, 103, "outgoing")}
    text = s.relations(seeds, deps, edges, docs)._jdf.queryExecution().executedPlan().toString()
    assert text.count("BroadcastHashJoin") + text.count("SortMergeJoin") + text.count("ShuffledHashJoin") <= 3


def test_segments_equal_an_index_of_all(spark, tmp_path):
    rows = drawn()
    docs = lambda own: spark.createDataFrame(own, DOC).repartition(2)
    index = s.SegmentedIndex(spark, str(tmp_path / "segments"))
    with pytest.raises(ValueError, match="no segment"):
        index.read()
    assert index.upsert(docs(rows)) == 0
    held = {r[0]: r for r in rows}
    again = [(k, 1, "file", "Order", f"again {n}", f"again/{k}", "class", "ts", "order paid") for n in (1, 2) for k in range(0, 40, 5)]
    for n in (1, 2):
        own = [r for r in again if r[4] == f"again {n}"] + [(2000 + n, 1, "file", None, None, "src/Ord.ts", None, None, "find")]
        gone = [7 + n, 11 + n]
        assert index.upsert(docs(own), spark.createDataFrame([(g,) for g in gone], "id long")) == n
        held |= {r[0]: r for r in own}
        for g in gone:
            del held[g]
    whole = s.SearchIndex.of(docs(list(held.values())))
    flat = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    merged = index.merge(str(tmp_path / "merged"))
    for own in (index.read(), merged.read()):
        for name in s.TABLES:
            assert flat(getattr(own, name)) == flat(getattr(whole, name))
    ids = lambda own, raw: {(r["id"], r["score"]) for r in s.candidates(own, raw).collect()}
    assert ids(index.read(), "again") == ids(whole, "again") and merged.segments() == [0]
    assert "StringStartsWith(key,again)" in s.key_signals(index.read().keys, "again")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("raw", ["order", "paid", "Find", "nothing", "order find", ""])
@pytest.mark.parametrize(("number", "limit"), [(2, 3), (3, 40)])
def test_pages_by_bounds_equal_pages_of_all(index, raw, number, limit):
    flat = lambda df: [(r["id"], r["score"], r["lexical"]) for r in df.collect()]
    assert flat(s.first_page(index, raw, number, limit)) == flat(s.page(s.candidates(index, raw), s.page_order(), number, limit))


def test_a_bound_reaches_the_scan_of_impacts(spark, tmp_path):
    rows = [(k, 1, "file", f"n{k}", f"t{k}", f"p{k}", "class", "ts", "the " * (1 + k % 50) + "end") for k in range(1_000)]
    own = s.SearchIndex.write(spark.createDataFrame(rows, DOC).repartition(2), str(tmp_path / "index"))
    got = s.first_page(own, "the", 1, 10)
    assert [r["id"] for r in got.collect()] == [r["id"] for r in s.page(s.candidates(own, "the"), s.page_order(), 1, 10).collect()]
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(impact," in text
    assert {r["nth"] for r in own.tops.filter("term = 'the'").collect()} == {1 << k for k in range(10)}
    assert {r["impact"] for r in own.tops.filter("term = 'the' and nth = 16").collect()} == {50 * 0.2}
