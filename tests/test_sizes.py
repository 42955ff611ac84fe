"""Steps whose work must grow no faster than their input: against brute force, and by the rows that their joins make."""

import random

from cairn.operators import ingest


def _nodes(node):
    yield node
    for k in range(node.children().size()):
        yield from _nodes(node.children().apply(k))


def joined_rows(spark, df) -> tuple[list, int]:
    """Rows of df, and how many rows all of its joins make."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        return rows, sum(n.metrics().get("numOutputRows").get().value() for n in _nodes(plan) if "Join" in n.nodeName())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def _ranges(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        low = rng.randrange(-40, 300)
        rows.append((k, rng.choice([1, 1, 2, None]), rng.choice(["Brand#1", "Brand#22", "Bra", "", "Other.x"]) + rng.choice(["", ".y"]), low, low + rng.choice([-7, 0, 1, 5, 64, 127, 300])))
    return rows, spark.createDataFrame(rows, "id long, indexed_file_id long, qualified_name string, start_offset long, end_offset long")


def test_narrowest_ranges_equal_brute_force(spark):
    rows, ranges = _ranges(spark, 150, 1)
    points = [(k, 1 + k % 3, k // 3 - 50) for k in range(1500)] + [(2000, None, 3), (2001, 1, None)]
    got = {r["id"]: r["range_id"] for r in ingest.smallest_enclosing(spark.createDataFrame(points, "id long, file_id long, at_offset long"), ranges).collect()}
    around = lambda f, at: [(e - s, i) for i, g, _, s, e in rows if f is not None and at is not None and g == f and s <= at <= e]
    assert got == {i: min(around(f, at), default=(None, None))[1] for i, f, at in points}


def test_a_file_of_many_ranges_makes_few_rows_for_each_place(spark):
    n = 1500
    ranges = spark.createDataFrame([(k, 1, k, 2 * n - k) for k in range(n)], "id long, indexed_file_id long, start_offset long, end_offset long")
    points = spark.createDataFrame([(k, 1, k) for k in range(n)], "id long, file_id long, at_offset long")
    rows, made = joined_rows(spark, ingest.smallest_enclosing(points, ranges))
    assert {r["id"]: r["range_id"] for r in rows} == {k: k for k in range(n)}
    # each range is around half of the places
    assert made < 30 * n


def test_members_equal_brute_force(spark):
    rows, symbols = _ranges(spark, 220, 2)
    got = sorted((r["component"], r["method"]) for r in ingest.members(symbols, 6).collect())
    want = [(c[0], m[0]) for c in rows for m in rows if c[1] is not None and c[1] == m[1] and c[0] != m[0] and m[3] >= c[3] and m[4] <= c[4] and m[2].startswith(c[2][:6])]
    assert got == sorted(want) and want


def test_classes_of_a_file_meet_by_where_they_lie(spark, data):
    from cairn.plans import QUERIES

    df = QUERIES["join_members"](spark, data)
    df.collect()
    assert "block_" in df._jdf.queryExecution().executedPlan().toString()


def test_symbols_of_one_name_make_no_row_for_each_reference(spark):
    n = 400
    symbols = spark.createDataFrame([(k, 1, "a", f"Q{k}.a", False, k == 3) for k in range(n)], "id long, indexed_file_id long, name string, qualified_name string, exported boolean, default_export boolean")
    names = ["a", "default", "*", "", None, "b", "x.default"]
    refs = spark.createDataFrame([(k, 1, f"Q{k}.a" if k % 2 else names[k // 2 % len(names)]) for k in range(n)], "id long, file_id long, target_name string")
    rows, made = joined_rows(spark, ingest.resolved_symbols(refs, symbols))
    want = {k: k if k % 2 else 3 if names[k // 2 % len(names)] == "default" else None for k in range(n)}
    assert {r["id"]: r["target_symbol_id"] for r in rows} == want and len(rows) == n
    assert made < 10 * n


def test_reading_sources_is_dealt_over_tasks(spark):
    from cairn.sources.typescript import parsed

    files = spark.createDataFrame([(k, f"p{k}.ts", f"export class C{k} {{}}") for k in range(64)], "id long, path string, text string").coalesce(1)
    read = parsed(files, only=["symbols"], keep=["path"])
    assert read.columns == ["id", "symbols", "path"] and read.rdd.getNumPartitions() > 4
    assert sorted((r["id"], r["path"], r["symbols"][0]["name"]) for r in read.collect()) == [(k, f"p{k}.ts", f"C{k}") for k in range(64)]


def test_facts_of_states_are_never_held_by_the_driver(spark, data):
    from cairn.plans import QUERIES

    plan = QUERIES["ana_state"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_budget_counts_keys_as_its_sql(spark, tmp_path):
    import duckdb

    from cairn.plans import ORACLE, QUERIES

    con, cases = duckdb.connect(), {
        "halves": [(1, 999999.0), (2, 0.5), (3, 0.5), (4, 1.5), (5, 7.0)],
        "repeated": [(1, 400000.0), (2, 400000.0), (2, 400000.0), (2, 1.0), (3, 5.0)],
        "falling": [(1, 900000.0), (2, 200000.0), (3, -500000.0), (90000, 900000.0)],
        "without": [(None, 2.0), (1, 999999.0), (2, None), (None, 3.0)],
        "below": [(1, 5.0)],
    }
    for name, rows in cases.items():
        (tmp_path / name).mkdir()
        path = f"{tmp_path}/{name}/orders.parquet"
        con.execute(f"COPY (SELECT a::BIGINT AS o_orderkey, b::DOUBLE AS o_totalprice FROM (VALUES {', '.join(str(r).replace('None', 'NULL') for r in rows)}) v(a, b)) TO '{path}' (FORMAT parquet)")
        con.execute(f"CREATE OR REPLACE VIEW orders AS SELECT * FROM read_parquet('{path}')")
        assert [tuple(r) for r in QUERIES["agg_budget"](spark, f"{tmp_path}/{name}").collect()] == con.execute(ORACLE["agg_budget"]).fetchall(), name


def test_terms_of_an_index_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    from cairn.operators import search

    docs, seen, made = spark.createDataFrame([(k, 1, f"n{k}", "title", f"alpha t{k}", f"p/{k}.ts", "ts", "class") for k in range(40)], "id long, search_index_id long, name string, title string, content string, path string, language string, kind string").coalesce(1), [], search.postings
    monkeypatch.setattr(search, "postings", lambda d: seen.append(d.rdd.getNumPartitions()) or made(d))
    index = search.SearchIndex.write(docs, str(tmp_path / "index"))
    assert seen[0] > 4 and index.postings.filter("term = 'alpha'").count() == 40


def test_a_lookup_writes_the_tables_of_an_index_that_it_asks_for(spark, data, tmp_path):
    import os

    from cairn.operators import search
    from cairn.plans.registry import Tables

    assert not isinstance(Tables(spark, data).search_index, search.SearchIndex)
    docs = spark.createDataFrame([(k, 1, "file", f"n{k}", "the title", f"alpha t{k}", f"p/{k}.ts", "ts", "class") for k in range(40)], "id long, search_index_id long, source_type string, name string, title string, content string, path string, language string, kind string")
    index = search.IndexOnDemand(docs, str(tmp_path / "index"))
    assert search.key_signals(index.keys, "the").count() == 40 and sorted(os.listdir(tmp_path / "index")) == ["heads", "keys"]
    assert [r["id"] for r in search.first_page(index, "t7").collect()] == [7] and set(os.listdir(tmp_path / "index")) == set(search.WHOLE)


def test_tops_are_rows_of_different_impacts(spark):
    from cairn.operators import search

    rows = [(1, "the", [0.2, 0.2, 1.4, 0.6][k % 4], k) for k in range(1_000)] + [(1, "rare", 0.2, 5), (2, "the", 1.0, 6)]
    table = spark.createDataFrame(rows, "search_index_id long, term string, impact double, id long")
    want, by = set(), {}
    for scope, term, weight, _ in rows:
        by.setdefault((scope, term), []).append(weight)
    for key, weights in by.items():
        weights.sort(reverse=True)
        want |= {(*key, 1 << k, weights[(1 << k) - 1]) for k in range(len(weights).bit_length())}
    assert {tuple(r) for r in search.tops(table).collect()} == want


def test_terms_of_a_batch_are_made_a_few_documents_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from cairn.operators import search

    monkeypatch.setattr(search, "CUT_BYTES", 100)
    texts = ["x" * n for n in (250, 0, 40, 40, 40, 5, 300, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"search_index_id": [1] * 9, "id": list(range(9)), "A": texts, "B": [""] * 9, "C": pa.nulls(9, pa.string())})
    parts = list(search._cut(batch))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict() and len(parts) == 3
    assert all(sum(len(x or "") for x in p.column(2).to_pylist()[1:]) < 100 for p in parts) and not list(search._cut(batch.slice(0, 0)))


def _shuffled(spark) -> int:
    """Bytes of shuffle files on the disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))


def test_a_stored_table_leaves_nothing_that_was_shuffled_for_it(spark):
    import time

    from pyspark.sql import functions as F

    from cairn.sources.store import stored

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key, None), _shuffled(spark)
    rows = spark.range(300_000).withColumn("k", F.xxhash64("id"))
    table = stored(rows.groupBy("k").agg(F.max("id").alias("id")), "grouped")
    for _ in range(50):
        if _shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffled(spark) <= before and spark.conf.get(key, None) == was and table.count() == 300_000


def test_only_calls_of_routes_are_resolved_for_workflows(spark, data, monkeypatch):
    from cairn.operators import calls as c
    from cairn.plans import QUERIES
    from cairn.plans.registry import Tables

    asked, resolve = [], c.resolved_calls
    monkeypatch.setattr(c, "resolved_calls", lambda calls, *rest: asked.append(calls) or resolve(calls, *rest))
    made = QUERIES["wf_build"](spark, data).filter("kind = 'workflow'")
    t = Tables(spark, data)
    routes = {r["target"] for r in made.select("target").collect()}
    want = {r["id"] for r in t.code_calls.select("id", "symbol_id").collect() if r["symbol_id"] in routes}
    assert {r["id"] for r in asked[0].select("id").collect()} == want and 0 < len(want) < t.code_calls.count()


def test_facts_of_workflows_meet_their_state_once(spark):
    from cairn.operators import knowledge as kn

    rows = [("workflow", "w", "w", "w", None, None, "c1", 2, 1, 0, 9), ("workflow_step", "w0", "e", "w", 0, "entrypoint", "c1", None, 1, 0, 9), ("workflow_step", "w1", "s", "w", 1, "resolved_call", "c1", None, 1, 3, 5)]
    rows += [("workflow", "x", "x", None, None, None, "c1", 1, 1, 0, 9), ("workflow_step", "y", "y", None, 0, "entrypoint", "c1", None, 1, 0, 9), ("workflow_step", "z", "z", "gone", 0, "entrypoint", "c1", None, 1, 0, 9)]
    facts = spark.createDataFrame(rows, "kind string, identity_key string, name string, workflow_key string, step int, step_type string, component_key string, steps long, file_id long, start_offset long, end_offset long")
    p = kn.workflows(facts, spark.createDataFrame([("c1",)], "identity_key string"))
    assert {tuple(r) for r in p.violations.collect()} == {("invalid_steps", None), ("orphan_step", None), ("orphan_step", "gone")}
    assert sorted((r["kind"], r["source_key"], r["target_key"], r["evidence"]) for r in p.edges.collect()) == [("calls", "w1", "c1", 1), ("contains", "c1", "w", 1), ("contains", "w", "w0", 1), ("contains", "w", "w1", 1), ("precedes", "w0", "w1", 2)]
    # the one join is that of steps and the steps after them
    assert sum("Join" in n.nodeName() for n in _nodes(p.edges._jdf.queryExecution().sparkPlan())) == 1


def test_tables_that_a_graph_of_workflows_no_longer_reads_are_deleted(spark, data, monkeypatch):
    import os

    from cairn.plans import QUERIES
    from cairn.sources import store

    made, fresh = {}, store.scratch
    monkeypatch.setattr(store, "scratch", lambda spark, name: made.setdefault(name, fresh(spark, name)))
    rows = QUERIES["kg_workflow"](spark, data)
    assert {name for name, path in made.items() if os.path.exists(path)} == {"workflows", "states", "marked"} and len(made) > 6 and rows.count() > 0
