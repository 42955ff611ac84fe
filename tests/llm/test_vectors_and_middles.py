import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import hard_negatives as hn
from cairn.llm import vector_search as vs
from cairn.llm import vectors as v
from cairn.llm.common import Scratch
from cairn.llm.fill_middle import fill_digest, fill_in_middle, restored, units
from cairn.llm.oracle import ORACLE
from cairn.llm.queries import QUERIES
from tools.compare import expected, rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string, vector string"


def frame(spark, rows):
    # further columns with names that operators make
    return spark.createDataFrame([(*r, 0.5, "x", "y") for r in rows], SCHEMA).repartition(3)


def taking_part(rows, label=True):
    out = []
    for i, x, k in rows:
        if i is None or x is None or (label and k is None) or any(c is None or not math.isfinite(c) or abs(c) * 256 >= v.LARGEST for c in x):
            continue
        out.append((i, [math.floor(256 * float(np.float32(c))) for c in x], k))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, is_query, k):
    own = taking_part(rows, label=False)
    asked = {}
    for i, x, _ in own:
        if is_query(i):
            asked[i] = min(x, asked.get(i, x))
    out = Counter()
    for i, x in asked.items():
        for r, (less, j) in enumerate(sorted((-dot(x, y), j) for j, y, _ in own if j != i)[:k]):
            out[i, r + 1, j, -less] += 1
    return out


def brute_negatives(rows, is_anchor, k_pos=5, k_neg=10, low=30, high=90):
    own = taking_part(rows)
    asked = {}
    for i, x, k in own:
        if is_anchor(i):
            asked[i] = min((k, x), asked.get(i, (k, x)))
    out = Counter()
    for i, (k, x) in asked.items():
        scored = sorted((-dot(x, y), j, c) for j, y, c in own if j != i)
        for p, j, _ in [s for s in scored if s[2] == k][:k_pos]:
            hit = [s for s in scored if s[2] != k and low * -p <= 100 * -s[0] <= high * -p][:k_neg]
            for r, (s, n, _) in enumerate(hit):
                out[i, j, r + 1, n, -p, -s] += 1
    return out


def drawn(seed, n=300, dim=6, labels=4, hot=0.4, clusters=5):
    """Clustered vectors with ties, one label with many rows, and one vector that many rows have."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = []
    for i in range(n):
        x = centres[0] if rng.random() < hot / 2 else centres[rng.integers(clusters)] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.5])
        rows.append((i, np.round(x, 2).tolist(), 0 if rng.random() < hot else int(rng.integers(labels))))
    return rows


ODD = [
    (1, None, 1), (2, [0.5, None], 1), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 1), (6, [1.0, 1.0], None),
    (7, [1.0], 1), (8, [], 1), (10, [1.0, -1.0], 1), (10, [1.0, -1.0], 1), (10, [0.5, 2.0], 0), (12, [1e30, 0.0], 1), (20, [-1.0, -1.0], 2), (21, [0.0, 0.0], 2), (30, [1.0, 1.0, 1.0], 0), (31, [1.0, 1.0], 0), (32, [1.0, 1.0], 1),
]


def top_rows(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def negative_rows(df):
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"annulus": 16, "block": 4, "pivots": 6}), (3, {"annulus": 7, "block": 100, "pivots": 1})])
def test_top_k_equals_brute_force(spark, seed, options):
    rows = drawn(seed)
    got = vs.top_k_search(frame(spark, rows), frame(spark, rows).filter("vec_id % 10 = 0"), 5, **options)
    assert top_rows(got) == brute_top(rows, lambda i: i % 10 == 0, 5)


def test_top_k_of_odd_rows(spark):
    own = frame(spark, ODD)
    assert top_rows(vs.top_k_search(own, own, 3)) == brute_top(ODD, lambda i: True, 3)
    # more asked than there are; a lone row; no row at all; queries from elsewhere, longer than all rows
    assert top_rows(vs.top_k_search(own, own.filter("vec_id = 20"), 100)) == brute_top(ODD, lambda i: i == 20, 100)
    assert vs.top_k_search(own.filter("vec_id = 20"), own.filter("vec_id = 20")).count() == 0
    none = frame(spark, [])
    assert vs.top_k_search(none, own).count() == 0 and vs.top_k_search(own, none).count() == 0
    got = vs.top_k_search(own.filter("vec_id < 20"), own.filter("vec_id = 30"), 2)
    assert {(r["rank"], r["vec_id"], r["score"]) for r in got.collect()} == {(1, 10, 163840), (2, 6, 131072)}


def test_bounds_leave_far_annuli_out(spark):
    rng = np.random.default_rng(5)
    centres = 40 * rng.normal(size=(8, 4))
    rows = [(i, np.round(centres[i % 8] + rng.normal(size=4), 3).tolist(), 0) for i in range(800)]
    scratch = Scratch(spark)
    own = frame(spark, rows)
    index = vs.PivotIndex(scratch.save(own.select("vec_id", v.scaled(own, "embedding").alias("vector"))), scratch, 16, 20)
    assert index.cells.agg(F.sum("n")).first()[0] == 800
    asked = own.filter("vec_id % 100 = 3").select("vec_id", v.scaled(own, "embedding").alias("vector")).withColumnRenamed("vec_id", "query_id")
    held = {}
    grid = vs.PivotIndex._grid
    try:
        vs.PivotIndex._grid = lambda self, *a: held.setdefault("n", (g := grid(self, *a)).count()) and g
        got = top_rows(index.search(asked, 3, 1))
    finally:
        vs.PivotIndex._grid = grid
    assert got == brute_top(rows, lambda i: i % 100 == 3, 3)
    assert 0 < held["n"] < 0.5 * 8 * index.cells.count()
    scratch.drop()


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"anchor_rows": 3, "tile_rows": 40}), (4, {"k_positives": 2, "k_negatives": 3, "low": 0, "high": 100})])
def test_hard_negatives_equal_brute_force(spark, seed, options):
    rows = drawn(seed)
    got = hn.hard_negatives(frame(spark, rows), frame(spark, rows).filter("vec_id % 7 = 0"), **options)
    want = brute_negatives(rows, lambda i: i % 7 == 0, options.get("k_positives", 5), options.get("k_negatives", 10), options.get("low", 30), options.get("high", 90))
    assert want and negative_rows(got) == want


def test_hard_negatives_of_odd_rows(spark):
    own = frame(spark, ODD)
    assert negative_rows(hn.hard_negatives(own, own)) == brute_negatives(ODD, lambda i: True)
    assert negative_rows(hn.hard_negatives(own, own, low=0, high=100)) == brute_negatives(ODD, lambda i: True, low=0, high=100)
    none = frame(spark, [])
    assert hn.hard_negatives(none, own).count() == 0 and hn.hard_negatives(own, none).count() == 0
    assert hn.hard_negatives(own.filter("label = 1"), own).count() == 0  # no other label


def test_limits_round_towards_less(spark):
    rows = spark.createDataFrame([(x,) for x in (-201, -200, -1, 0, 1, 99, 100, 9_007_199_254_740_993 * 100)], "x long")
    assert [r[0] for r in rows.select(hn.hundredths(rows["x"])).collect()] == [-3, -2, -1, 0, 0, 0, 1, 9_007_199_254_740_993]


def test_products_are_exact():
    big = np.full((2, 64), v.LARGEST - 1, dtype=np.int64)
    assert v.products(big, big)[0, 0] == 64 * (v.LARGEST - 1) ** 2 and v.products(big // 3, big)[1, 1] == 64 * ((v.LARGEST - 1) // 3) * (v.LARGEST - 1)
    assert v.products(np.zeros((0, 3), dtype=np.int64), np.ones((2, 3), dtype=np.int64)).shape == (0, 2)


def brute_middle(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_middles_equal_slices(spark, docs, rows, empty):
    odd = ["<P", "a<S>b", "<M>", "<", "<S<S" * 5, "\\1 $2 {3}+ \\E(?s)", "\r\n \n", "\U0001f600" * 2500, "é" * 999, "\x00\x00", "x" * 1_000, "x" * 1_001, "word " * 400_000]
    more = [(1000 + 37 * k + j, t) for k, t in enumerate(odd) for j in range(5)]
    every = spark.createDataFrame(more, "doc_id long, text string").union(docs.select("doc_id", "text"))
    got = Counter()
    for r in fill_in_middle(every).withColumn("back", restored(F.col("form"), F.col("output"))).collect():
        got[r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]] += 1
    want = Counter((i, *brute_middle(i, t), t or "") for i, t in [*more, *((i, t) for i, t, _ in rows)])
    assert got == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}
    assert fill_digest(fill_in_middle(empty)).count() == 0
    assert "restored_sha256" in fill_digest(fill_in_middle(docs)).columns


def test_units_are_code_points(spark):
    texts = ["", "a", "x" * 999, "\U0001f600\n" * 1_000, "\r\n" * 1_501]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(units(rows["t"])).collect()] == [len(t) for t in texts]


def test_no_python_and_no_shuffle_in_the_middle_query(spark, data):
    plan = QUERIES["op13_fill_in_middle"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_top_k_search", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    assert rows_of(QUERIES[name](spark, data)) == expected(con, ORACLE[name])
