import time
from collections import Counter

import numpy as np
import pytest

from cairn.llm import common
from cairn.llm import exact_dedup as ed
from cairn.llm import quality as q
from cairn.llm.mixing import taken_words
from cairn.llm.near_dedup import one_of_each

A, B, C = (" ".join(f"{w}{k}" for k in range(n)) for w, n in (("alpha", 50), ("beta", 40), ("gamma", 60)))


def kept(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, one__ string").repartition(3)
    out = one_of_each(docs)
    assert out.columns == docs.columns
    return Counter((r["doc_id"], r["text"]) for r in out.collect())


def test_different_texts_of_one_id_all_stay(spark):
    assert kept(spark, [(1, A), (1, B), (2, C)]) == Counter([(1, A), (1, B), (2, C)])


def test_of_copies_under_one_id_the_longest_stays(spark):
    longer = A + " more"
    # near copies of one id, a copy of a text of another id, repeated rows, and rows without an id
    rows = [(1, A), (1, longer), (1, B), (3, B), (2, C), (2, C), (None, A), (None, A), (4, None), (4, "")]
    assert kept(spark, rows) == Counter([(1, longer), (1, B), (2, C), (None, A), (None, A), (4, None), (4, "")])


def test_one_id_in_half_of_all_rows(spark):
    words = [" ".join(f"w{k}x{j}" for j in range(8)) for k in range(300)]
    rows = [(7, t) for t in words] + [(1_000 + k, t) for k, t in enumerate(words)]
    assert kept(spark, rows) == Counter((7, t) for t in words)


@pytest.mark.parametrize(("rows", "repeats"), [(5, 400), (100, 30)])
def test_rows_that_a_model_is_fitted_on_are_bounded(spark, monkeypatch, rows, repeats):
    met = []
    monkeypatch.setattr(q, "fit", lambda x, y: met.append((x, y)))
    docs = spark.createDataFrame([(k, f"text {j} of {k}" * (j % 9)) for k in range(40) for j in range(repeats if k == 3 else 1)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    q.train(docs, labels, rows=rows)
    (x, y), = met
    assert 0 < len(x) == len(y) <= min(rows, 40) and np.array(x).shape[1] == len(q.FEATURES)


def test_taken_words_take_linear_time():
    def took(blocks):
        text = b"word " * (32 * blocks)
        spans = [{"round": r, "from_word": 32 * k, "words": 32} for r in range(2) for k in range(0, blocks, 2)]
        began = time.process_time()
        out = taken_words(text, spans)
        assert out.count(b"word") == 32 * len(spans)
        return time.process_time() - began

    took(1_000)
    assert took(40_000) < 6 * took(20_000) + 0.5 and took(200_000) < 20  # the last makes 32 MB


def test_taken_words_by_hand():
    spans = [{"round": 0, "from_word": 0, "words": 2}, {"round": 0, "from_word": 2, "words": 1}, {"round": 0, "from_word": 4, "words": 1}, {"round": 1, "from_word": 0, "words": 1}]
    assert taken_words(b" a b\tc  d e ", spans) == b"a b c\ne\na" and taken_words(b"", []) == b""


def test_a_digest_of_half_of_all_rows_is_dealt_over_tasks(spark, monkeypatch):
    rows = [(k, None if k % 2 else f"text {k % 20}") for k in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = []
    monkeypatch.setattr(ed, "dealt_join", lambda own, facts, *a, **b: dealt.append(facts.count()) or common.dealt_join(own, facts, *a, **b, share=4, key_rows=8))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in ed.exact_dedup(docs).collect()}
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    assert dealt == [11] and got == {k: (min(g), len(g)) for g in groups.values() for k in g}
