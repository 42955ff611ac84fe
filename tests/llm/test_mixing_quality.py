import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cairn.llm import mixing as mx
from cairn.llm import quality as q
from cairn.llm.packing import CapacityTree, Plan, best_fit_plan


def brute_targets(sizes, weights=mx.WEIGHTS, total=mx.TOTAL, most=mx.MOST):
    """Share by weight, stop those above, share the excess again, until none is above."""
    want, out, weight = total * sum(sizes), [0.0] * len(sizes), [weights[k % len(weights)] for k in range(len(sizes))]
    open_ = set(range(len(sizes)))
    while open_:
        share = want / sum(weight[k] for k in open_)
        above = {k for k in open_ if share * weight[k] > most * sizes[k]}
        for k in above or open_:
            out[k] = most * sizes[k] if above else share * weight[k]
            want -= out[k]
        open_ -= above or open_
    return out


def test_brute_targets_by_hand():
    assert brute_targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])  # 450 by 5, 2, 1; the first stops at 200
    assert brute_targets([0, 0]) == [0, 0] and brute_targets([]) == []


@pytest.mark.parametrize("range_rows", [100_000, 7])
def test_targets(spark, monkeypatch, range_rows):
    from cairn.llm import common

    monkeypatch.setattr(common.summed_before, "__defaults__", (range_rows,))
    rng = np.random.default_rng(8)
    for sizes in ([5], [0, 0], [10, 0, 90, 7], rng.integers(0, 1000, 40).tolist(), (10.0 ** rng.uniform(0, 6, 60)).astype(int).tolist()):
        names = [f"s{k:03d}" for k in range(len(sizes) - 1)] + [None]
        own = spark.createDataFrame(list(zip(names, sizes, strict=True))[::-1], "source string, size long").repartition(3)
        got = sorted((r["k"], r["source"], r["size"], r["target"]) for r in mx.weighed(own).collect())
        assert [r[:3] for r in got] == [(k, n, s) for k, (n, s) in enumerate(zip(names, sizes, strict=True))]
        assert [r[3] for r in got] == pytest.approx(brute_targets(sizes))
    assert mx.weighed(spark.createDataFrame([], "source string, size long")).count() == 0


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        got = mx.permute(np.arange(n), np.full(n, n), np.full(n, 9, dtype=np.uint64))
        assert sorted(got) == list(range(n))


def test_shard_counts_are_multinomial():
    draw = lambda n, shards, seed: mx.shard_counts(n, shards, np.random.default_rng(seed))
    for n, shards in ((1000, 7), (5, 1000), (1, 1)):
        at, counts = draw(n, shards, [1, 2, 3])
        assert counts.sum() == n and counts.min() > 0 and len(set(at)) == len(at) and at.max() < shards
        assert [x.tolist() for x in draw(n, shards, [1, 2, 3])] == [at.tolist(), counts.tolist()]
    own = np.zeros((400, 8))
    for k in range(400):
        at, counts = draw(800, 8, [k])
        own[k, at] = counts
    # mean n / shards, variance n p (1 - p)
    assert np.allclose(own.mean(axis=0), 100, atol=2) and np.allclose(own.var(axis=0), 87.5, rtol=0.3)


def brute_permuted(j, n, seed):
    """The permutation's value at j by plain integers: Feistel rounds until inside."""
    mask64 = (1 << 64) - 1

    def mix(x, s):
        x = (x + s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & mask64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask64
        return x ^ x >> 31

    half = max(1, -(-(max(n, 2) - 1).bit_length() // 2))
    while True:
        left, right = j >> half, j & (1 << half) - 1
        for k in range(4):
            left, right = right, left ^ mix(right ^ mix(seed, 5), k) & (1 << half) - 1
        j = left << half | right
        if j < n:
            return j


def test_mix_against_brute_force(spark):
    """Each source's slots one by one: block by the permutation of its round, words of the block in the source's order."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{x}" for x in range(rng.integers(0, 200))), f"s{min(rng.integers(0, 9), rng.integers(0, 9))}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mix = mx.Mix(docs, shard_slots=16)
    own = defaultdict(list)
    for r in mix.documents.collect():
        own[r["k"]].append((r["start"], r["size"], r["doc_id"]))
    size = {k: sum(n for _, n, _ in x) for k, x in own.items()}
    want, taken, slots = brute_targets([size[k] for k in sorted(size)]), defaultdict(int), defaultdict(int)
    for k, docs_ in own.items():
        end, words = 0, []
        for start, n, i in sorted(docs_):
            assert start == end
            end += n
            words += [i] * n
        blocks = -(-end // 32)
        rounds, rest = divmod(want[k], end)
        for j in range(min(int(rounds) * blocks + round(rest * blocks / end), 2 * blocks)):
            seed = int(mx.mix64(np.array([j // blocks * 1009 + k]), 17)[0])
            at = brute_permuted(j % blocks, blocks, seed)
            slots[k, at, j // blocks] += 1
            for i in words[at * 32 : at * 32 + 32]:
                taken[i] += 1
    assert slots and {(r["k"], r["block"], r["round"]): 1 for r in mix.slots().collect()} == slots
    assert 1 < len({r["shard"] for r in mix.slots().collect()}) <= mix.shards
    assert {r["doc_id"]: r["taken"] for r in mx.mix_sources(docs, shard_slots=16).collect()} == {i: taken[i] for i, *_ in rows}


def test_mix_of_many_sources_takes_either_way(spark):
    rows = [(k, f"a{k} b c d e f g h", None if k % 50 == 0 else f"s{k % 50:03d}") for k in range(2000)] + [(9000, "x " * 3000, "s001")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    ways = [sorted(tuple(r) for r in mx.mix_sources(docs, broadcast_sources=n).collect()) for n in (200_000, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 2001


def test_mix(spark, docs, rows, empty):
    got = [r.asDict() for r in mx.mix_sources(docs).collect()]
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s) + [None]
    want = dict(zip(names, brute_targets([size[s] for s in names]), strict=True))
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * mx.BLOCK_WORDS for s in names)
    again = [r.asDict() for r in mx.mix_sources(docs.repartition(7)).collect()]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mx.mix_sources(empty).count() == 0


def test_mixed_documents_hold_the_taken_words(docs, rows, empty):
    taken, words = defaultdict(int), {}
    for i, t, _ in rows:
        words[i] = set((t or "").encode().split())
    for r in mx.mix_sources(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    got = defaultdict(int)
    for r in mx.mixed_documents(docs).collect():
        own = r["text"].encode().split()
        assert set(own) <= words[r["doc_id"]] and r["lang"] == "en"
        got[r["doc_id"]] += len(own)
    assert got == {i: n for i, n in taken.items() if n}
    assert mx.mixed_documents(empty).count() == 0


def brute_best_fit(lengths, window):
    open_, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, left in enumerate(open_) if left >= n]
        if fits:
            k = min(fits, key=lambda k: open_[k])
            open_[k] -= n
        else:
            open_.append(window - n)
        out.append(n)
    return sorted(open_)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for window in (7, 50, 2048):
        for _ in range(20):
            lengths = rng.integers(1, window, rng.integers(1, 400)).tolist()
            counts = {n: lengths.count(n) for n in set(lengths)}
            steps, windows = best_fit_plan(counts, window)
            plan, used = Plan(steps), defaultdict(list)
            for n, c in counts.items():
                for k in range(c):
                    w, at = plan.place(n, k)
                    used[w].append((at, n))
            left = []
            for own in used.values():
                end = 0
                for at, n in sorted(own):
                    assert at == end
                    end += n
                left.append(window - end)
            assert sorted(left) == brute_best_fit(lengths, window) and len(used) == windows


def test_capacity_tree():
    tree = CapacityTree(10)
    for k in (3, 7, 10):
        tree.set(k, True)
    assert [tree.tightest(k) for k in range(11)] == [3, 3, 3, 3, 7, 7, 7, 7, 10, 10, 10]
    tree.set(10, False)
    assert tree.tightest(8) == -1


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = q.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_quality_on_held_out_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in q.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    good, bad, right, n = [], [], 0, 0
    for r in labels.collect():
        own = got[r["doc_id"]]
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= own["score"] <= 1 and own["predicted"] == (own["score"] >= 0.3)
        if own["held_out"]:
            (good if r["quality"] else bad).append(own["score"])
            right += own["predicted"] == r["quality"]
            n += 1
    assert right / n > 0.93
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95


def test_quality_of_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (9, 0), (11, 1), (None, 1), (12, 0)], "doc_id long, quality int")
    got = [r.asDict() for r in q.quality_scores(docs, labels).collect()]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    assert q.quality_scores(empty, labels).count() == 0
    assert q.quality_scores(docs, labels.limit(0)).count() == len(rows)
    assert set(q.good_documents(docs, labels.limit(0)).columns) == set(docs.columns)


def test_pipeline_stages(spark, data):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipe.STAGES):
        before, docs = docs, stage(spark, docs, data)
        docs = docs.cache()
        n = docs.count()
        assert n > 0, name
        if k < 4:
            assert docs.columns == columns and n <= before.count()
            assert docs.filter("n_chars <> length(text)").isEmpty()
    assert "sequence_id" in docs.columns


def test_pipeline_of_odd_rows_leaves_no_scratch_behind(spark, docs, empty, tmp_path):
    import corpus_pipeline as pipe
    from cairn.llm.common import _folder

    jvm, folder = spark.sparkContext._jvm, _folder(spark)
    path = jvm.org.apache.hadoop.fs.Path(folder)

    def tables():
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return len(fs.listStatus(path)) if fs.exists(path) else 0

    for name, own in (("odd", docs), ("empty", empty)):
        own.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1), (9, 0), (11, 1), (12, 0), (None, 1), (3, None), (1, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        before = tables()
        got = pipe.run(spark, f"{tmp_path}/{name}").collect()
        # the documents that the last stage reads, and its pieces
        assert tables() <= before + 2
        assert all(r["doc_tokens"] > 1 for r in got) and (name == "odd") == bool(got)


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from cairn.llm import common

    none = SimpleNamespace(isDefined=lambda: False)
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
