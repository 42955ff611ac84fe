"""The quality model against slow loops, and near-duplicate links against all pairs of a driver's table."""

import itertools
import math

import numpy as np
import pytest

from cairn.llm import near_dedup as nd
from cairn.llm import quality as q


def gain(g, h):
    return g * g / (h + q.RIDGE)


def best_cut(g, h):
    best, at = 0.0, 0
    for k in range(1, len(g)):
        left, right = (sum(g[:k]), sum(h[:k])), (sum(g[k:]), sum(h[k:]))
        if left[1] >= q.LEAF and right[1] >= q.LEAF:
            own = gain(*left) + gain(*right) - gain(sum(g), sum(h))
            if own > best + 1e-12:
                best, at = own, k
    return best, at


def tree(g, h, depth=2):
    best, at = best_cut(g, h) if depth else (0.0, 0)
    if best <= 0:
        return [sum(g) / (sum(h) + q.RIDGE)] * len(g)
    return tree(g[:at], h[:at], depth - 1) + tree(g[at:], h[at:], depth - 1)


def pair_tree(g, h):
    """g and h: lists of rows. The better of cutting rows first or columns first."""
    flat = lambda x: sum(map(sum, x))
    turned = lambda x: [list(r) for r in zip(*x, strict=True)]
    best, value = 0.0, [[flat(g) / (flat(h) + q.RIDGE)] * len(g[0]) for _ in g]
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (turned(g), turned(h))
        at = best_cut([sum(r) for r in a], [sum(r) for r in b])[1] or len(a) // 2
        total, rows = -gain(flat(g), flat(h)), []
        for part in (slice(0, at), slice(at, None)):
            gs, hs = ([sum(c) for c in zip(*x[part], strict=True)] if x[part] else [0.0] * len(x[0]) for x in (a, b))
            total += best_cut(gs, hs)[0] + gain(sum(gs), sum(hs))
            rows += [tree(gs, hs, 1)] * len(a[part])
        if total > best + 1e-12:
            best, value = total, rows if axis == 0 else turned(rows)
    return best, value


def bin_of(cuts, v):
    return sum(c <= v for c in cuts)


def slow_fit(x, y):
    """Cyclic boosting row by row: score of each row."""
    n, k = x.shape
    fine, coarse = ([q._cuts(x[:, f], b).tolist() for f in range(k)] for b in (q.BINS, q.PAIR_BINS))
    base = math.log(y.mean() / (1 - y.mean()))
    tables = [[0.0] * (len(c) + 1) for c in fine]
    pairs, pair_tables = [], []

    def total(r):
        own = base + sum(tables[f][bin_of(fine[f], r[f])] for f in range(k))
        return own + sum(t[bin_of(coarse[i], r[i])][bin_of(coarse[j], r[j])] for (i, j), t in zip(pairs, pair_tables, strict=True))

    def slopes():
        p = [1 / (1 + math.exp(-total(r))) for r in x]
        return [v - s for v, s in zip(y, p, strict=True)], [max(s * (1 - s), 1e-6) for s in p]

    def grid(i, j, v):
        out = [[0.0] * (len(coarse[j]) + 1) for _ in range(len(coarse[i]) + 1)]
        for r, s in zip(x, v, strict=True):
            out[bin_of(coarse[i], r[i])][bin_of(coarse[j], r[j])] += s
        return out

    for _ in range(q.ROUNDS):
        for f in range(k):
            sums = [[0.0] * len(tables[f]) for _ in range(2)]
            for r, *gh in zip(x, *slopes(), strict=True):
                for s, v in zip(sums, gh, strict=True):
                    s[bin_of(fine[f], r[f])] += v
            for b, v in enumerate(tree(*sums)):
                tables[f][b] += q.RATE * v
    g, h = slopes()
    ranked = sorted(((pair_tree(grid(i, j, g), grid(i, j, h))[0], -i, -j) for i, j in itertools.combinations(range(k), 2)), reverse=True)
    pairs += [(-i, -j) for _, i, j in ranked[: q.PAIRS]]
    pair_tables += [[[0.0] * (len(coarse[j]) + 1) for _ in range(len(coarse[i]) + 1)] for i, j in pairs]
    for _ in range(q.PAIR_ROUNDS):
        for t, (i, j) in enumerate(pairs):
            g, h = slopes()
            for a, row in enumerate(pair_tree(grid(i, j, g), grid(i, j, h))[1]):
                for b, v in enumerate(row):
                    pair_tables[t][a][b] += q.RATE * v
    return [1 / (1 + math.exp(-total(r))) for r in x]


def test_model_equals_boosting_row_by_row(monkeypatch):
    for name, value in (("BINS", 7), ("PAIR_BINS", 4), ("PAIRS", 2), ("ROUNDS", 3), ("PAIR_ROUNDS", 3), ("LEAF", 1.0)):
        monkeypatch.setattr(q, name, value)
    rng = np.random.default_rng(3)
    x = np.round(rng.random((90, 3)), 3)
    y = (((x[:, 0] > 0.4) ^ (x[:, 2] > 0.6)) | (rng.random(90) < 0.1)).astype(float)
    model = q.fit(x, y)
    assert model.score(x) == pytest.approx(slow_fit(x, y), abs=1e-9)


def test_links_against_all_pairs_of_a_table(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if 100 * len(sets[i]) < 75 * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
                low, high = sorted((find(i), find(j)))
                root[high] = low
    got = {r["doc_id"]: r for r in nd.near_dedup(docs).collect()}
    recall = sum(got[i]["component_id"] == got[j]["component_id"] for i, j in links) / len(links)
    print(f"recall of {len(links)} links: {recall:.6f}")
    assert recall == 1.0 and {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in sets}
    assert all(r["n_shingles"] == len(sets[i]) for i, r in got.items())


def slow_features(text):
    """Each feature by itself, character by character."""
    import math
    import zlib
    from collections import Counter
    from itertools import groupby

    from cairn.llm import quality as q

    words = [w for w in text.replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w]
    out = dict.fromkeys(q.FEATURES, 0.0) | {"log_bytes": math.log1p(len(text))}
    if not words:
        return list(out.values())
    n, solid = len(words), sum(len(w) for w in words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = lambda ok: sum(1 for b in text if ok(b)) / solid
    runs = [(b, sum(1 for _ in g)) for b, g in groupby(text)]
    ends, inside = 0, False
    for b in text:
        ends += b in b".!?" and not inside
        inside = b in b".!?"
    pairs = {(a, b) for a, b in zip(words, words[1:])}
    mean = solid / n
    upper = lambda w: any(65 <= b <= 90 for b in w) and not any(97 <= b <= 122 for b in w)
    out |= {
        "log_words": math.log1p(n), "mean_word": mean, "long_words": sum(len(w) > 12 for w in words) / n, "short_words": sum(len(w) <= 2 for w in words) / n, "distinct_words": len(set(words)) / n, "top_word": max(Counter(words).values()) / n,
        "repeated_pairs": 1 - len(pairs) / max(1, n - 1), "lines": math.log1p(len(lines)), "words_a_line": n / max(1, len(lines)), "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "sentences": ends / n,
        "upper": count(lambda b: 65 <= b <= 90), "lower": count(lambda b: 97 <= b <= 122), "digits": count(lambda b: 48 <= b <= 57), "marks": count(lambda b: b in b"#$%&*@^~|<>{}[]=_+\\/"), "punctuation": count(lambda b: b in b".,;:!?'\"-()"), "beyond_ascii": count(lambda b: b > 127),
        "exclamations": text.count(b"!") / n, "bars": text.count(b"|") / n, "capital_words": sum(65 <= w[0] <= 90 for w in words) / n, "upper_words": sum(upper(w) for w in words) / n, "number_words": sum(all(48 <= b <= 57 for b in w) for w in words) / n,
        "runs": sum(k > 2 for _, k in runs) / n, "compression": len(zlib.compress(text, 1)) / len(text), "word_spread": math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n),
    }
    return [out[f] for f in q.FEATURES]


def test_features_equal_slow_ones():
    import random

    from cairn.llm import quality as q

    draw = random.Random(2)
    alphabet = "aab  cXY Z019.!?,;'|#é日\n\n\t\r\x0b-(){}"
    texts = ["", " ", "\n\t", "A", "A1", "!!!", "aaa bbb aaa", "Das ist ÉCOLE. Ja?!", "x" * 5000] + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 400))) for _ in range(300)]
    for t in texts:
        assert q.features(t.encode()) == pytest.approx(slow_features(t.encode()), abs=1e-9), t
