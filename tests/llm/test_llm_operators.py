import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from cairn.llm import exact_dedup as ed
from cairn.llm import fingerprint as fp
from cairn.llm import license_scan as ls
from cairn.llm import line_dedup as ld
from cairn.llm import secret_scan as ss
from cairn.llm.near_dedup import near_dedup, one_of_each
from cairn.llm.packing import pack_documents
from cairn.llm.token_count import token_counts

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = "[\x20\x09-\x0d]"


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_token_counts_equal_the_library(docs, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in collected(token_counts(docs, path)))
    want = Counter()
    for i, t, _ in rows:
        n = len(library.encode(t or ""))
        want[i, len((t or "").encode()), n, n > 4096] += 1
    assert got == want
    assert token_counts(empty, path).count() == 0


def test_long_pre_tokens_equal_the_library_and_cost_little():
    import base64
    import random
    import time

    import sentencepiece

    from cairn.llm.token_count import LONG, PieceBpe

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own, draw = sentencepiece.SentencePieceProcessor(model_file=path), PieceBpe(path), random.Random(4)
    letters = ["ab", "abc0123", "thequickbrownfoxjumpsoverit", "ABCxyz+/=", "日本語é😀a", "aA"]
    texts = []
    for _ in range(400):
        a = draw.choice(letters)
        texts.append("  ".join("".join(draw.choice(a) for _ in range(draw.randint(1, 3 * LONG))) for _ in range(draw.randint(1, 3))) + draw.choice(["", " "]))
    assert own.counts(texts) == [len(library.encode(t)) for t in texts]
    assert own.merged_by_rank(["a", "word", "x" * 7]) == own.merged(["a", "word", "x" * 7])
    for t in (base64.b64encode(draw.randbytes(750_000)).decode(), "x" * 1_000_000, "eyJ" * 300_000):
        began = time.process_time()
        assert own.counts([t]) == [len(library.encode(t))]
        assert time.process_time() - began < 10


def test_packing_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    got = collected(pack_documents(docs, path))
    assert sum(r["length"] for r in got) == sum(len(x) for own in ids.values() for x in own)
    at = defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][0]  # repeated rows are equal
        piece = own[r["start"] : r["start"] + r["length"]]
        assert (r["length"], r["doc_tokens"]) == (len(piece), len(own))
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(at) == max(at) + 1
    assert pack_documents(empty, path).count() == 0


def test_packing_takes_other_tokenizers_whole():
    from tokenizers import Tokenizer

    from cairn.llm.packing import WordIds

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), WordIds(path)
    texts = ["Two words, AND more.", "  spaces   and\n\nlines", "", "日本語 é"]
    assert not own.by_word and WordIds(public_tokenizers.path("word_bpe_49k.json")).by_word
    assert own.encode(texts) == [struct.pack(f"<{len(x)}I", *x) for x in (library.encode(t, add_special_tokens=False).ids for t in texts)]


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), i is None, i))
    want = Counter()
    for i, t, _ in rows:
        key = re.sub(SPACE, "", t or "")
        keep = min(groups[key], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want[i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter(tuple(r.values()) for r in collected(ed.exact_dedup(docs))) == want
    assert ed.exact_dedup(empty).count() == 0
    # a history takes part but gets no rows; nonmembers form their own groups
    new, old = docs.filter("doc_id > 5"), docs.filter("doc_id <= 5")
    got = {r["doc_id"]: r for r in collected(ed.exact_dedup(new, old))}
    assert set(got) == {i for i, _, _ in rows if i is not None and i > 5}
    assert got[6]["group_size"] == 3 and got[6]["keep_id"] == 6  # the longest of the blank ones
    assert got[9]["group_size"] == 1 and got[9]["kept"]


def test_perfect_hash_is_minimal_and_checks_bytes():
    import numpy as np
    import pandas as pd

    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    shard = ed.Shard(pd.DataFrame({"digest": keys}))
    slots = shard.hash.slots(np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, 32))
    assert sorted(slots) == list(range(5000))
    assert list(shard.lookup(pd.Series(keys))) == list(range(5000))
    others = [hashlib.sha256(f"-{k}".encode()).digest() for k in range(2000)]
    assert set(shard.lookup(pd.Series(others))) == {-1}


@pytest.mark.parametrize("broadcast_lines", [1_000_000, 0])
def test_line_dedup(docs, rows, empty, broadcast_lines):
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if x := line.strip(ld.ENDS):
                sites[x].add(s or "")
    bad = {x for x, s in sites.items() if len(s) >= 3}
    assert bad == {"shared line"}
    want = Counter()
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if x.strip(ld.ENDS) not in bad]
        want[i, None if t is None else "\n".join(kept), sum(bool(x.strip(ld.ENDS)) for x in lines), len(lines) - len(kept)] += 1
    got = collected(ld.line_dedup(docs, 3, broadcast_lines=broadcast_lines))
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == want
    assert all(r["lang"] == "en" and r["digest"] == "x" for r in got)
    assert ld.line_dedup(empty, 3, broadcast_lines=broadcast_lines).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(k, f"line of {n} sites", f"s{k}") for n in (5, 39, 40, 41, 200) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = {bytes(r[0]) for r in ld.boilerplate(docs, 40).collect()}
    assert bad == {ld.digest(f"line of {n} sites") for n in (40, 41, 200)}


def likeness(a, b):
    x, y = Counter(fp.paragraphs(a)), Counter(fp.paragraphs(b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def test_fingerprints(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for k, (i, t, _) in enumerate(order):
        own, after = t or "", order[(k + 1) % len(order)][1] or ""
        changed = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        want[i, len(own), hashlib.sha256(changed.encode()).hexdigest(), round(likeness(own, changed), 9), round(likeness(own, after), 9)] += 1
    got = collected(fp.document_fingerprints(docs))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["fingerprint"])
    assert len(by[7]) == 1 and by[4] == by[5] and by[1] != by[3]
    assert fp.document_fingerprints(empty).count() == 0
    one = docs.filter("doc_id = 11")
    assert collected(fp.document_fingerprints(one))[0]["near_next"] == 1.0


def test_paragraphs_of_all_kinds():
    import random

    assert fp.paragraphs("") == fp.paragraphs(" \n\t\n") == []
    assert fp.paragraphs(" one \n\ntwo\r\nthree") == ["one", "two", "three"]
    words = [f"word{k}" for k in range(60)]
    first, second = " ".join(words[:30]) + ".", " ".join(words[30:])
    assert fp.paragraphs(f"{first} {second}") == [" ".join(words[:24]), " ".join(words[24:30]) + ".", " ".join(words[30:54]), " ".join(words[54:])]
    draw = random.Random(2)
    text = "".join(chr(draw.randint(0x3041, 0x30FF)) for _ in range(2000))
    own = fp.paragraphs(text)
    assert "".join(own) == text and 30 < len(own) < 200 and max(map(len, own)) <= fp.MOST_PIECE
    # an insertion changes the pieces about it only
    other = fp.paragraphs(text[:1000] + "あいうえお" + text[1000:])
    assert sum((Counter(own) - Counter(other)).values()) <= 3
    half = text[:1000] + "".join(chr(draw.randint(0x3041, 0x30FF)) for _ in range(1000))
    assert 0.25 < fp.likeness(fp.Digests.of([text]), fp.Digests.of([half]))[0] < 0.42
    assert "".join(fp.paragraphs("x" * 3000)) == "x" * 3000


def test_stored_fingerprints_compare(spark):
    lines = [f"line number {k}" for k in range(40)]
    texts = ["\n".join(lines), "\n".join([*lines[:38], "new"]), "", "\n".join(f"other {k}" for k in range(90))]
    prints = fp.fingerprints(fp.Digests.of(texts))
    pairs = [(a, b) for a in range(4) for b in range(4)]
    rows = spark.createDataFrame([(a, b, prints[a], prints[b], 0.0) for a, b in pairs], "i long, j long, a string, b string, likeness double")
    for r in fp.compare(rows, "a", "b").collect():
        want = likeness(texts[r["i"]], texts[r["j"]])
        assert r["likeness"] is None if 3 in (r["i"], r["j"]) and r["i"] != r["j"] or {r["i"], r["j"]} in ({0, 2}, {1, 2}) else r["likeness"] == pytest.approx(want)


def test_ranges_of_ids_are_found_by_binary_search(spark):
    for cuts in ([], [5], [1, 4, 9], list(range(0, 100, 7))):
        got = spark.range(-3, 120).withColumnRenamed("id", "id_").select("id_", fp._bucket(cuts).alias("b")).collect()
        assert all(r["b"] == sum(c <= r["id_"] for c in cuts) for r in got)


def test_peeling_recovers_the_difference():
    import numpy as np

    a = fp.Digests.of(["\n".join(f"p{k}" for k in range(300)), "same", ""])
    b = fp.Digests.of(["\n".join(f"p{k}" for k in range(100, 450)), "same", "new"])
    only_a, only_b, found = fp.difference(a, b)
    assert only_a.tolist() == [100, 0, 0] and only_b.tolist() == [150, 0, 1]
    got = {(int(v), int(s)) for d, value, sign in found for k, v, s in zip(d, value, sign, strict=True) if k == 0}
    mine, yours = set(a.value[a.doc == 0].tolist()), set(b.value[b.doc == 0].tolist())
    assert got == {(v, 1) for v in mine - yours} | {(v, -1) for v in yours - mine}
    assert isinstance(only_a, np.ndarray)


def brute_secrets(t):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(docs, rows, empty):
    base = [r.kind for r in ss.BASE]
    want = Counter()
    for i, t, _ in rows:
        found = brute_secrets(t or "")
        said = ",".join(f"{base[k]}:{s}:{e}" for s, k, e in found)
        want[(i, *[sum(k == n for _, k, _ in found) for n in range(3)], hashlib.sha256(said.encode()).hexdigest())] += 1
    got = collected(ss.secret_digest(ss.secret_scan(docs)))
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    assert ss.secret_digest(ss.secret_scan(empty)).count() == 0


def test_secrets_on_random_texts():
    import random

    draw, own = random.Random(3), ss.scanner()
    parts = ["password", "passwd", "secret", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "abcdef", "é", "日", "ab", "-", ".", "ſ", "K", "token="]
    for _ in range(3000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))
        data = t.encode()
        assert [x for x in ss.in_code_points(data, own.find(data)) if x[1] < 3] == brute_secrets(t), t


def test_all_kinds_equal_their_regexes_on_random_texts():
    import random

    draw, own = random.Random(9), ss.scanner()
    parts = ["eyJ", "eyJab", ".", ".eyJ", "-", "ghp_", "gho_a1", "AIza", "xoxb-", "sk_live_", "rk_live_9", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "a1B2c3D4", "token", "=", "é", " ", "0123456789abcdef01234567"]
    for _ in range(3000):
        data = "".join(draw.choice(parts) for _ in range(draw.randint(1, 24))).encode()
        want = [(m.start(), k, m.end()) for k, r in enumerate(own.rules) for m in re.finditer(r.span, data) if m.end(r.group) - m.start(r.group) >= r.least]
        assert own.find(data) == sorted(want), data


def test_secrets_take_linear_time():
    import time

    own = ss.scanner()
    for data, n in ((b"eyJ" * 350_000 + b".eyJ" + b"x" * 100, 0), (b"eyJ" * 350_000 + b".eyJ" + b"x" * 100 + b".y", 1), (b"0123456789abcdef" * 65_000, 1), (b"eyJa.eyJ" * 130_000, 0), (b"token=" * 170_000, 1)):
        began = time.process_time()
        assert len(own.find(data)) == n
        assert time.process_time() - began < 10


def test_secrets_of_more_kinds():
    own = ss.scanner()
    t = b"ghp_" + b"a1B2" * 9 + b" xoxb-12345678901 -----BEGIN RSA PRIVATE KEY----- AIza" + b"x" * 35
    assert [own.rules[k].kind for _, k, _ in own.find(t)] == ["github", "slack", "pem", "google"]


def test_licenses(docs, rows, empty):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    phrases = [(t.text.split(), t.label) for t in ls.BASE]
    want = Counter()
    for i, t, _ in rows:
        words = word.findall((t or "").translate(LOWER))
        hits = [(k, label) for k in range(len(words)) for p, label in phrases if words[k : k + len(p)] == p]
        at = [k for k, _ in hits]
        want[i, len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    got = collected(ls.license_digest(ls.license_scan(docs)))
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert ls.license_digest(ls.license_scan(empty)).count() == 0


def test_licenses_of_more_kinds(spark):
    texts = {
        1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software",
        2: "Licensed under the Apache License, Version 2.0.",
        3: "This work is licensed under the GNU General Public License, version 3.",
        4: "hereby any person obtaining the software is associated with charge and restriction documentation",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in collected(ls.license_digest(ls.license_scan(docs)))}
    assert got[1]["labels"] == "mit-text" and got[1]["base_labels"] == ""
    assert got[2]["labels"] == "apache,apache-2.0" and got[3]["labels"] == "gpl,gpl-3.0"
    assert got[4]["labels"] == "" and got[4]["score"] == 0.0 and got[2]["score"] > 0.9


def test_a_file_is_looked_up_by_its_own_rarest_words():
    index = ls.Index(ls.TEMPLATES, {w: float(len(w)) for t in ls.TEMPLATES for w in t.text.encode().split()})
    text = next(t for t in ls.TEMPLATES if t.label == "mit-text").text.split()
    # without the rarest words of the template at large, its key phrase still finds it
    rare = {w.decode() for w in index.rare[[t.label for t in ls.TEMPLATES].index("mit-text")][:2]}
    kept = [w for w in text if w not in rare]
    found = index.find([w.encode() for w in ["intro", *kept, "end"]])
    assert [(ls.TEMPLATES[t].label, s) for t, s, _ in found] == [("mit-text", 1)] and 0 < found[0][2] < 1
    assert index.find([]) == []


def brute_components(rows):
    sets = {}
    for i, t, _ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}


def test_near_dedup(docs, rows, empty):
    sets, root = brute_components(rows)
    got = Counter(tuple(r.values()) for r in collected(near_dedup(docs)))
    want = Counter((i, len(sets[i]), None if i is None else root[i], i is None or root[i] == i) for i, _, _ in rows)
    assert got == want
    assert near_dedup(empty).count() == 0
    kept = [r["doc_id"] for r in collected(one_of_each(docs))]
    assert sorted(x for x in kept if x is not None) == sorted(i for i in root if i is not None and root[i] == i) and kept.count(None) == 1
    assert one_of_each(empty).count() == 0


def test_near_dedup_of_hubs_chains_and_shared_passages(spark):
    import random

    draw = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    base = [draw.choice(words) for _ in range(200)]
    rows = [(500, " ".join(base), "s")]
    for k in range(60):  # copies that are near the hub, but hardly near each other
        own = list(base)
        for p in draw.sample(range(200), 5):
            own[p] = f"v{k}_{p}"
        rows.append((k, " ".join(own), "s"))
    step = [draw.choice(words) for _ in range(150)]
    for k in range(12):  # a chain: each near the next only
        rows.append((1000 + k, " ".join(step), "s"))
        step = step[12:] + [draw.choice(words) for _ in range(12)]
    passage = [draw.choice(words) for _ in range(120)]
    for k in range(80):  # a passage that many share, too little to link them
        rows.append((2000 + k, " ".join(passage + [draw.choice(words) for _ in range(60)]), "s"))
    draw.shuffle(rows)
    _, root = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in collected(near_dedup(docs))} == root


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_document_fingerprints", "op7_secret_scan"])
def test_queries_keep_every_document(spark, data, name):
    from cairn.llm.queries import QUERIES

    assert QUERIES[name](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_tiles_count_overlaps_and_give_one_link_a_label():
    import numpy as np
    import pyarrow as pa

    from cairn.llm.near_dedup import overlaps, tile_links

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    got = overlaps(sets[:15], sets[15:], width=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:15]]
    assert overlaps([np.array([1], dtype=np.uint64)], [np.array([2], dtype=np.uint64)]).tolist() == [[0]]
    table = lambda reps, labels, own: pa.table({"rep": reps, "label": labels, "set": [x.tobytes() for x in own]})
    a = np.arange(100, dtype=np.uint64)
    near, far = np.arange(10, 100, dtype=np.uint64), np.arange(60, 160, dtype=np.uint64)
    links = tile_links(table([1, 2], [1, 7], [a, far]), table([7, 8, 9], [7, 7, 1], [near, near, a])).to_pydict()
    assert links == {"a": [1], "b": [7]}


def test_components_of_stars_chains_and_rings(spark):
    from cairn.llm.near_dedup import components

    edges = [(9, k) for k in range(10, 60)] + [(k, k + 1) for k in range(100, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 9 for k in range(9, 60)} | {k: 100 for k in range(100, 141)} | {k: 200 for k in range(200, 203)}
    assert components(spark.createDataFrame([], "a long, b long")) is None


def test_rare_shingles_by_either_way(spark):
    import numpy as np

    from cairn.llm.common import Scratch
    from cairn.llm.near_dedup import prefix_members

    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 60))
    own = {k: np.unique(np.r_[rng.choice(base, 50, replace=False), rng.integers(0, 2**63, 10)]) for k in range(40)}
    sets = spark.createDataFrame([(k, bytearray(x.astype(np.uint64).tobytes())) for k, x in own.items()], "doc_id long, set binary")
    reps = spark.createDataFrame([(k, len(x)) for k, x in own.items()], "rep long, n_shingles long")
    scratch = Scratch(spark)
    ways = [sorted(tuple(r) for r in prefix_members(sets, reps, scratch, broadcast_shingles=n).collect()) for n in (10**6, 0)]
    scratch.drop()
    assert ways[0] == ways[1] and ways[0]
    held = Counter(x for s in own.values() for x in s.tolist())
    want = Counter()
    for s in own.values():
        want.update(sorted(s.tolist(), key=lambda x: (held[x], x))[: len(s) - -(-3 * len(s) // 4) + 1])
    assert Counter(Counter(r[0] for r in ways[0]).values()) == Counter(n for n in want.values() if n > 1)
