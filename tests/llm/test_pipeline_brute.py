import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipe
from cairn.llm import mixing as mx
from cairn.llm import quality as q
from test_mixing_quality import brute_targets

MENU = "home news contact imprint"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """20 copies and 20 near copies over 12 sources; 24 pages under a menu of 12 sources; 9 pages with a line of 9 sources."""
    body = lambda g, n: [f"part {g} row {k} holds item{g * 1000 + k} of lot{k * 7 + g}" for k in range(n)]
    docs = [(k, body(1, 40), k) for k in range(20)]
    docs += [(50 + k, [*body(2, 20), f"edition {k}", *body(3, 20)], k) for k in range(20)]
    docs += [(100 + k, [MENU, *body(10 + k, 8)], k) for k in range(24)]
    docs += [(200 + k, ["a line of nine sources", *body(50 + k, 8)], k) for k in range(9)]
    return [(i, "\n".join(x), "en", f"s{k % 12}", len("\n".join(x))) for i, x, k in docs]


def groups(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((r[0], r[1].lower().split()) for r in rows)}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and root[i] != root[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if x == high else x for k, x in root.items()}
    return root


def cleaned(rows):
    root, source, sites = groups(rows), {r[0]: r[3] for r in rows}, defaultdict(set)
    for i, text, *_ in rows:
        for line in text.split("\n"):
            sites[line].add(source[root[i]])
    texts = [(r, "\n".join(x for x in r[1].split("\n") if len(sites[x]) < 10)) for r in rows]
    return [(r[0], t, r[2], r[3], len(t)) for r, t in texts]


def counted(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def frames(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_quality_keeps_what_its_scores_predict(spark, frames, tmp_path):
    rows = corpus()
    labels = spark.createDataFrame([(r[0], int(r[0] < 150)) for r in rows], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = {r["doc_id"] for r in q.quality_scores(frames(rows), labels).collect() if r["predicted"] == 1}
    assert counted(pipe.quality(spark, frames(rows), str(tmp_path))) == Counter(r for r in rows if r[0] in good)


def test_lines_then_near_copies(spark, frames):
    rows = corpus()
    clean = cleaned(rows)
    assert MENU not in "".join(r[1] for r in clean) and sum("nine sources" in r[1] for r in clean) == 9
    assert counted(pipe.lines(spark, frames(rows), "")) == Counter(clean)
    root = groups(clean)
    assert counted(pipe.near_copies(spark, frames(clean), "")) == Counter(r for r in clean if root[r[0]] == r[0])


def test_mix_then_packing(spark, frames):
    rows = [r for r in corpus() if r[0] >= 100]
    mixed = pipe.source_weights(spark, frames(rows), "").collect()
    words, size, taken = {r[0]: Counter(r[1].split()) for r in rows}, Counter(), Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    for r in mixed:
        own = Counter(r["text"].split())
        assert all(n <= 2 * words[r["doc_id"]][w] for w, n in own.items()) and r["n_chars"] == len(r["text"])
        taken[r["source"]] += own.total()
    names = sorted(size)
    assert all(abs(taken[s] - want) <= 2 * mx.BLOCK_WORDS for s, want in zip(names, brute_targets([size[s] for s in names]), strict=True))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in mixed}
    got = defaultdict(int)
    for r in pipe.packing(spark, frames([tuple(r) for r in mixed]), "").collect():
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        got[r["doc_id"]] += r["length"]
    assert got == {i: len(x) for i, x in ids.items()}


def test_the_whole_run_against_brute_force_stages(spark, frames, tmp_path):
    rows = corpus()
    frames(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], int(r[0] < 150)) for r in rows], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = {r["doc_id"] for r in q.quality_scores(frames(rows), labels).collect() if r["predicted"] == 1}
    clean = cleaned([r for r in rows if r[0] in good])
    root = groups(clean)
    single = [r for r in clean if root[r[0]] == r[0]]
    # which words the mix takes is tested slot by slot; here, that the run goes on with just these
    mixed = pipe.source_weights(spark, frames(single), "").collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in mixed}
    got, used = defaultdict(int), defaultdict(list)
    for r in pipe.run(spark, str(tmp_path)).collect():
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) and r["doc_tokens"] == len(want[r["doc_id"]])
        got[r["doc_id"]] += r["length"]
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == {i: len(x) for i, x in want.items()}
    for pieces in used.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
