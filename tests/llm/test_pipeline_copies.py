import corpus_pipeline as pipe

BODY = {g: [f"group {g} line {k} says {g * 1000 + k} and more of word{k * 7 + g}" for k in range(40)] for g in range(3)}
SHARED = "accept all cookies here"


def corpus():
    """A group of 20 copies and one of 20 near copies, each over 12 sources, and 24 documents of their own under a line of 12 sources."""
    rows = [(k, "\n".join(BODY[0]), f"s{k % 12}") for k in range(20)]
    rows += [(100 + k, "\n".join([*BODY[1][:20], f"edition {k}", *BODY[1][20:]]), f"s{k % 12}") for k in range(20)]
    rows += [(200 + k, "\n".join([SHARED, *(f"page {k} part {i} of thing{k * 31 + i}" for i in range(12))]), f"s{k % 12}") for k in range(24)]
    return [(i, t, "en", s, len(t)) for i, t, s in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_a_copied_document_stays_whole_once(spark):
    rows = corpus()
    text = {i: t for i, t, *_ in rows}
    cleaned = pipe.lines(spark, frame(spark, rows), "").collect()
    assert {r["doc_id"]: r["text"] for r in cleaned} == {i: t.removeprefix(SHARED + "\n") for i, t in text.items()} and len(cleaned) == len(rows)
    kept = {r["doc_id"]: r["text"] for r in pipe.near_copies(spark, frame(spark, [tuple(r) for r in cleaned]), "").collect()}
    assert sorted(kept) == [0, 100, *range(200, 224)]
    assert kept[0] == text[0] and kept[100] == text[100]
