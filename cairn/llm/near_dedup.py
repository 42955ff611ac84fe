"""MinHash near-dedup (9): one-permutation hashing, optimal densification, banded buckets, star edges.

Each text becomes its set of word shingles. One hash of the shingles is split into bins, each bin
keeping its smallest value; an empty bin copies a bin that its own pseudorandom probe sequence finds
(optimal densification). Bands of consecutive bins are bucket keys. Equal sets are one
representative from the start, so copies cost nothing further.

Candidate edges form stars: each representative is compared with one centre, the most popular
representative that shares a bucket with it. Links are confirmed on full sets and contracted into
components. Buckets whose members are one component are done, which leaves little. In the rest,
members of different components are compared: in small buckets pair by pair, in large ones tile by
tile against the bucket's largest component, so that no link that a common bucket shows is lost.
Large buckets may hold many documents that merely share a passage: before all that, their members
are dealt anew by their rare shingles, which loses no link either.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_IDS, Scratch, batches, column, dealt_join, mix64, saved, scope, summed_before, texts, with_ids

WORDS = 5
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bands of ROWS bins: a pair at similarity 0.75 shares no bucket with probability (1 - 0.75**5)**48 < 3e-6.
BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
#: Members above which a band's bucket gives way to buckets by rare shingles, and members are compared in tiles.
LARGE = 32
#: Shared shingles of crowded representatives that may be broadcast (16 bytes each); more are met by a shuffle.
BROADCAST_SHINGLES = 500_000
#: Sets of a block; a tile compares two blocks.
TILE = 256
PROBES = 256
#: Words whose hashes a worker remembers; beyond that it starts anew.
REMEMBERED = 60_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = WordHashes()


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text's whole sequence is one; empty without words."""
    words = text.lower().split()  # of bytes: A-Z only, and the white space U+0009 to U+000D and U+0020
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), seed=len(words))], dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(w) - k + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            x = w[i : i + n] * _FACTORS[i % len(_FACTORS)]
            h = (h ^ (h >> np.uint64(29))) * _FACTORS[(i + 3) % len(_FACTORS)] + x
    return np.unique(mix64(h, k))


@functools.lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    """(PROBES, bins): the bins that an empty bin tries, in order."""
    t, e = np.meshgrid(np.arange(PROBES), np.arange(bins), indexing="ij")
    return (mix64((t * bins + e).astype(np.uint64), 41) % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash of a non-empty set of sorted hashes, densified."""
    at = (((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    full, out = np.zeros(bins, dtype=bool), np.zeros(bins, dtype=np.uint64)
    full[at[first]] = True
    out[at[first]] = hashes[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        tried = _probes(bins)[:, empty]
        hit = full[tried]
        source = tried[hit.argmax(axis=0), np.arange(len(empty))]
        # a set of very few shingles: after the last probe, the next full bin
        none = ~hit.any(axis=0)
        if none.any():
            filled = np.flatnonzero(full)
            source[none] = filled[np.searchsorted(filled, empty[none]) % len(filled)]
        out[empty] = out[source]
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.reshape(bands, -1)
    with np.errstate(over="ignore"):
        h = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(rows.shape[1]):
            h = mix64(h ^ rows[:, k], k)
    return h.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set; null for an empty one), bands (bucket keys)."""

    def sign(part: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in texts(part, "text_")]
        return {
            "doc_id": column(part, "id_"),
            "n_shingles": [len(s) for s in sets],
            "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "bands": [band_keys(signature(s)) if len(s) else None for s in sets],
        }

    rows = docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].cast("string").alias("text_"))
    return batches(rows, sign, "doc_id long, n_shingles long, set_key binary, bands array<long>", size=4 << 20)


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and its set (sorted hashes as bytes) for the documents in ids (doc_id, distinct)."""

    def build(part: pa.RecordBatch) -> dict:
        return {"doc_id": column(part, "doc_id"), "set": [shingles(t).tobytes() for t in texts(part, "text_")]}

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text_"))
    return batches(with_ids(rows, ids, "doc_id"), build, "doc_id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def check(part: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(column(part, "set_a").to_pylist(), column(part, "set_b").to_pylist(), strict=True):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            keep.append(100 * both >= percent * (len(a) + len(b) - both))
        keep = pa.array(keep, type=pa.bool_())
        return {"a": column(part, "a").filter(keep), "b": column(part, "b").filter(keep)}

    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
    return batches(both.select("a", "b", "set_a", "set_b"), check, "a long, b long", size=4 << 20)


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame | None:
    """node, root (the smallest node of its component) of the nodes in edges (a, b); None if there are no edges.

    Every node points to its smallest neighbour, pointers are doubled, and edges are contracted onto
    what they point to, until none is left. The edges of a hub, and the members of a large component,
    are dealt over tasks.
    """
    scratch, roots = scratch or Scratch(edges.sparkSession), None
    edges = scratch.save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to"), F.count(F.lit(1)).alias("near")), "first")
        # those that point to a node are neighbours of it
        further = first.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("near").alias("pointed"))
        up = scratch.save(dealt_join(first, further, "to", "pointed", ["node"]).select("node", F.col("further").alias("to"), "near"))
        if roots is None:
            roots = up.select("node", F.col("to").alias("root"))
        else:
            held = roots.groupBy("root").agg(F.count(F.lit(1)).alias("held"))
            moved = scratch.save(held.join(up.select(F.col("node").alias("root"), "to"), "root"), "moved")
            roots = scratch.save(dealt_join(roots, moved, "root", "held", ["node"], "left").select("node", F.coalesce("to", "root").alias("root")))
        one = dealt_join(edges, up.select(F.col("node").alias("a"), F.col("to").alias("x"), "near"), "a", "near", ["b"]).select("b", "x")
        both = dealt_join(one, up.select(F.col("node").alias("b"), F.col("to").alias("y"), "near"), "b", "near", ["x"]).filter("x <> y")
        edges = scratch.save(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return roots


def prefix_members(sets: DataFrame, reps: DataFrame, scratch: Scratch, percent: int = PERCENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """key, rep, n_shingles, size: buckets by rare shingles for reps (rep, n_shingles), an exact way for large buckets.

    Sets that are similar enough share one of their rarest shingles: of n in the order of how many of
    reps hold them, the first n - ceil(percent * n / 100) + 1. A passage that many documents share is
    frequent, so it comes last and makes no bucket unless it is nearly all of a document.
    """

    def spread(part: pa.RecordBatch) -> dict:
        every = [np.frombuffer(x, dtype=np.int64) for x in column(part, "set").to_pylist()]
        sizes = [len(x) for x in every]
        return {"rep": np.repeat(column(part, "rep").to_numpy(), sizes), "n_shingles": np.repeat(sizes, sizes), "shingle": np.concatenate(every) if every else np.zeros(0, dtype=np.int64)}

    own = sets.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "set")
    rows = batches(own, spread, "rep long, n_shingles long, shingle long", size=1 << 20)
    # shingles of one representative alone come first in its order, and meet nobody
    held = scratch.save(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
    if held.limit(broadcast_shingles + 1).count() <= broadcast_shingles:
        few = held.toPandas().sort_values("shingle")  # of a checked size
        sent = sets.sparkSession.sparkContext.broadcast((few["shingle"].to_numpy(), few["held"].to_numpy()))

        def choose(part: pa.RecordBatch) -> dict:
            shingle, count = sent.value
            out_key, out_rep, out_n = [], [], []
            for rep, x in zip(column(part, "rep").to_pylist(), column(part, "set").to_pylist(), strict=True):
                own = np.frombuffer(x, dtype=np.int64)
                at = np.minimum(np.searchsorted(shingle, own), max(len(shingle) - 1, 0))
                shared = own[shingle[at] == own] if len(shingle) else own[:0]
                first = len(own) + (-len(own) * percent // 100) + 1 - (len(own) - len(shared))
                if first > 0 and len(shared):
                    held_by = count[np.searchsorted(shingle, shared)]
                    out_key.append(shared[np.lexsort((shared, held_by))[:first]])
                    out_rep.append(np.full(len(out_key[-1]), rep))
                    out_n.append(np.full(len(out_key[-1]), len(own)))
            flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            return {"key": flat(out_key), "rep": flat(out_rep), "n_shingles": flat(out_n)}

        keys = batches(own, choose, "key long, rep long, n_shingles long").withColumn("key", F.xxhash64("key"))
    else:
        met = rows.join(held, "shingle").groupBy("rep", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("shared"))
        need = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
        first = F.greatest(F.lit(0), need - (F.col("n_shingles") - F.size("shared"))).cast("int")
        keys = met.select("rep", "n_shingles", F.explode(F.slice("shared", F.lit(1), first)).alias("x")).select(F.xxhash64(F.col("x.shingle")).alias("key"), "rep", "n_shingles")
    keys = scratch.save(keys)
    sizes = scratch.save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    return dealt_join(keys, sizes, "key", "size", ["rep"]).select("key", "rep", "n_shingles", "size")


def linked(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame | None:
    """node, root of the representatives (rep, n_shingles, bands) that have links; None without any."""
    rows = reps.select("rep", "n_shingles", F.explode("bands").alias("key"))
    sizes = scratch.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = scratch.save(dealt_join(rows, sizes, "key", "size", ["rep"]).select("key", "rep", "n_shingles", "size"))
    if members.isEmpty():
        return None
    ids = scratch.save(members.select(F.col("rep").alias("doc_id")).distinct())
    sets = scratch.save(shingle_sets(docs, ids, id_col, text_col))
    crowded = members.filter(F.col("size") > LARGE)
    if not crowded.isEmpty():
        rare = prefix_members(sets, crowded.select("rep", "n_shingles").distinct(), scratch)
        members = scratch.save(members.filter(F.col("size") <= LARGE).unionByName(rare))
    popular = members.groupBy("rep").agg(F.sum("size").alias("popular"))
    members = scratch.save(members.join(popular, "rep"), "members")
    links = scratch.save(confirmed(scratch.save(best_centres(members, scratch)), sets))
    roots = components(links, scratch)
    members = scratch.save(_mixed(members, roots, scratch), "members")
    if members.isEmpty():
        return roots
    few = scratch.save(confirmed(scratch.save(_pairs(members.filter(F.col("size") <= LARGE))), sets))
    many = members.filter(F.col("size") > LARGE)
    if not many.isEmpty():
        few = few.union(scratch.save(family_links(many, roots, sets, scratch)))
    return roots if few.isEmpty() else components(links.union(few), scratch)


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs of different labels in buckets of bounded size, each once: at most LARGE / 2 for each member of a bucket."""
    other = members.select("key", F.col("rep").alias("c"), F.col("n_shingles").alias("c_n"), F.col("label").alias("c_label"))
    met = members.join(other.hint("merge"), (members["key"] == other["key"]) & (F.col("rep") < F.col("c")) & (F.col("label") != F.col("c_label")) & _close())
    return met.select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct()


def family_links(members: DataFrame, roots: DataFrame | None, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different labels in large buckets, compared in tiles.

    A bucket's largest component is its family; the bucket's other members are attached to it. All that
    are attached to a family are compared with its component and with each other: queries and the
    family's members are dealt into blocks of TILE, and a tile is a block of each. So a set travels
    once for each block it meets, not once for each pair, and no task holds more than two blocks.
    """
    spark = members.sparkSession
    nodes = roots if roots is not None else spark.createDataFrame([], "node long, root long")
    held = members.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).join(nodes.groupBy(F.col("root").alias("label")).agg(F.count(F.lit(1)).alias("held")), "label", "left")
    sized = dealt_join(members, scratch.save(held), "label", "rows", ["rep", "key"]).withColumn("held", F.coalesce("held", F.lit(1)))
    family = scratch.save(sized.groupBy("key").agg(F.max(F.struct("held", "label")).alias("top"), F.count(F.lit(1)).alias("own")).select("key", F.col("top.label").alias("family"), "own"))
    attached = scratch.save(dealt_join(members, family, "key", "own", ["rep"]).filter("label <> family").select("family", "rep", "label").distinct())
    families = attached.select("family").distinct()
    whole = nodes.join(families, nodes["root"] == families["family"]).select("family", F.col("node").alias("rep"), F.col("root").alias("label"))
    alone = families.join(nodes.select(F.col("root").alias("family")).distinct(), "family", "left_anti").select("family", F.col("family").alias("rep"), F.col("family").alias("label"))
    every = scratch.save(whole.union(alone).union(attached.select("family", "rep", "label")).distinct())
    blocks = every.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    asked = attached.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("asks"))
    grid = scratch.save(blocks.join(asked, "family"))
    own, ask = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("rep"), F.col("asks")).cast("int")
    of = sets.select(F.col("doc_id").alias("rep"), "set")
    base = every.join(grid, "family").withColumn("block", own).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    queries = attached.join(grid, "family").withColumn("ask", ask).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = lambda df: df.select("family", "block", "ask", "rep", "label").join(of.hint("merge"), "rep")
    left = tile(queries).select(*[F.col(c).alias(c + "_q") for c in ("family", "block", "ask", "rep", "label", "set")]).toDF("family", "block", "ask", "rep", "label", "set")

    def compare(q: pa.Table, b: pa.Table) -> pa.Table:
        return tile_links(q, b)

    return left.groupBy("family", "block", "ask").cogroup(tile(base).groupBy("family", "block", "ask")).applyInArrow(compare, "a long, b long")


def tile_links(q: pa.Table, b: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Links between the rows of two tables (rep, label, set) of different labels: one for each query and label, as any will do."""
    out_a: list[int] = []
    out_b: list[int] = []
    if q.num_rows and b.num_rows:
        sides = [[np.frombuffer(x, dtype=np.uint64) for x in t["set"].to_pylist()] for t in (q, b)]
        sizes = [np.array([len(x) for x in side]) for side in sides]
        both = overlaps(*sides)
        similar = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
        reps, labels = [t["rep"].to_numpy() for t in (q, b)], [t["label"].to_numpy() for t in (q, b)]
        similar &= labels[0][:, None] != labels[1][None, :]
        for i in np.flatnonzero(similar.any(axis=1)):
            hit = np.flatnonzero(similar[i])
            first = np.unique(labels[1][hit], return_index=True)[1]
            out_a += [int(reps[0][i])] * len(first)
            out_b += reps[1][hit[first]].tolist()
    return pa.table({"a": pa.array(out_a, type=pa.int64()), "b": pa.array(out_b, type=pa.int64())})


def overlaps(q: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each pair of sets shares: products of 0/1 matrices, width columns of shared elements at a time."""
    codes, counts = [], []
    flat = [np.concatenate(side) for side in (q, b)]
    shared = np.intersect1d(*flat)
    for side, values in zip((q, b), flat, strict=True):
        at = np.searchsorted(shared, values)
        hit = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == values) if len(shared) else np.zeros(len(values), dtype=bool)
        codes.append(at[hit])
        counts.append(np.repeat(np.arange(len(side)), [len(x) for x in side])[hit])
    out = np.zeros((len(q), len(b)), dtype=np.int64)
    for low in range(0, len(shared), width):
        ones = []
        for code, row, n in zip(codes, counts, out.shape, strict=True):
            now = (code >= low) & (code < low + width)
            m = np.zeros((n, min(width, len(shared) - low)), dtype=np.float32)
            m[row[now], code[now] - low] = 1
            ones.append(m)
        out += np.rint(ones[0] @ ones[1].T).astype(np.int64)
    return out


def _close():
    """Sizes that a link allows."""
    return 100 * F.least("n_shingles", "c_n") >= PERCENT * F.greatest("n_shingles", "c_n")


def best_centres(members: DataFrame, scratch: Scratch) -> DataFrame:
    """One pair (a, b) for each member: with the most popular centre of all its buckets. A large group of copies around one document needs no more."""
    first = F.min(F.struct((-F.col("popular")).alias("less"), F.col("rep").alias("c"), F.col("n_shingles").alias("c_n"))).alias("top")
    tops = scratch.save(members.groupBy("key").agg(first, F.count(F.lit(1)).alias("own")).select("key", "top.*", "own"))
    met = dealt_join(members, tops, "key", "own", ["rep"]).filter((F.col("rep") != F.col("c")) & _close())
    best = met.groupBy("rep").agg(F.min(F.struct("less", "c")).alias("best"))
    return best.select(F.least("rep", "best.c").alias("a"), F.greatest("rep", "best.c").alias("b")).distinct()


def _mixed(members: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame:
    """members with label, the root of each, of the buckets only that hold several labels."""
    if roots is None:
        left = members.withColumn("label", F.col("rep"))
    else:
        left = scratch.save(members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root"), "labelled")
    several = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("own")).filter("low < high")
    return dealt_join(left, scratch.save(several.select("key", "own")), "key", "own", ["rep"], "left_semi").select("key", "rep", "n_shingles", "size", "label")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Words are runs without white space, A-Z in lower case; a text of fewer words than WORDS is one
    shingle; a text without words, or null, has none and is linked with nothing. Rows without a doc_id
    are linked with nothing either: component_id is null and kept true. Ids should be unique: each row
    has the component of its own text, and of several texts with one id a link of one may count for
    the others. Other columns are left out. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        own = scratch.save(signatures(docs, id_col, text_col))
        some = own.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
        first = F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x")
        reps = scratch.save(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), first, F.count(F.lit(1)).alias("copies")).select("set_key", "rep", "x.n_shingles", "x.bands", "copies"))
        roots = linked(docs, reps.select("rep", "n_shingles", "bands"), id_col, text_col, scratch)
        # only sets with copies or links travel to the rows
        if roots is None:
            moved = reps.filter("copies > 1").select("set_key", F.col("rep").alias("component"), "copies")
        else:
            moved = reps.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").filter("copies > 1 or root is not null").select("set_key", F.coalesce("root", "rep").alias("component"), "copies")
        known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        rows = dealt_join(own.select("doc_id", "n_shingles", "set_key"), scratch.save(moved), "set_key", "copies", ["doc_id"], "left")
        return saved(rows.select("doc_id", "n_shingles", known.alias("component_id"), known.eqNullSafe(F.col("doc_id")).alias("kept")))
    finally:
        scratch.drop()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that near_dedup keeps: one document of each group, the one of smallest id.

    Rows that share an id are documents of their own: different texts stay, and of copies and near
    copies the longest text does. Rows without an id stay.
    """
    id_, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    rows = docs.select(id_.alias("kept_"), F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("row_"))
    with scope(docs.sparkSession):
        if docs.select(id_.alias("id_")).dropna().groupBy("id_").agg(F.count(F.lit(1)).alias("rows_")).filter("rows_ > 1").isEmpty():
            found = near_dedup(docs, id_col, text_col)
        else:  # numbered in the order of ids; the numbers stand in a table, as they must not change
            some = docs.select(id_.alias("kept_"), text.alias("text_"), F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("row_"), F.lit(1).alias("one_")).filter("kept_ is not null")
            order = [F.col("kept_").asc(), F.length("text_").desc_nulls_last(), F.col("text_").asc_nulls_last()]
            own = saved(summed_before(some, order, ["one_"], some.count()), keep=True)
            rows = own.select(F.col("one__before").cast("long").alias("kept_"), "row_").unionByName(rows.filter("kept_ is null"))
            found = near_dedup(own.select("one__before", "text_"), "one__before", "text_")
        ids = saved(found.filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_")).distinct(), keep=True)
    return with_ids(rows.filter("kept_ is not null"), ids, "kept_").select("row_.*").unionByName(rows.filter("kept_ is null").select("row_.*"))


def with_group_sites(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The rows of docs with name added: the site of the document that one_of_each keeps of their group, the own one outside groups.

    So copies of one document, near ones included, stand in one site wherever they come from.
    """
    small = lambda df: F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df.hint("merge")
    with scope(docs.sparkSession):
        moved = saved(near_dedup(docs, id_col, text_col).filter("component_id <> doc_id").groupBy("doc_id").agg(F.min("component_id").alias("first_")))
        firsts = saved(moved.groupBy("first_").agg(F.count(F.lit(1)).alias("members_")))
        own = docs.select(docs[id_col].cast("long").alias("first_"), docs[site_col].cast("string").alias("site_"))
        sites = own.join(small(firsts.select("first_")), "first_", "left_semi").groupBy("first_").agg(F.min("site_").alias("site_"))
        sites = saved(sites.join(firsts, "first_"))
        by_id = saved(dealt_join(moved, sites, "first_", "members_", ["doc_id"]).select(F.col("doc_id").alias("moved_"), "site_"), keep=True)
    met = docs.join(small(by_id), docs[id_col].cast("long") == F.col("moved_"), "left")
    return met.withColumn(name, F.when(F.col("moved_").isNotNull(), F.col("site_")).otherwise(docs[site_col].cast("string"))).drop("moved_", "site_")
