"""Document fingerprints (4): an invertible Bloom lookup sketch of paragraph digests.

A text's paragraphs (lines; sentences of long lines; windows of long sentences; pieces of text with
few spaces, cut where its characters say so) are hashed to 64-bit digests, the k-th repeat of a
paragraph to a digest of its own. Each digest is added to one cell in
each of three tables of cells (count, xor of digests, xor of checks). To compare two versions, cells
are subtracted: what both share cancels. Peeling takes cells that hold a single digest, and so
recovers the digests that differ and in which version they stand. Where peeling stalls, both are
sketched again with twice the cells, until it succeeds. All documents of a batch are sketched and
peeled together in numpy arrays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import mix64, partitions, sliced

TABLES = 3
#: Cells of the fingerprint itself, TABLES tables together.
CELLS = 12
#: Words of a line above which it is cut into sentences, and sentences into windows of as many words.
LONG = 24
#: Characters up to which a line is one paragraph; and characters a word above which a longer piece counts as text with few spaces.
SHORT, SPARSE = 96, 16
#: Text with few spaces is cut behind one of PIECE characters on average, by a hash of the last four; no piece is shorter or longer than these but the last.
PIECE, LEAST_PIECE, MOST_PIECE = 24, 8, 256
#: Rows of a range of ids.
RANGE_ROWS = 20_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def paragraphs(text: str) -> list[str]:
    """Paragraphs of a text, in order; blank ones are left out."""
    out = []
    for line in text.split("\n"):
        line = line.strip()
        if len(line) <= SHORT:
            if line:
                out.append(line)
            continue
        parts = [line]
        if line.count(" ") >= LONG:
            split = (sentence.split() for sentence in _SENTENCE.split(line))
            parts = [" ".join(words[k : k + LONG]) for words in split for k in range(0, len(words), LONG)]
        for part in parts:
            if len(part) > SHORT and len(part) > SPARSE * (part.count(" ") + 1):
                out += pieces(part)
            else:
                out.append(part)
    return out


def pieces(part: str) -> list[str]:
    """part cut at content-defined places, so that an edit changes the pieces about it only."""
    codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        last = codes[3:] + np.uint64(1 << 21) * codes[2:-1] + np.uint64(1 << 42) * codes[1:-2]
        cuts = np.flatnonzero(mix64(last ^ mix64(codes[:-3], 3), 5) % np.uint64(PIECE) == 0) + 4
    out, begin = [], 0
    for cut in [*cuts.tolist(), len(part)]:
        while cut - begin > MOST_PIECE:
            out.append(part[begin : begin + MOST_PIECE])
            begin += MOST_PIECE
        if cut - begin >= LEAST_PIECE or cut == len(part) > begin:
            out.append(part[begin:cut])
            begin = cut
    return out


@dataclass
class Digests:
    """Paragraph digests of several documents: flat values, and the document of each."""

    value: np.ndarray
    doc: np.ndarray
    docs: int

    @classmethod
    def of(cls, texts: list[str]) -> Digests:
        flat, sizes = [], []
        for t in texts:
            own = [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) for p in paragraphs(t)]
            flat += own
            sizes.append(len(own))
        value, doc = np.array(flat, dtype=np.uint64), np.repeat(np.arange(len(texts)), sizes)
        # the k-th repeat of a paragraph within its document is another element of the set
        order = np.lexsort((value, doc))
        v, d = value[order], doc[order]
        new = np.r_[True, (v[1:] != v[:-1]) | (d[1:] != d[:-1])] if len(v) else np.zeros(0, dtype=bool)
        at = np.arange(len(v))
        nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(v) else at
        with np.errstate(over="ignore"):
            value[order] = mix64(v + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1)
        return cls(value, doc, len(texts))

    def sizes(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)

    def take(self, docs: np.ndarray) -> Digests:
        """The chosen documents, numbered anew; docs has no number twice."""
        to = np.full(self.docs, -1)
        to[docs] = np.arange(len(docs))
        keep = to[self.doc] >= 0
        return Digests(self.value[keep], to[self.doc[keep]], len(docs))


@dataclass
class Sketch:
    """Cells of several documents: arrays (documents, cells)."""

    count: np.ndarray
    keys: np.ndarray
    checks: np.ndarray


def places(value: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each table, (TABLES, n)."""
    each = cells // TABLES
    return np.stack([(mix64(value, 11 + t) % np.uint64(each)).astype(np.int64) + t * each for t in range(TABLES)])


def check_of(value: np.ndarray) -> np.ndarray:
    return mix64(value, 97)


def sketch(d: Digests, cells: int) -> Sketch:
    flat = (d.doc[None, :] * cells + places(d.value, cells)).ravel()
    order = np.argsort(flat, kind="stable")
    f = flat[order]
    count = np.bincount(flat, minlength=d.docs * cells)
    keys, checks = np.zeros(d.docs * cells, dtype=np.uint64), np.zeros(d.docs * cells, dtype=np.uint64)
    if len(f):
        first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        keys[f[first]] = np.bitwise_xor.reduceat(np.tile(d.value, TABLES)[order], first)
        checks[f[first]] = np.bitwise_xor.reduceat(np.tile(check_of(d.value), TABLES)[order], first)
    shape = (d.docs, cells)
    return Sketch(count.reshape(shape), keys.reshape(shape), checks.reshape(shape))


def peel(a: Sketch, b: Sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subtract b from a and peel: whether each document succeeded, the digests recovered (document, digest, +1 only in a or -1 only in b)."""
    docs, cells = a.count.shape
    count, keys, checks = (a.count - b.count).ravel(), (a.keys ^ b.keys).ravel(), (a.checks ^ b.checks).ravel()
    got_doc, got_value, got_sign = [], [], []
    look = np.arange(len(count))
    for _ in range(64 + cells):
        look = look[np.abs(count[look]) == 1]
        look = look[check_of(keys[look]) == checks[look]]
        if not len(look):
            break
        doc = look // cells
        # a digest alone in several of its cells is taken once
        value, sign = keys[look], count[look]
        order = np.lexsort((value, doc))
        first = order[np.r_[True, (value[order][1:] != value[order][:-1]) | (doc[order][1:] != doc[order][:-1])]]
        doc, value, sign = doc[first], value[first], sign[first]
        got_doc.append(doc)
        got_value.append(value)
        got_sign.append(sign)
        at = doc[None, :] * cells + places(value, cells)
        for row in at:
            np.subtract.at(count, row, sign)
            np.bitwise_xor.at(keys, row, value)
            np.bitwise_xor.at(checks, row, check_of(value))
        look = np.unique(at)
    done = ~((count != 0) | (keys != 0)).reshape(docs, cells).any(axis=1)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
    return done, join(got_doc, np.int64), join(got_value, np.uint64), join(got_sign, np.int64)


def difference(a: Digests, b: Digests, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Digests only in a and only in b, counted for each pair of documents, and the recovered ones; retried larger on failure."""
    only_a, only_b, found = np.zeros(a.docs, dtype=np.int64), np.zeros(a.docs, dtype=np.int64), []
    left = np.arange(a.docs)
    apart = np.abs(a.sizes() - b.sizes())
    while len(left):
        # no fewer cells than the sizes alone show to be needed
        now = left[apart[left] * 5 <= cells * 4]
        if len(now):
            mine, yours = a.take(now), b.take(now)
            done, doc, value, sign = peel(sketch(mine, cells), sketch(yours, cells))
            keep = done[doc]
            doc, value, sign = doc[keep], value[keep], sign[keep]
            only_a[now] += np.bincount(doc[sign > 0], minlength=len(now))
            only_b[now] += np.bincount(doc[sign < 0], minlength=len(now))
            found.append((now[doc], value, sign))
            left = np.setdiff1d(left, now[done], assume_unique=True)
        cells *= 2
    return only_a, only_b, found


def likeness(a: Digests, b: Digests) -> np.ndarray:
    """Shared paragraphs over all paragraphs of each pair; 1 where neither has any."""
    only_a, only_b, _ = difference(a, b)
    both = a.sizes() - only_a
    union = both + only_a + only_b
    return np.where(union == 0, 1.0, both / np.maximum(union, 1))


def fingerprints(d: Digests) -> list[str]:
    """The base sketch of each document in hex: number of paragraphs, then count, xor of digests and of checks of each cell."""
    s = sketch(d, CELLS)
    rows = np.concatenate([d.sizes().astype("<u4")[:, None].view(np.uint8), s.count.astype("<u4").view(np.uint8).reshape(d.docs, -1), s.keys.astype("<u8").view(np.uint8).reshape(d.docs, -1), s.checks.astype("<u8").view(np.uint8).reshape(d.docs, -1)], axis=1)
    return [r.tobytes().hex() for r in rows]


def parsed(prints: list[str]) -> tuple[np.ndarray, Sketch]:
    """Numbers of paragraphs and sketches of fingerprints."""
    raw = np.frombuffer(bytes.fromhex("".join(prints)), dtype=np.uint8).reshape(len(prints), 4 + 20 * CELLS)
    part = lambda low, high, kind: np.ascontiguousarray(raw[:, low:high]).view(kind)
    c = 4 + 4 * CELLS
    return part(0, 4, "<u4")[:, 0].astype(np.int64), Sketch(part(4, c, "<u4").astype(np.int64), part(c, c + 8 * CELLS, "<u8"), part(c + 8 * CELLS, c + 16 * CELLS, "<u8"))


def compared(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of the pairs of fingerprints; nan where they differ by more than their cells can tell, and the texts must be compared."""
    if not a:
        return np.zeros(0)
    (size_a, mine), (size_b, yours) = parsed(a), parsed(b)
    done, doc, _, sign = peel(mine, yours)
    only_a, only_b = (np.bincount(doc[sign == x], minlength=len(a)) for x in (1, -1))
    both = size_a - only_a
    union = both + only_a + only_b
    return np.where(done & (both == size_b - only_b), np.where(union == 0, 1.0, both / np.maximum(union, 1)), np.nan)


def compare(rows: DataFrame, a_col: str, b_col: str, name: str = "likeness") -> DataFrame:
    """rows (without null fingerprints) with the likeness of two columns of stored fingerprints; null where only the texts can tell (about a dozen paragraphs differ)."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != name]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = part.drop_columns([name]) if name in part.schema.names else part
            like = compared(*[part.column(c).to_pylist() for c in (a_col, b_col)])
            yield own.append_column(name, pa.array(like, type=pa.float64(), mask=np.isnan(like)))

    return rows.mapInArrow(run, ", ".join([*kinds, f"`{name}` double"]))


def in_order(docs: DataFrame, n: int) -> DataFrame:
    """docs (id_, text_) dealt into n ranges of ids, each range in one partition, sorted, with the first row of the next range after it (ghost_).

    The only data at the driver are one bound and one smallest id for each range.
    """
    ids = docs.select("id_")
    # a percentile for each range: n numbers
    cuts = ids.agg(F.percentile_approx("id_", [k / n for k in range(1, n)], 20 * n).alias("cut")).first()["cut"] if n > 1 else None
    cuts = sorted(set(cuts or []))
    # rows without an id come first
    bucket = F.when(F.col("id_").isNull(), F.lit(0)).otherwise(_bucket(cuts))
    dealt = docs.withColumn("bucket_", bucket)
    heads = dealt.select("bucket_", "id_").groupBy("bucket_").agg(F.min(F.struct(F.col("id_").isNotNull().alias("some"), F.col("id_").alias("id"))).alias("head")).collect()
    heads = sorted((r["bucket_"], r["head"]["id"]) for r in heads) if heads else []
    if not heads:
        return dealt.withColumn("ghost_", F.lit(False))
    spark = docs.sparkSession
    firsts = spark.createDataFrame([(b, h, heads[k - 1][0]) for k, (b, h) in enumerate(heads)], "b_ int, h_ long, to_ int")
    marked = dealt.join(F.broadcast(firsts), (F.col("bucket_") == F.col("b_")) & F.col("id_").eqNullSafe(F.col("h_")), "left")
    copies = F.when(F.col("to_").isNull(), F.array(F.struct(F.col("bucket_").alias("bucket_"), F.lit(False).alias("ghost_")))).otherwise(
        F.array(F.struct(F.col("bucket_").alias("bucket_"), F.lit(False).alias("ghost_")), F.struct(F.col("to_").alias("bucket_"), F.lit(True).alias("ghost_")))
    )
    out = marked.select("id_", "text_", F.explode(copies).alias("x")).select("id_", "text_", "x.bucket_", "x.ghost_")
    return out.repartitionById(max(n, 1), F.col("bucket_")).sortWithinPartitions("bucket_", "ghost_", F.col("id_").asc_nulls_first(), "text_")


def _bucket(cuts: list[int]) -> Column:
    """Number of cuts that are at most id_, by binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    own = F.expr("array(%s)" % ", ".join(f"{c}L" for c in cuts))
    steps = F.expr("array(%s)" % ", ".join(str(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))
    # beyond the last cut get() is null, which is not at most anything
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(own, at + step - 1) <= F.col("id_"), at + step).otherwise(at))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint, and of the edited text: edited_sha256, edited_fingerprint, near_edited; near_next.

    The next document is the next by ascending id (null ids first; rows with one id by text), after
    the last the first; a lone document follows itself. The edited text is the document's own first
    part with its last half (rounded down) replaced by as many leading code points of the next
    document, or all of it. Null texts are empty. Two texts without paragraphs have likeness 1.
    Other columns are left out. An empty table gives an empty result. One shuffle of the texts; a range
    of ids is streamed, one batch of rows and one row more in memory.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id_"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text_"))
    ordered = in_order(rows, max(partitions(spark), -(-rows.count() // RANGE_ROWS)))
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, which waits for its next one
        for part in parts:
            for piece in sliced(part, size=4 << 20):
                rows = list(zip(*[piece.column(k).to_pylist() for k in range(4)], strict=True))  # id, text, bucket, ghost
                rows = ([held] if held else []) + rows
                held = rows[-1]
                # a ghost only serves as next; of several ghosts (one id repeated) the first does
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3]]
                if pairs:
                    yield pa.RecordBatch.from_pydict(_compared(pairs), schema=out)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compared(pairs: list[tuple]) -> dict:
    own = [a[1] for a, _ in pairs]
    # each row's text once: the next of a row is nearly always the following row
    follows = [k + 1 < len(pairs) and pairs[k + 1][0] is b for k, (_, b) in enumerate(pairs)]
    rest = [b[1] for (_, b), f in zip(pairs, follows, strict=True) if not f]
    every = Digests.of(own + rest)
    spare = iter(range(len(own), len(own) + len(rest)))
    after = np.array([k + 1 if f else next(spare) for k, f in enumerate(follows)])
    changed = [edited(a[1], b[1]) for a, b in pairs]
    mine, theirs, new = every.take(np.arange(len(own))), every.take(after), Digests.of(changed)
    return {
        "doc_id": [a[0] for a, _ in pairs],
        "n_chars": [len(t) for t in own],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": fingerprints(mine),
        "edited_fingerprint": fingerprints(new),
        "near_edited": likeness(mine, new),
        "near_next": likeness(mine, theirs),
    }
