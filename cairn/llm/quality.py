"""Quality classifier (10): a generalised additive model with pairwise interactions.

Features of the text alone are cut into bins. Boosting goes round the features in cycles: each step
fits a shallow tree on one feature's bins to the gradients and adds it, scaled down, to the feature's
lookup table. Then the pairs of features whose joint bins explain most of what is left get tables of
their own the same way. A document's score is the sum of its bins' entries, through a logistic.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import batches, column, texts

#: Labelled rows that the model is fitted on at most (those of smallest hash of doc_id); features of so many rows reach the driver.
TRAIN_ROWS = 20_000
#: Of five folds by crc32 of the id, this one is held out.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 48, 12, 10
ROUNDS, PAIR_ROUNDS, RATE = 200, 100, 0.08
#: Least hessian of a leaf, and the ridge added to it.
LEAF, RIDGE = 2.0, 1.0

_SENTENCE, _RUN = re.compile(rb"[.!?]+"), re.compile(rb"(.)\1{2,}", re.S)
_TABLES = [bytes(b in keep for b in range(256)) for keep in (range(65, 91), range(97, 123), range(48, 58), b"#$%&*@^~|<>{}[]=_+\\/", b".,;:!?'\"-()", range(128, 256), b"!", b"|")]

FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "repeated_pairs", "lines", "words_a_line", "repeated_lines", "sentences",
    "upper", "lower", "digits", "marks", "punctuation", "beyond_ascii", "exclamations", "bars", "capital_words", "upper_words", "number_words", "runs", "compression", "word_spread",
)


def features(text: bytes) -> list[float]:
    """Of the whole text; all zero for an empty one."""
    n = len(text)
    words = text.split()
    w = len(words)
    if not w:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=w)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower, digit, mark, point, beyond, bang, bar = (float(hist[k].sum()) for k in _INDEX)
    solid = float(sizes.sum())
    return [
        float(np.log1p(n)), float(np.log1p(w)), solid / w, float((sizes > 12).mean()), float((sizes <= 2).mean()), len(counts) / w, counts.most_common(1)[0][1] / w, 1 - pairs / max(1, w - 1),
        float(np.log1p(len(lines))), w / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(_SENTENCE.findall(text)) / w,
        upper / solid, lower / solid, digit / solid, mark / solid, point / solid, beyond / solid, bang / w, bar / w,
        sum(x[:1].isupper() for x in words) / w, sum(x.isupper() for x in words) / w, sum(x.isdigit() for x in words) / w, len(_RUN.findall(text)) / w, len(zlib.compress(text, 1)) / n, float(sizes.std()),
    ]


_INDEX = [np.flatnonzero(np.frombuffer(t, dtype=np.uint8)) for t in _TABLES]


@dataclass
class Model:
    """cuts by feature; intercept; a table by feature; pairs of features with coarse cuts and tables."""

    cuts: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of the rows of features x: bins are looked up and added."""
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of cutting the bins in two and where (the first bin of the right part); (0, 0) for none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(hl < LEAF) | (h.sum() - hl < LEAF)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1 if gain[k] > 0 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over bins: its value in each."""
    gain, at = _split(g, h) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.r_[_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)]


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one axis, then each part along the other: its gain and its value in each cell."""
    best, value = 0.0, np.full(g.shape, g.sum() / (h.sum() + RIDGE))
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        _, at = _split(a.sum(axis=1), b.sum(axis=1))
        at = at or len(a) // 2
        parts, total = [], -float(_gain(g.sum(), h.sum()))
        for s in (slice(0, at), slice(at, None)):
            gs, hs = a[s].sum(axis=0), b[s].sum(axis=0)
            gain, cut = _split(gs, hs)
            row = _tree(gs, hs, 1)
            parts.append(np.broadcast_to(row, a[s].shape))
            total += gain + float(_gain(gs.sum(), hs.sum()))
        if total > best:
            whole = np.concatenate(parts)
            best, value = total, whole if axis == 0 else whole.T
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting; rows in any order give the same model but for rounding."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        k = x.shape[1]
        return Model([np.zeros(0)] * k, float(np.log(p / (1 - p))), [np.zeros(1)] * k, [], [np.zeros(0)] * k, [])
    k = x.shape[1]
    cuts = [_cuts(x[:, f], BINS) for f in range(k)]
    at = [np.searchsorted(cuts[f], x[:, f], side="right") for f in range(k)]
    p = y.mean()
    intercept = float(np.log(p / (1 - p)))
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(ROUNDS):
        for f in range(k):
            g, h = slopes()
            n = len(tables[f])
            step = RATE * _tree(np.bincount(at[f], g, n), np.bincount(at[f], h, n))
            tables[f] += step
            total += step[at[f]]
    coarse = [_cuts(x[:, f], PAIR_BINS) for f in range(k)]
    cell = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(k)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cell[i] * shape[1] + cell[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h))[0], -i, -j) for i in range(k) for j in range(i + 1, k)), reverse=True)
    pairs = [(-i, -j) for _, i, j in ranked[:PAIRS]]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in enumerate(pairs):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            pair_tables[t] += step
            total += step[cell[i], cell[j]]
    return Model(cuts, intercept, tables, pairs, coarse, pair_tables)


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")) if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled documents outside the held-out fold; null labels and ids are left out.

    Of several labels of an id the mean counts; of several texts one, that of the least features.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id_"), F.col(label_col).cast("double").alias("y_")).dropna().filter(fold("id_") != HELD_OUT)
    chosen = known.groupBy("id_").agg((F.avg("y_") >= 0.5).cast("int").alias("y_")).orderBy(F.xxhash64("id_"), "id_").limit(rows)

    def extract(part: pa.RecordBatch) -> dict:
        return {"id": column(part, "id_"), "y": column(part, "y_"), "x": [features(t) for t in texts(part, "text_")]}

    own = docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].cast("string").alias("text_"))
    # chosen has at most `rows` rows of two numbers; an id that repeats gives one row, so no more reach the driver
    every = batches(own.join(F.broadcast(chosen), "id_").select("id_", "y_", "text_"), extract, "id long, y int, x array<double>")
    got = every.groupBy("id", "y").agg(F.min("x").alias("x")).toPandas().sort_values(["id"], kind="stable")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T[::-1], got["id"].to_numpy()))
    return fit(x[order], got["y"].to_numpy(dtype=np.float64)[order])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row, with the columns named in keep as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed number of bins
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def rate(part: pa.RecordBatch) -> dict:
        s = sent.value.score(np.array([features(t) for t in texts(part, "text__")], dtype=np.float64))
        return {n: column(part, n) for n in keep} | {"id__": column(part, "id__"), "score__": s, "predicted__": (s >= threshold).astype(np.int32)}

    rows = docs.select(*[docs[f"`{n}`"] for n in keep], docs[id_col].cast("long").alias("id__"), docs[text_col].cast("string").alias("text__"))
    return batches(rows, rate, ", ".join([f"`{n}` {kinds[n]}" for n in keep] + ["id__ long, score__ double, predicted__ int"]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out (its fold isn't learned from), score (0 to 1), predicted.

    Null texts count as empty and are scored. A null doc_id is in no fold: held_out is false, and its
    row is never learned from. Without any usable label all scores are the same. Repeated rows are
    scored alike. Other columns are left out. An empty table gives an
    empty result.
    """
    rated = score(docs, train(docs, labels, id_col, text_col, label_col), (), id_col, text_col)
    return rated.select(F.col("id__").alias("doc_id"), F.coalesce(fold("id__") == HELD_OUT, F.lit(False)).alias("held_out"), F.col("score__").alias("score"), F.col("predicted__").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, with their columns, that the classifier doesn't reject."""
    names = tuple(docs.columns)
    return score(docs, train(docs, labels, id_col, text_col, label_col), names, id_col, text_col).filter("predicted__ = 1").select(*[f"`{n}`" for n in names])
