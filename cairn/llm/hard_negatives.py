"""Hard-negative mining (11): slot-decomposed selection.

Each anchor has some positives, its best rows of the same label, and each positive a window of scores
in which negatives are wanted: not too near, not too far. The windows of an anchor overlap. Their
upper limits cut the scores into disjoint slots, and a row of another label falls into one slot. Tiles
of anchors and rows are scored in blocks and keep the first few rows of each slot, which combine over
tiles like any top-k. Slots of an anchor in descending order are one descending list: a window's answer
is the head of the list from its own slot on, down to its lower limit. So each row is met once, however
many windows hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, dealt_join, saved
from cairn.llm.vectors import SCALE, SLICE, best, dealt, first_of_each, matrix, numbers, products, scaled

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of its positive's.
LOW, HIGH = 30, 90
#: Anchors and rows of a tile, on average.
ANCHOR_ROWS, TILE_ROWS = 512, 8_192


def hundredths(part: Column) -> Column:
    """The largest whole number that is at most part / 100; in whole numbers, as a quotient of doubles would round large ones."""
    return F.call_function("div", part - F.pmod(part, F.lit(100)), F.lit(100))


def positive_tile(anchors: pa.Table, rows: pa.Table, k: int = POSITIVES) -> pa.Table:
    """anchor_id, score, vec_id: the first k rows of each anchor, without those of its own id."""
    own, width = anchors["anchor_id"].to_numpy(), widest(anchors, rows)
    q, out = matrix(anchors["vector"], width), []
    for low in range(0, rows.num_rows, SLICE):
        part = rows.slice(low, SLICE)
        ids = part["vec_id"].to_numpy()
        s = products(q, matrix(part["vector"], width))
        i, j = best(s, ids, own[:, None] != ids[None, :], k)
        out.append((i, s[i, j], ids[j]))
    i, score, ids = (np.concatenate([x[c] for x in out]) if out else np.zeros(0, dtype=np.int64) for c in range(3))
    keep = first_of_each(i, score, ids, k)
    return pa.table({"anchor_id": own[i[keep]], "score": score[keep], "vec_id": ids[keep]})


def slots(uppers: np.ndarray) -> np.ndarray:
    """Distinct upper limits, ascending: a score belongs to the slot of the least limit that it doesn't exceed."""
    return np.unique(uppers)


def slot_tile(anchors: pa.Table, rows: pa.Table, k: int = NEGATIVES) -> pa.Table:
    """anchor_id, top (the slot's upper limit), score, vec_id: the first k rows of other labels in each slot of each anchor."""
    width = widest(anchors, rows)
    if not anchors.num_rows:
        return pa.table({c: np.zeros(0, dtype=np.int64) for c in ("anchor_id", "top", "score", "vec_id")})
    q, own, label = matrix(anchors["vector"], width), anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
    limits = [slots(np.array(x, dtype=np.int64)) for x in anchors["uppers"].to_pylist()]
    begins = np.cumsum([0, *(len(x) for x in limits)])  # slots are numbered over all anchors of the tile
    lows, tops = anchors["low"].to_numpy(), np.array([x[-1] for x in limits], dtype=np.int64)
    out = []
    for at in range(0, rows.num_rows, SLICE):
        part = rows.slice(at, SLICE)
        ids, s = part["vec_id"].to_numpy(), products(q, matrix(part["vector"], width))
        wanted = (s <= tops[:, None]) & (s >= lows[:, None]) & (label[:, None] != part["label"].to_numpy()[None, :])
        for i in np.flatnonzero(wanted.any(axis=1)):
            j = np.flatnonzero(wanted[i])
            slot = np.searchsorted(limits[i], s[i, j])
            keep = first_of_each(slot, s[i, j], ids[j], k)
            out.append((slot[keep] + begins[i], s[i, j[keep]], ids[j[keep]]))
    slot, score, ids = (np.concatenate([x[c] for x in out]) if out else np.zeros(0, dtype=np.int64) for c in range(3))
    keep = first_of_each(slot, score, ids, k)
    whose = np.repeat(own, [len(x) for x in limits])
    return pa.table({"anchor_id": whose[slot[keep]], "top": np.concatenate(limits)[slot[keep]], "score": score[keep], "vec_id": ids[keep]})


def widest(*tables: pa.Table) -> int:
    return max([0, *(int(n) for t in tables for n in t["vector"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0, keepdims=True))])


def combined(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows (score, vec_id) of each key; cut before the shuffle too."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id"))
    return rows.withColumn("nth_", F.row_number().over(order)).filter(F.col("nth_") <= k)


def positives(anchors: DataFrame, rows: DataFrame, scratch: Scratch, k: int = POSITIVES, anchor_rows: int = ANCHOR_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """anchor_id, score, vec_id, nth_: the first k rows of each anchor's label. A label's anchors and rows are dealt into tiles by their numbers, so a hot label has many."""
    asked = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("asked"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("held")).join(asked, "label")
    sizes = scratch.save(sizes.select("label", "held", "asked", F.ceil(F.col("asked") / anchor_rows).alias("blocks"), F.ceil(F.col("held") / tile_rows).alias("chunks")))
    left = dealt_join(anchors, sizes, "label", "asked", ["anchor_id"]).select("label", dealt(["anchor_id"], F.col("blocks")).alias("block"), F.explode(numbers(F.col("chunks"))).alias("chunk"), "anchor_id", "vector")
    right = dealt_join(rows, sizes, "label", "held", ["vec_id", "vector"]).select(F.col("label").alias("l"), F.explode(numbers(F.col("blocks"))).alias("b"), dealt(["vec_id", "vector"], F.col("chunks")).alias("c"), "vec_id", "vector")

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        return positive_tile(a, b, k)

    met = left.groupBy("label", "block", "chunk").cogroup(right.groupBy("l", "b", "c")).applyInArrow(tile, "anchor_id long, score long, vec_id long")
    return combined(met, ["anchor_id"], k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, k_positives: int = POSITIVES, k_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, anchor_rows: int = ANCHOR_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """For each anchor and positive the first negatives of its window: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: rows with the same columns, mostly some of rows. Scores are inner products of scaled,
    floored components; higher ones come first, of equal ones the smaller id. An anchor's positives are
    its first k_positives rows of the same label; rows with its own id are never met. A negative has
    another label and low * positive <= 100 * negative <= high * positive, so the window of a negative
    positive_score is empty. Rows take no part without an id or a label (a whole number), without a
    vector, or with a component that is null, not finite or beyond 65,536. Shorter vectors count as
    filled with zeros. A repeated row is a row of its own; an anchor id that repeats is one anchor, of
    the least label and vector. Anchors without a positive or a negative have no row; neither have
    empty tables. Other columns are left out.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    clean = lambda df: df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].cast("long").alias("label"), scaled(df, vector_col, scale).alias("vector")).dropna()
    try:
        own = scratch.save(clean(rows))
        asked = clean(anchors).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "vector")).alias("x")).select("anchor_id", "x.label", "x.vector")
        asked = scratch.save(asked)
        near = scratch.save(positives(asked, own, scratch, k_positives, anchor_rows, tile_rows).withColumns({"upper": hundredths(high * F.col("score")), "lower": -hundredths(-low * F.col("score"))}))
        windows = near.filter("lower <= upper").groupBy("anchor_id").agg(F.collect_list("upper").alias("uppers"), F.min("lower").alias("low"))  # k_positives at most
        aimed = scratch.save(asked.join(windows, "anchor_id"))
        n, m = own.count(), aimed.count()
        blocks, chunks = max(1, -(-m // anchor_rows)), max(1, -(-n // tile_rows))
        left = aimed.select(dealt(["anchor_id"], blocks).alias("block"), F.explode(numbers(chunks)).alias("chunk"), "anchor_id", "label", "vector", "uppers", "low")
        right = own.select(F.explode(numbers(blocks)).alias("b"), dealt(["vec_id", "vector"], chunks).alias("c"), "vec_id", "label", "vector")

        def tile(a: pa.Table, b: pa.Table) -> pa.Table:
            return slot_tile(a, b, k_negatives)

        met = left.groupBy("block", "chunk").cogroup(right.groupBy("b", "c")).applyInArrow(tile, "anchor_id long, top long, score long, vec_id long")
        kept = combined(met, ["anchor_id", "top"], k_negatives)
        # a few rows a slot, a few slots an anchor: one descending list
        lists = kept.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("vec_id").alias("id")))).alias("list"))
        suffix = F.slice(F.filter("list", lambda x: -x["less"] <= F.col("upper")), 1, k_negatives)
        heads = near.join(lists, "anchor_id").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(F.filter(suffix, lambda x: -x["less"] >= F.col("lower"))).alias("at", "x"))
        return saved(heads.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.less")).alias("negative_score")))
    finally:
        scratch.drop()
