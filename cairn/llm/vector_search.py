"""Exact top-k search (12): a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance from it, sorted by that key and cut into
annuli of bounded size. Inner products become distances by one more component, which gives all vectors
the same norm: the nearer, the higher the score. A query first meets the annulus that it would lie in
itself, which bounds the distance of its k-th best. Then blocks of queries meet further annuli in the
order of the least distance that the triangle inequality allows, more in each round, and stop where it
exceeds the bound of all queries of the block. Within an annulus a query looks only at the rows whose
distance from the pivot differs from its own by no more than its bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, column, dealt_join, partitions, saved
from cairn.llm.vectors import SCALE, best, dealt, first_of_each, matrix, numbers, products, scaled

K = 5
#: Rows that pivots are fitted on (those of smallest hash), pivots at most, and rounds of their fitting.
SAMPLE, PIVOTS, FITS = 4_096, 64, 6
#: Rows of an annulus, queries of a block, and rows of a range that one task sorts, at most or on average.
ANNULUS, BLOCK, RANGE_ROWS = 4_096, 1_024, 100_000
#: Annuli that a block of queries meets in the first round; each further round meets GROWTH times as many in all.
FIRST, GROWTH = 8, 8
#: Distances are told apart to this share of the largest norms; bounds give way by as much.
SLACK = 1e-6


@dataclass
class Space:
    """What tasks need: the width of vectors, the square of the largest norm, and pivots with one component more."""

    width: int
    most: float
    pivots: np.ndarray

    @property
    def slack(self) -> float:
        return SLACK * (1 + self.most**0.5 + float(np.sqrt((self.pivots**2).sum(axis=1)).max(initial=0)))

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Rows with a component more, after which all have the largest norm."""
        v = vectors.astype(np.float64)
        return np.column_stack([v, np.sqrt(np.maximum(0, self.most - (v * v).sum(axis=1)))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Of each point from each pivot."""
        square = (points * points).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of queries, which have nothing in the further component, from each pivot."""
        return self.distances(np.column_stack([vectors.astype(np.float64), np.zeros(len(vectors))]))


def fitted(points: np.ndarray, pivots: int, rounds: int = FITS) -> np.ndarray:
    """Centres of the points: the farthest from those before, moved to the mean of what is nearest, some rounds."""
    centres = points[:1]
    apart = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(pivots, len(points)) and apart.max(initial=0) > 0:
        centres = np.vstack([centres, points[apart.argmax()]])
        apart = np.minimum(apart, ((points - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        at = Space(0, 0, centres).distances(points).argmin(axis=1)
        held = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, points)
        centres = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centres)
    return centres


class PivotIndex:
    """Annuli of vectors (vec_id, vector): rows with cell, pivot, dist; and cells with the least and largest distance of each."""

    def __init__(self, vectors: DataFrame, scratch: Scratch, pivots: int = PIVOTS, annulus: int = ANNULUS, range_rows: int = RANGE_ROWS):
        self.scratch, self.spark = scratch, vectors.sparkSession
        square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c.cast("long"))
        whole = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(square).alias("most")).first()
        self.n, width = whole["n"], whole["width"] or 0
        some = vectors.select("vector", F.xxhash64("vec_id", "vector").alias("h")).orderBy("h", "vector").limit(SAMPLE).toArrow()  # SAMPLE rows
        self.space = Space(width, float(whole["most"] or 0), np.zeros((1, width + 1)))
        if self.n:
            self.space.pivots = fitted(self.space.lifted(matrix(some["vector"], width)), max(1, min(pivots, 256, int(self.n**0.5 / 4))))
        self._deal(vectors, annulus, max(1, -(-self.n // range_rows)))

    def _deal(self, vectors: DataFrame, annulus: int, ranges: int) -> None:
        space = self.space

        def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                d = space.distances(space.lifted(matrix(column(part, "vector"), space.width)))
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([column(part, "vec_id"), column(part, "vector"), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], names=["vec_id", "vector", "pivot", "dist"])

        order = ["pivot", "dist", "vec_id", "vector"]
        rows = vectors.select("vec_id", "vector").mapInArrow(keyed, "vec_id long, vector array<int>, pivot int, dist double")
        ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

        def numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = TaskContext.get().partitionId() << 32, 0
            for part in parts:
                cell = own + ((seen + np.arange(part.num_rows)) // annulus << 8) + column(part, "pivot").to_numpy()  # 256 pivots at most
                seen += part.num_rows
                yield part.append_column("cell", pa.array(cell.astype(np.int64)))

        self.rows = self.scratch.save(ranged.mapInArrow(numbered, "vec_id long, vector array<int>, pivot int, dist double, cell long"))
        self.cells = self.scratch.save(self.rows.groupBy("cell", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count(F.lit(1)).alias("n")))

    def search(self, queries: DataFrame, k: int = K, block: int = BLOCK, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
        """query_id, rank, vec_id, score: the first k rows of each query (query_id, vector), those of its own id left out."""
        asked = self._asked(queries, block)
        asked, top = self._bounded(asked, self._home(asked, k, block), k), None
        blocks = self.scratch.save(asked.select("block", F.posexplode("dists").alias("pivot", "dist")).groupBy("block", "pivot").agg(F.min("dist").alias("near"), F.max("dist").alias("far")))
        grid, met, reach = None, 0, first
        while True:
            bound = self.scratch.save(asked if top is None else self._bounded(asked, top, k), "bound")
            most = bound.groupBy("block").agg(F.max("radius").alias("radius"))
            if grid is None:
                grid = self.scratch.save(self._grid(blocks, most))
            tiles = self.scratch.save(grid.join(most, "block").filter((F.col("nth") > met) & (F.col("nth") <= reach) & (F.col("gap") <= F.col("radius"))).select("block", "cell"), "tiles")
            if not tiles.isEmpty():
                found = self._scored(bound, tiles, k)
                top = self.scratch.save(self._merged(found if top is None else top.unionByName(found), k), f"top{reach}")
            # gaps ascend with nth: what a block's bound excludes in one round stays excluded
            if grid.join(most, "block").filter((F.col("nth") > reach) & (F.col("gap") <= F.col("radius"))).isEmpty():
                top = self.spark.createDataFrame([], "query_id long, score long, vec_id long") if top is None else top
                return top.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).cast("int").alias("rank"), "vec_id", "score")
            met, reach = reach, reach * growth

    def _asked(self, queries: DataFrame, block: int) -> DataFrame:
        """Queries with their distances from the pivots, in blocks of neighbours; of the rows of one id the least vector."""
        space = self.space
        single = queries.groupBy("query_id").agg(F.min("vector").alias("vector"))

        def measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                q = matrix(column(part, "vector"), max(space.width, int(column(part, "vector").value_lengths().to_numpy(zero_copy_only=False).max(initial=0))))
                d = space.of_queries(q[:, : space.width])
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([column(part, "query_id"), column(part, "vector"), pa.array(list(d)), pa.array((q * q).sum(axis=1)), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], names=["query_id", "vector", "dists", "square", "pivot", "dist"])

        kind = "query_id long, vector array<int>, dists array<double>, square long, pivot int, dist double"
        own = self.scratch.save(single.mapInArrow(measured, kind))
        ranged = own.repartitionByRange(max(1, -(-own.count() // RANGE_ROWS)), "pivot", "dist", "query_id").sortWithinPartitions("pivot", "dist", "query_id")

        def numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = TaskContext.get().partitionId() << 32, 0
            for part in parts:
                at = own + (seen + np.arange(part.num_rows)) // block
                seen += part.num_rows
                yield part.append_column("block", pa.array(at.astype(np.int64)))

        return self.scratch.save(ranged.mapInArrow(numbered, kind + ", block long"))

    def _home(self, asked: DataFrame, k: int, block: int) -> DataFrame:
        """The first k rows in the annulus that the query itself would lie in, which bound its answer."""
        salts = partitions(self.spark)  # the queries of a pivot are dealt; each part sees the ends of all its annuli
        ends = self.cells.select("pivot", F.explode(numbers(salts)).alias("salt"), "cell", F.explode(F.array("low", "high")).alias("at"))
        line = asked.select("pivot", dealt(["query_id"], salts).alias("salt"), F.col("dist").alias("at"), "query_id", F.lit(None).cast("long").alias("cell")).unionByName(ends.withColumn("query_id", F.lit(None).cast("long")))
        # the last end at or before the query in the order of distances, or else the first behind it
        along = Window.partitionBy("pivot", "salt").orderBy("at", F.col("query_id").asc_nulls_first(), "cell")
        before, after = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(0, Window.unboundedFollowing)
        homes = line.withColumn("home", F.coalesce(F.last("cell", True).over(before), F.first("cell", True).over(after))).filter("query_id is not null and home is not null").select("query_id", F.col("home").alias("cell"))
        homes = self.scratch.save(homes)
        asks = self.scratch.save(homes.groupBy("cell").agg(F.count(F.lit(1)).alias("asks")))
        parts = F.ceil(F.col("asks") / block)
        left = asked.join(dealt_join(homes, asks, "cell", "asks", ["query_id"]).withColumn("part", dealt(["query_id"], parts)), "query_id")
        left = left.select("cell", "part", "query_id", "vector", "dists", F.lit(None).cast("long").alias("least"), F.lit(None).cast("double").alias("radius"))
        right = self.rows.join(asks, "cell").select(F.col("cell").alias("c"), F.explode(numbers(parts)).alias("p"), "vec_id", "vector", "pivot", "dist")
        return self.scratch.save(left.groupBy("cell", "part").cogroup(right.groupBy("c", "p")).applyInArrow(self._tile(k), "query_id long, score long, vec_id long"))

    def _bounded(self, asked: DataFrame, top: DataFrame, k: int) -> DataFrame:
        """asked with least, the best score that some k rows of a query reach, and radius, the distance that it stands for; infinite while there are fewer."""
        held = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("score"))
        known = [F.col("least")] if "least" in asked.columns else []
        now = F.when(F.col("held") >= k, F.col("score"))
        least = F.greatest(now, *known) if known else now  # of those that are not null
        square = F.col("square") + F.lit(self.space.most) - 2.0 * F.col("least")
        radius = F.when(F.col("least").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), square)) + self.space.slack).otherwise(float("inf"))
        return asked.join(held, "query_id", "left").withColumn("least", least).withColumn("radius", radius).drop("held", "score")

    def _grid(self, blocks: DataFrame, most: DataFrame) -> DataFrame:
        """block, cell, gap, nth: annuli in reach of a block, by the least distance that the triangle inequality allows."""
        salts = partitions(self.spark)  # a pivot may have many annuli and all blocks
        left = blocks.join(most, "block").withColumn("salt", dealt(["block"], salts))
        right = self.cells.withColumn("salt", F.explode(numbers(salts)))
        gap = F.greatest(F.lit(0.0), F.col("low") - F.col("far"), F.col("near") - F.col("high"))
        met = left.join(right, ["pivot", "salt"]).withColumn("gap", gap).filter(F.col("gap") <= F.col("radius"))
        middle = F.abs(F.col("low") + F.col("high") - F.col("near") - F.col("far"))
        return met.select("block", "cell", "gap", F.row_number().over(Window.partitionBy("block").orderBy("gap", middle, "cell")).alias("nth"))

    def _scored(self, bound: DataFrame, tiles: DataFrame, k: int) -> DataFrame:
        left = bound.join(tiles, "block").select("cell", "block", "query_id", "vector", "dists", "least", "radius")
        right = self.rows.join(tiles.hint("merge"), "cell").select(F.col("cell").alias("c"), F.col("block").alias("b"), "vec_id", "vector", "pivot", "dist")
        return left.groupBy("cell", "block").cogroup(right.groupBy("c", "b")).applyInArrow(self._tile(k), "query_id long, score long, vec_id long")

    def _tile(self, k: int):
        width, slack = self.space.width, self.space.slack
        return lambda q, rows: tile(q, rows, k, width, slack)

    def _merged(self, rows: DataFrame, k: int) -> DataFrame:
        """The first k of each query; cut before the shuffle too."""
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return rows.withColumn("nth_", F.row_number().over(order)).filter(F.col("nth_") <= k).drop("nth_")


def tile(q: pa.Table, rows: pa.Table, k: int, width: int, slack: float) -> pa.Table:
    """query_id, score, vec_id: the first k rows of an annulus for each query that its bound lets in."""
    none = pa.table({c: np.zeros(0, dtype=np.int64) for c in ("query_id", "score", "vec_id")})
    if not q.num_rows or not rows.num_rows:
        return none
    dist, pivot = rows["dist"].to_numpy(), rows["pivot"][0].as_py()
    own = np.array([d[pivot] for d in q["dists"].to_pylist()])
    reach = np.nan_to_num(q["radius"].to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf) + slack
    ask = np.flatnonzero((own - reach <= dist.max()) & (own + reach >= dist.min()))
    if not len(ask):
        return none
    ids, q_ids = rows["vec_id"].to_numpy(), q["query_id"].to_numpy()[ask]
    least = q["least"].fill_null(np.iinfo(np.int64).min).to_numpy()[ask]
    wide = max(width, int(q["vector"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)))
    v, asked, out = matrix(rows["vector"], wide), matrix(q["vector"], wide)[ask], []
    for at in range(0, len(ask), 256):
        now = slice(at, at + 256)
        s = products(asked[now], v)
        near = np.abs(dist[None, :] - own[ask][now][:, None]) <= reach[ask][now][:, None]
        i, j = best(s, ids, near & (s >= least[now][:, None]) & (q_ids[now][:, None] != ids[None, :]), k)
        out.append((q_ids[now][i], s[i, j], ids[j]))
    return pa.table({n: np.concatenate([x[c] for x in out]) for c, n in enumerate(("query_id", "score", "vec_id"))})


def top_k_search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, annulus: int = ANNULUS, block: int = BLOCK) -> DataFrame:
    """The k rows of highest score of each query: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    queries: rows with the same columns, mostly some of rows; rows with a query's own id are never its
    answers. Scores are inner products of scaled, floored components. Pivots are fitted on a bounded
    sample; every row is in the index, and the answer is exact. Rows take no part without an id or a
    vector, or with a component that is null, not finite or beyond 65,536. Shorter vectors count as
    filled with zeros. A repeated row is a row of its own; a query id that repeats is one query, of the
    least vector. A query without other rows has no answer; neither have empty tables. Other columns are
    left out.
    """
    scratch = Scratch(rows.sparkSession)
    clean = lambda df, name: df.select(df[id_col].cast("long").alias(name), scaled(df, vector_col, scale).alias("vector")).dropna()
    try:
        index = PivotIndex(scratch.save(clean(rows, "vec_id")), scratch, pivots, annulus)
        return saved(index.search(clean(queries, "query_id"), k, block))
    finally:
        scratch.drop()
