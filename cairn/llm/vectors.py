"""Integer vectors and exact scores in blocks, shared by hard-negative mining and top-k search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Scaled components lie within this bound, so that a score of up to 32,768 components fits 64 bits.
LARGEST = 1 << 24
#: Rows of a matrix product, at most: the other side of it is a tile's queries.
SLICE = 2_048


def scaled(rows: DataFrame, vector_col: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as array<int>; null for a vector that is null or has a component that is null, not finite or beyond LARGEST."""
    x = rows[vector_col].cast("array<double>")
    fits = F.forall(x, lambda c: F.coalesce(F.abs(c) * scale < LARGEST, F.lit(False)))  # NaN is above every number
    return F.when(fits, F.transform(x, lambda c: F.floor(c * float(scale)).cast("int")))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A row of numbers for each vector, shorter ones filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with all of v, exact: by floating point where no sum can reach 2**53."""
    most = lambda m: int(np.abs(m).max(initial=0))
    if most(q) * most(v) * max(1, q.shape[1]) < 1 << 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each group, by higher score, then smaller id; in order of group and rank."""
    order = np.lexsort((ids, -score, group))
    own = group[order]
    begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(own)) - np.repeat(begins, np.diff(np.r_[begins, len(own)]))
    return order[nth < k]


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k allowed columns of each row of scores: rows and columns, ties to the smaller id."""
    rows, columns = [], []
    for at in range(0, len(scores), 64):  # a slice of rows, as all columns of a row may tie
        s = np.where(allowed[at : at + 64], scores[at : at + 64], np.iinfo(np.int64).min)
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), np.iinfo(np.int64).min)
        i, j = np.nonzero((s >= least[:, None]) & allowed[at : at + 64])
        keep = first_of_each(i, s[i, j], ids[j], k)
        rows.append(i[keep] + at)
        columns.append(j[keep])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return join(rows), join(columns)


def dealt(key: list[str], n: Column | int) -> Column:
    """A number below n by a hash of key."""
    return F.pmod(F.xxhash64(*key), n if isinstance(n, Column) else F.lit(n)).cast("int")


def numbers(n: Column | int) -> Column:
    """The numbers below n as an array."""
    return F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)).cast("int") - 1)
