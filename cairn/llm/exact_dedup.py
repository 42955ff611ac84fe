"""Exact dedup (2): a minimal perfect hash over historical distinct digests.

Texts are equal when their bytes are, white space removed; the digest is SHA-256. The history (rows
seen earlier) is reduced to its distinct digests; those are dealt into shards by digest, and each
shard gets a minimal perfect hash: levels of bit arrays, a key's slot being the rank of its bit. A slot
holds the full digest and the locator of the winner so far. New rows are reduced to one row per
distinct digest before they are looked up, so a hot group costs one lookup. A slot counts only if
its digest equals the looked-up one byte by byte. Nonmembers form groups of their own.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE, batches, column, dealt_join, mix64, partitions, saved, texts

#: Distinct digests that a shard is laid out for.
SHARD_KEYS = 65_536


class PerfectHash:
    """A minimal perfect hash over distinct 32-byte keys: slots are 0..n-1, each used once."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.r_[0, np.cumsum(x)] for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: (n, 32) bytes, distinct."""
        word = _words(keys)
        levels, left = [], np.arange(len(keys))
        while len(left):
            at = _place(word[left], len(levels), len(left))
            bits = np.bincount(at, minlength=len(left)) == 1
            levels.append(bits)
            left = left[~bits[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where a key is certainly no member. A member has its own slot; a nonmember may get any."""
        word = _words(keys)
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = _place(word[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def _words(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view("<u8").reshape(len(keys), 4) if len(keys) else np.zeros((0, 4), dtype=np.uint64)


def _place(word: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bits in which a level places keys; every word of the digest counts from the second on."""
    seed = mix64(word[:, level % 4], level) ^ mix64(word[:, (level + 1) % 4], level + 7919)
    return (seed % np.uint64(max(1, size))).astype(np.int64)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in digests), dtype=np.uint8).reshape(len(digests), 32)


class Shard:
    """One shard of the index: a perfect hash; slots of full digests, winners and group sizes."""

    def __init__(self, rows: pd.DataFrame):
        keys = _keys(rows["digest"])
        self.hash = PerfectHash.build(keys)
        slot = self.hash.slots(keys)
        self.digest = np.zeros((len(keys), 32), dtype=np.uint8)
        self.digest[slot] = keys
        self.row = np.zeros(len(keys), dtype=np.int64)
        self.row[slot] = np.arange(len(keys))

    def lookup(self, digests: pd.Series) -> np.ndarray:
        """Row in the history of each digest, -1 for nonmembers; the digest in the slot is compared byte by byte."""
        keys = _keys(digests)
        if not len(self.row) or not len(keys):
            return np.full(len(keys), -1, dtype=np.int64)
        slot = self.hash.slots(keys)
        same = (slot >= 0) & (self.digest[slot] == keys).all(axis=1)
        return np.where(same, self.row[slot], -1)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest (32 bytes) of every row; null is empty."""

    def sign(part: pa.RecordBatch) -> dict:
        own = texts(part, "text_")
        return {
            "doc_id": column(part, "id_"),
            "n_chars": [len(t.decode("utf-8", "replace")) for t in own],
            "digest": [hashlib.sha256(t.translate(None, SPACE)).digest() for t in own],
        }

    return batches(docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].cast("string").alias("text_")), sign, "doc_id long, n_chars long, digest binary")


def grouped(signed: DataFrame) -> DataFrame:
    """One row per digest: winner (most code points, then smallest doc_id, null last), n_chars, n. Combined on the map side."""
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("winner")))
    return signed.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select("digest", F.col("best.winner").alias("winner"), (-F.col("best.less")).alias("n_chars"), "n")


def merged(history: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """Groups of history and new (as grouped() gives them) as one table, by lookups in the history's index."""
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    columns = ["digest", "winner", "n_chars", "n"]

    def look(old: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        old, now = old[columns].reset_index(drop=True), now[columns].reset_index(drop=True)
        index = Shard(old)
        row = index.lookup(now["digest"])
        known = now[row >= 0].assign(row=row[row >= 0])
        if len(known):
            mine = old.loc[known["row"]].reset_index(drop=True)
            known = known.reset_index(drop=True)
            ahead = (known["n_chars"] > mine["n_chars"]) | ((known["n_chars"] == mine["n_chars"]) & (known["winner"].notna() & (mine["winner"].isna() | (known["winner"] < mine["winner"]).fillna(False))))
            at = known.loc[ahead.astype(bool), "row"]
            old.loc[known["row"], "n"] = (mine["n"] + known["n"]).to_numpy()
            for c in ("winner", "n_chars"):
                old.loc[at, c] = known.loc[ahead.astype(bool), c].to_numpy()
        return pd.concat([old, now[row < 0]], ignore_index=True)

    # both sides may come from one checkpoint: fresh names for the columns of the second
    new = new.select(*[F.col(c).alias(c + "_new") for c in columns]).toDF(*columns)
    return history.withColumn("shard", shard).groupBy("shard").cogroup(new.withColumn("shard", shard).groupBy("shard")).applyInPandas(_typed(look), "digest binary, winner long, n_chars long, n long")


def _typed(fn):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # a group that only one side has comes without columns on the other
        return fn(*[x.reindex(columns=["digest", "winner", "n_chars", "n"]).astype({"winner": "Int64", "n_chars": "int64", "n": "int64"}) for x in (a, b)])

    return run


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space).

    history: earlier rows with the same columns; they take part in groups and may win, but get no
    row. Without it the rows of even hash of docs are indexed first, as history, and the others are
    looked up: both halves get rows. Null texts are empty texts and equal each other. Of repeated
    rows with one doc_id, each counts in group_size and each has kept true where its doc_id wins.
    Other columns are left out. An empty table gives an empty result.
    """
    if history is None:
        own = saved(signatures(docs, id_col, text_col))
        early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
        old, new = own.filter(early), own.filter(~early)
    else:
        own = new = saved(signatures(docs, id_col, text_col))
        old = signatures(history, id_col, text_col)
    shards = max(partitions(docs.sparkSession), -(-own.count() // SHARD_KEYS))
    groups = merged(grouped(old), grouped(new), shards)
    # Only repeated digests travel to the rows; a row without one is its own group.
    several = saved(groups.filter("n > 1").select("digest", "winner", "n"))
    kept = F.coalesce(F.col("winner"), F.col("doc_id"))
    return dealt_join(own, several, "digest", "n", ["doc_id", "n_chars"], "left").select(
        "doc_id", kept.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(kept).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
