"""Mixing sources to target weights (8): blocks, multinomial counts per shard, permuted indexes.

The words of a source, its documents in a fixed order, are packed into blocks of a fixed number of
words. The mix is a list of slots, dealt into output shards: how many of a source's slots each shard
gets is a multinomial draw with equal odds, made in the tasks that make the slots, a chunk of slots at
a time. So each source's total meets its target, and shards vary as independent draws do. A source's
j-th slot takes the block that a pseudorandom permutation of the source's block indexes gives for j;
when all blocks are taken the next round uses another permutation, so none is taken more often than
another by over one. Slots and blocks meet in a join by source and block index, a key without hot
values. Sources are rows of a table throughout: their ranks and the level at which targets stop come
from running totals over ranges of them, and nothing about a source reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import batches, column, mix64, partitions, saved, scope, summed_before, texts

#: Words of a block. Targets are met to within about half of it for each source.
BLOCK_WORDS = 32
#: Slots of an output shard, on average.
SHARD_SLOTS = 16_384
#: Slots of a chunk, whose counts by shard are one draw.
CHUNK_SLOTS = 65_536
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2.0
#: Rows of a source that are put in order in one task.
CHUNK_ROWS = 20_000
#: Sources that may be broadcast (some 100 bytes each); more are met by a shuffle, SALTS copies of each.
BROADCAST_SOURCES, SALTS = 200_000, 64


def weighed(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """sources (source, size) with k (its rank by code point, null last), weight and target.

    Targets share total times all sizes by weight (repeating in the order of k), most times its size at
    most; the excess is shared again by weight until none is above. So a source gets level * weight or
    most * size, whichever is less. Sources that stop have the least size for their weight: in that
    order, level is what the sources from one on would share if all before it stopped, at the first
    source that it doesn't fill.
    """
    odds = F.array(*[F.lit(w) for w in weights])
    whole = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n")).first()
    ranked = summed_before(sources.withColumn("one_", F.lit(1)), [F.col("source").asc_nulls_last()], ["one_"], whole["n"]).withColumnRenamed("one__before", "k")
    ranked = ranked.withColumn("weight", F.element_at(odds, (F.col("k") % len(weights) + 1).cast("int"))).withColumn("full_", most * F.col("size") / F.col("weight"))
    before = summed_before(ranked.select("k", "size", "weight", "full_"), [F.col("full_").asc(), F.col("k").asc()], ["size", "weight"], whole["n"])
    rounds, rest = divmod(whole["n"], len(weights))
    share = (total * whole["size"] - most * F.col("size_before")) / (rounds * sum(weights) + sum(weights[:rest]) - F.col("weight_before"))
    level = before.withColumn("share_", share).filter("share_ <= full_").agg(F.min_by("share_", F.struct("full_", "k")).alias("level")).first()["level"]
    stop = most * F.col("size")
    target = stop if level is None else F.least(F.lit(level) * F.col("weight"), stop)
    return ranked.select("source", "k", "size", "weight", target.cast("double").alias("target"))


def permute(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each seed: four Feistel rounds, walked until inside. Arrays of one length."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, x = half[todo], mask[todo], out[todo]
        left, right = x >> h, x & m
        for k in range(4):
            left, right = right, left ^ (mix64(right ^ mix64(seed[todo], 5), k) & m)
        x = (left << h) | right
        out[todo] = x
        todo = todo[x >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def slot_count(block: int = BLOCK_WORDS, most: float = MOST) -> Column:
    """Slots of a source (size, blocks, target): the words they take are as near the target as whole blocks get, each block at most `most` times."""
    rounds = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0))
    rest = F.when(F.col("size") > 0, F.round((F.col("target") - rounds * F.col("size")) * F.col("blocks") / F.col("size"))).otherwise(F.lit(0.0))
    return F.least(rounds * F.col("blocks") + rest.cast("long"), int(most) * F.col("blocks")).cast("long")


def shard_counts(n: int, shards: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """How many of n slots go to each shard, a multinomial draw with equal odds: the shards that get any, and their counts."""
    if shards > 4 * n:  # the same draw slot by slot, as most shards get none
        return np.unique(rng.integers(shards, size=n), return_counts=True)
    counts = rng.multinomial(n, np.full(shards, 1 / shards))
    at = np.flatnonzero(counts)
    return at, counts[at]


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    def count(part: pa.RecordBatch) -> dict:
        return {"doc_id": column(part, "id_"), "source": column(part, "source_"), "size": [len(t.split()) for t in texts(part, "text_")], "tie": [hash64(t) for t in texts(part, "text_")]}

    rows = docs.select(docs[id_col].cast("long").alias("id_"), docs[source_col].cast("string").alias("source_"), docs[text_col].cast("string").alias("text_"))
    return batches(rows, count, "doc_id long, source string, size long, tie long")


def hash64(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def streams(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows with start: the words before the document in its source. A source's order is by hashed chunk, then id; chunks are summed first, so a hot source has many tasks."""
    chunks = max(1, -(-n_rows // CHUNK_ROWS), partitions(rows.sparkSession))
    keyed = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)))
    per = keyed.groupBy("k", "chunk").agg(F.sum("size").alias("words"))
    before = per.select("k", "chunk", (F.sum("words").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("before"))
    within = F.sum("size").over(Window.partitionBy("k", "chunk").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return keyed.withColumn("within", within).join(before, ["k", "chunk"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "chunk")


class Mix:
    """The outcome of a mix as DataFrames: sources, documents and slots."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, broadcast_sources: int = BROADCAST_SOURCES):
        self.spark, self.block, self.seed = docs.sparkSession, block, seed
        rows = saved(sized(docs, id_col, text_col, source_col))
        with scope(self.spark):
            found = saved(rows.groupBy("source").agg(F.sum("size").alias("size")))
            own = weighed(found, weights, total, most).withColumn("blocks", F.ceil(F.col("size") / block))
            self.sources = saved(own.withColumn("slots", slot_count(block, most)), keep=True)
        whole = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"), F.count(F.lit(1)).alias("n")).first()
        few, self.total = whole["n"] <= broadcast_sources, whole["slots"]
        self.shards = max(1, -(-self.total // shard_slots))
        self.documents = streams(self._with_source(rows, few), rows.count())

    def _with_source(self, rows: DataFrame, few: bool) -> DataFrame:
        one = self.sources.select(F.col("source").alias("s_"), "k", F.col("size").alias("source_size"), "target")
        same = F.col("source").eqNullSafe(F.col("s_"))
        if few:
            return rows.join(F.broadcast(one), same).drop("s_")
        # the rows of a hot source are dealt over many tasks, each of which gets a copy of the source's row
        many = one.withColumn("copy_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS)).cast("int")).join(many.hint("merge"), same & (F.col("salt_") == F.col("copy_"))).drop("s_", "salt_", "copy_")

    def slots(self) -> DataFrame:
        """One row per slot of the mix: shard, k (the source's number), block (its index) and round."""
        seed, shards = self.seed, self.shards
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK_SLOTS))).alias("chunk")
        plan = self.sources.filter("slots > 0").select("k", "blocks", "slots", chunk)
        plan = plan.repartition(max(partitions(self.spark), -(-self.total // (16 * CHUNK_SLOTS))), "k", "chunk")

        def made(rows: list[tuple[int, int, int, int]]) -> pd.DataFrame:
            k, blocks, first, n, shard = [], [], [], [], []
            for own, of, slots, at in rows:
                n.append(min(CHUNK_SLOTS, slots - at * CHUNK_SLOTS))
                to, counts = shard_counts(n[-1], shards, np.random.default_rng([seed, own, at]))
                shard.append(np.repeat(to, counts))
                k.append(own)
                blocks.append(of)
                first.append(at * CHUNK_SLOTS)
            k, blocks, first = (np.repeat(np.array(x, dtype=np.int64), n) for x in (k, blocks, first))
            j = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            rounds = j // blocks
            at = permute(j % blocks, blocks, mix64(rounds * 1009 + k, seed))
            return pd.DataFrame({"shard": np.concatenate(shard), "k": k, "block": at, "round": rounds})

        def fill(parts):
            held, size = [], 0
            for part in parts:
                for row in zip(part["k"], part["blocks"], part["slots"], part["chunk"], strict=True):
                    held.append(row)
                    size += min(CHUNK_SLOTS, row[2] - row[3] * CHUNK_SLOTS)
                    if size >= CHUNK_SLOTS:
                        yield made(held)
                        held, size = [], 0
            if held:
                yield made(held)

        return plan.mapInPandas(fill, "shard long, k long, block long, round long")

    def spans(self) -> DataFrame:
        """Which words of which document each taken block holds: doc_id, tie, shard, round, k, block, from_word, words (word numbers within the document)."""
        b = self.block
        has = self.documents.filter("size > 0")
        blocks = has.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        low = F.greatest(F.col("start"), F.col("block") * b)
        high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        blocks = blocks.select("doc_id", "k", "start", "block", (low - F.col("start")).alias("from_word"), (high - low).alias("words"))
        # both sides grow with the corpus, which the planner can't see from the plan of a few sources
        return blocks.join(self.slots().hint("merge"), ["k", "block"])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), taken (words the mix takes, repeats counted).

    Null texts have size 0; a null source is a source, the last. A document without words is taken
    0 times. Repeated rows are documents of their own. Other columns are left out. An empty table gives an
    empty result.
    """
    mix = Mix(docs, id_col, text_col, source_col, **options)
    # k and start name a document that has words, even among repeated rows
    taken = mix.spans().groupBy("k", "start").agg(F.sum("words").alias("words"))
    words = F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(F.lit(0))
    return mix.documents.join(taken, ["k", "start"], "left").select("doc_id", "source", "size", "source_size", "target", words.cast("long").alias("taken"))


def taken_words(text: bytes, spans: list[dict]) -> bytes:
    """The words of the spans (round, from_word, words) in their order, in time linear in the outcome."""
    words, said, end = text.split(), [], None
    for x in spans:
        here = (x["round"], x["from_word"])
        said += [b"" if end is None else b" " if here == end else b"\n", b" ".join(words[x["from_word"] : x["from_word"] + x["words"]])]
        end = (x["round"], x["from_word"] + x["words"])
    return b"".join(said)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of docs with all their columns, text_col holding the words that the mix takes.

    A document's taken words stand in their order, those of the first round first, joined by single
    spaces within a block and line feeds between blocks that don't follow each other. Documents of which
    nothing is taken are left out.
    """
    mix = Mix(docs, id_col, text_col, source_col, **options)
    spans = mix.spans().groupBy("k", "start").agg(F.sort_array(F.collect_list(F.struct("round", "from_word", "words"))).alias("spans_"))
    twin = Window.partitionBy("doc_id", "tie")
    rows = mix.documents.filter("size > 0").join(spans, ["k", "start"]).withColumn("nth_", F.row_number().over(twin.orderBy("k", "start"))).select(F.col("doc_id").alias("d_"), F.col("tie").alias("t_"), "nth_", "spans_")
    names = [f.name for f in docs.schema]

    def tied(part: pa.RecordBatch) -> dict:
        return {n: column(part, n) for n in names} | {"t_": [hash64(t) for t in texts(part, text_col)]}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    own = batches(docs, tied, schema + ", t_ long").withColumn("d_", F.col(f"`{id_col}`").cast("long"))
    # texts are numbered only where a document repeats: that costs a shuffle of them
    if mix.documents.groupBy("doc_id", "tie").count().filter("count > 1").isEmpty():
        own = own.withColumn("nth_", F.lit(1))
    else:
        own = own.withColumn("nth_", F.row_number().over(Window.partitionBy("d_", "t_").orderBy(F.col(f"`{source_col}`").asc_nulls_last())))
    met = own.hint("merge").join(rows, own["d_"].eqNullSafe(rows["d_"]) & (own["t_"] == rows["t_"]) & (own["nth_"] == rows["nth_"]))

    def rebuilt(part: pa.RecordBatch) -> dict:
        out = [taken_words(text, spans).decode("utf-8") for text, spans in zip(texts(part, text_col), column(part, "spans_").to_pylist(), strict=True)]
        return {n: column(part, n) for n in names} | {text_col: out}

    return batches(met.select(*[own[f"`{n}`"] for n in names], "spans_"), rebuilt, schema)
