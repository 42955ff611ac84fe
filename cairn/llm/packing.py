"""Packing (5): best-fit decreasing with a segment tree over remaining capacities.

Documents longer than a window are first cut into full windows. What is left of each document, 1 to
window - 1 tokens, is packed best-fit decreasing over the whole table at once: the driver only needs
how many remainders there are of each length (at most window - 1 numbers), since remainders of one
length are alike. Open windows with the same remaining capacity form runs of consecutive numbers;
a segment tree indexed by remaining capacity finds the tightest run that an item fits. The outcome
is a plan of steps, "the next k remainders of this length go to these windows", whose size depends
on the window and not on the number of documents. Each remainder gets its number within its length
(counted by chunk, then within the chunk) and finds its step by that number.
"""

from __future__ import annotations

import bisect
import functools
import json
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import batches, column, partitions, saved, strings

WINDOW = 2048
#: The id that ends each document.
END_ID = 1
#: Words whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 300_000
#: Rows of a chunk within which remainders are numbered in one task.
CHUNK_ROWS = 20_000


# The set-up of a tokenizer whose words can be taken one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordIds(dict):
    """Ids of the tokenizer as bytes (little-endian, 32 bits) by word, made when a word is first met.

    The tokenizer drops white space, and a space or line feed always ends a word, so a text's ids are
    those of its words. It lowers case and parts letters from full stops and commas. So a word of Latin
    letters, lowered, goes to the tokenizer's merges at once, without its normaliser and splitter; any
    other word takes the whole way. A text that holds a special token's string is given to it whole.
    All this holds for a tokenizer set up as NORMALIZER and SPLITTER say; texts are given whole to any other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = _byte_letters()
        said = json.loads(self.tokenizer.to_str())
        self.by_word = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == SPLITTER and said["model"]["type"] == "BPE" and not any(x["normalized"] or x["lstrip"] or x["rstrip"] for x in said["added_tokens"])

    def __missing__(self, word: str) -> bytes:
        # All below U+0250 is unchanged by NFC, and its lower case is that of each letter.
        latin = word and max(word) < "\u0250"
        low = word.lower() if latin else word
        if latin and len(low) > 1 and low[-1] in ".," and low[-2].isalpha():
            ids = self[low[:-1]] + self[low[-1]]
        elif latin and low.isalpha() and max(low) < "\u0250":
            ids = self[low] if low != word else self._merged(low)
        else:
            ids = self._whole(word)
        if len(word) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def _merged(self, word: str) -> bytes:
        own = [t.id for t in self.model.tokenize("".join(map(self.bytes.__getitem__, word.encode())))]
        return struct.pack(f"<{len(own)}I", *own)

    def _whole(self, text: str) -> bytes:
        own = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(own)}I", *own)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._whole(t) if not self.by_word or any(s in t for s in self.special) else b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]


def _byte_letters() -> list[str]:
    """The printable character by which byte-level tokenizers write each byte: itself where printable in Latin-1, else from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


class CapacityTree:
    """A segment tree over capacities 0..n: which have an open run; finds the smallest open one that is at least x."""

    def __init__(self, n: int):
        self.base = 1 << n.bit_length()
        self.open = [False] * (2 * self.base)

    def set(self, at: int, on: bool) -> None:
        at += self.base
        self.open[at] = on
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, x: int) -> int:
        """-1 if none."""
        at = x + self.base
        if self.open[at]:
            return x
        while at > 1:
            if not at & 1 and self.open[at + 1]:  # the right neighbour under the same parent
                at += 1
                while at < self.base:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return -1


@dataclass(frozen=True)
class Step:
    """Items number first .. first + count - 1 of a length: each of the windows from window on takes per of them, from offset on."""

    length: int
    first: int
    count: int
    window: int
    offset: int
    per: int


def best_fit_plan(counts: dict[int, int], window: int = WINDOW, first_window: int = 0) -> tuple[list[Step], int]:
    """Steps that place counts[length] items of each length, longest first, each in the tightest open window; and the number after the last window."""
    tree = CapacityTree(window)
    runs: dict[int, list[tuple[int, int]]] = {}  # by remaining capacity: (first window, windows)
    steps, fresh = [], first_window

    def put(left: int, at: int, n: int) -> None:
        if left > 0 and n:
            runs.setdefault(left, []).append((at, n))
            tree.set(left, True)

    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        if not 1 <= length <= window:
            raise ValueError(f"no window takes {length} tokens")
        todo, first = counts[length], 0
        while todo:
            left = tree.tightest(length)
            if left < 0:
                left, (at, n) = window, (fresh, -(-todo // (window // length)))
                fresh += n
            else:
                at, n = runs[left].pop()
                if not runs[left]:
                    del runs[left]
                    tree.set(left, False)
            # A window that takes one item is tighter than before, so it takes the next ones too.
            per = left // length
            full = min(n, todo // per)
            if full:
                steps.append(Step(length, first, full * per, at, window - left, per))
                put(left - per * length, at, full)
                first, todo = first + full * per, todo - full * per
            if full < n and todo and todo < per:
                steps.append(Step(length, first, todo, at + full, window - left, todo))
                put(left - todo * length, at + full, 1)
                first, todo, full = first + todo, 0, full + 1
            put(left, at + full, n - full)
    return steps, fresh


class Plan:
    """Finds the place of an item by its length and its number within its length."""

    def __init__(self, steps: list[Step]):
        self.by: dict[int, tuple[list[int], list[Step]]] = {}
        for s in steps:
            firsts, own = self.by.setdefault(s.length, ([], []))
            firsts.append(s.first)
            own.append(s)

    def place(self, length: int, number: int) -> tuple[int, int]:
        firsts, own = self.by[length]
        s = own[bisect.bisect_right(firsts, number) - 1]
        k = number - s.first
        return s.window + k // s.per, s.offset + k % s.per * length


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens; all but the last of a document are full windows."""

    def cut(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        end = struct.pack("<I", END_ID)
        for doc, ids in zip(column(part, "id_").to_pylist(), word_ids(tokenizer_path).encode(strings(part, "text_")), strict=True):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, window):
                own = ids[4 * start : 4 * (start + window)]
                for k, v in (("doc_id", doc), ("start", start), ("length", len(own) // 4), ("ids_crc32", zlib.crc32(own)), ("doc_tokens", n)):
                    out[k].append(v)
        return out

    rows = docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].cast("string").alias("text_"))
    return batches(rows, cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """cut (pieces of at most window tokens) with sequence_id and offset added; cut should be stored, for it is read several times.

    Numbers within a length follow a hash of the row, so a rerun gives the same sequences; equal rows
    are alike and may change places.
    """
    spark = cut.sparkSession
    row = F.xxhash64("doc_id", "start", "ids_crc32")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most window rows
    full, total = counts.pop(window, 0), sum(counts.values())
    steps, _ = best_fit_plan(counts, window, full)
    chunks = max(partitions(spark), -(-(total + full) // CHUNK_ROWS))
    keyed = cut.withColumn("row_", row).withColumn("chunk_", F.pmod(F.col("row_"), F.lit(chunks)))
    per = keyed.groupBy("chunk_", "length").agg(F.count(F.lit(1)).alias("n_"))
    # one row for each chunk and length; a length's chunks are summed up in their order
    before = per.select("chunk_", "length", (F.sum("n_").over(Window.partitionBy("length").orderBy("chunk_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")).alias("before_"))
    within = F.row_number().over(Window.partitionBy("chunk_", "length").orderBy("row_", "doc_id", "start")) - 1
    numbered = keyed.withColumn("within_", within).join(before, ["chunk_", "length"]).withColumn("number_", F.col("before_") + F.col("within_"))
    plan = spark.sparkContext.broadcast(steps)  # a few steps for each length, whatever the number of documents
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    held: dict[str, Plan] = {}

    def place(part: pa.RecordBatch) -> dict:
        if "plan" not in held:
            held["plan"] = Plan(plan.value)
        got = [(n, 0) if k == window else held["plan"].place(k, n) for k, n in zip(column(part, "length").to_pylist(), column(part, "number_").to_pylist(), strict=True)]
        return {c: column(part, c) for c in names} | {"sequence_id": [s for s, _ in got], "offset": [o for _, o in got]}

    return batches(numbered.select(*names, "number_"), place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and END_ID, so null and empty texts have one token. Each id lies
    in one piece; sequences hold at most window tokens, offsets run from 0 without gaps. Repeated
    rows are packed one by one. Other columns are left out. An empty table gives an empty
    result. Texts aren't shuffled; the tokenizer's file must be at tokenizer_path on each executor.
    """
    return pack(saved(pieces(docs, tokenizer_path, window, id_col, text_col)), window)
