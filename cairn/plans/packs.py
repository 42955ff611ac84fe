"""A repository of blobs, written by tasks into the shared folder: what the queries of git objects read."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.store import scratch


#: Fixed value: readers refuse shorter deltas.
LEAST_DELTA = 4


def packed(blobs: DataFrame) -> str:
    """The folder of a repository that holds the contents (content, binary), each once, a pack for each partition. Two of three blobs of a pack are deltas of the one before."""
    root = scratch(blobs.sparkSession, "repository").removeprefix("file://")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = _pack(f"{root}/objects/pack", (bytes(x) for part in parts for x in part["content"]), TaskContext.get())
        yield pd.DataFrame({"n": [n]})

    one = blobs.filter("content is not null").groupBy(F.sha2("content", 256).alias("key")).agg(F.first("content").alias("content"))
    one.select("content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return root


def _pack(folder: str, blobs: Iterator[bytes], task: TaskContext) -> int:
    os.makedirs(folder, exist_ok=True)
    # an attempt writes under a name of its own; only a whole pack gets its index, by which readers find it
    draft = f"{folder}/tmp-{task.partitionId()}-{task.taskAttemptId()}"
    ids: list[tuple[bytes, int, int]] = []
    own, before, place = hashlib.sha1(b""), None, 12
    with open(draft, "wb") as file:
        file.write(b"\0" * 12)
        for blob in blobs:
            delta = _delta(before[0], blob) if before is not None and len(ids) % 3 else b""
            if len(delta) >= LEAST_DELTA:
                entry = _header(6, len(delta)) + _back(place - before[1]) + zlib.compress(delta)
            else:
                entry = _header(3, len(blob)) + zlib.compress(blob)
            ids.append((hashlib.sha1(b"blob %d\0" % len(blob) + blob).digest(), place, zlib.crc32(entry)))
            file.write(entry)
            before, place = (blob, place), place + len(entry)
        file.seek(0)
        file.write(b"PACK" + struct.pack(">II", 2, len(ids)))
    if not ids:
        os.remove(draft)
        return 0
    with open(draft, "rb") as file:
        while piece := file.read(1 << 20):
            own.update(piece)
    with open(draft, "ab") as file:
        file.write(own.digest())
    ids.sort()
    index = b"\xfftOc\0\0\0\2" + struct.pack(">256I", *_fan(ids)) + b"".join(x[0] for x in ids) + b"".join(struct.pack(">I", x[2]) for x in ids)
    large = [x[1] for x in ids if x[1] >= 1 << 31]
    at = iter(range(len(large)))
    index += b"".join(struct.pack(">I", x[1] if x[1] < 1 << 31 else (1 << 31) + next(at)) for x in ids) + b"".join(struct.pack(">Q", x) for x in large) + own.digest()
    name = f"{folder}/pack-{own.hexdigest()}"
    os.replace(draft, f"{name}.pack")
    with open(f"{draft}.idx", "wb") as file:
        file.write(index + hashlib.sha1(index).digest())
    os.replace(f"{draft}.idx", f"{name}.idx")
    return len(ids)


def _fan(ids: list[tuple[bytes, int, int]]) -> list[int]:
    held = [0] * 256
    for x in ids:
        held[x[0][0]] += 1
    for k in range(1, 256):
        held[k] += held[k - 1]
    return held


def _header(kind: int, size: int) -> bytes:
    out, c = bytearray(), kind << 4 | size & 15
    size >>= 4
    while size:
        out.append(c | 128)
        c, size = size & 127, size >> 7
    out.append(c)
    return bytes(out)


def _back(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        n -= 1
        out.append(128 | n & 127)
    return bytes(reversed(out))


def _size(n: int) -> bytes:
    out = bytearray()
    while n >> 7:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _delta(base: bytes, blob: bytes) -> bytes:
    """The common beginning copied from the base, the rest as it is."""
    same = next((k for k, (a, b) in enumerate(zip(base, blob, strict=False)) if a != b), min(len(base), len(blob)))
    out, at = bytearray(_size(len(base)) + _size(len(blob))), 0
    while at < same:
        n = min(same - at, 0xFFFF)
        out += bytes([0x80 | 0x0F | 0x30]) + struct.pack("<I", at) + struct.pack("<H", n)
        at += n
    while at < len(blob):
        piece = blob[at : at + 127]
        out += bytes([len(piece)]) + piece
        at += len(piece)
    return bytes(out)
