"""Objects of a bare repository as rows, read in tasks: a Python data source over packs and loose objects.

The driver lists the packs and how many objects each index counts. A partition is a range of one index;
its task maps the pack into memory, goes through its objects in the order of the pack, and inflates
each one with the chain of deltas below it. Sizes stand in headers, so an object beyond the limit costs a
few bytes, not its content. Loose objects are partitions by the first digit of their ids. The
repository's folder must be mounted by driver and executors alike.

    spark.dataSource.register(GitObjects)
    spark.read.format("git_objects").option("path", repo).option("max_bytes", 1 << 20).load()
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the formats.
TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFS_DELTA, REF_DELTA = 6, 7
INDEX_MAGIC = b"\xfftOc\x00\x00\x00\x02"
SCHEMA = "object_id string, type string, size long, content binary"
#: Objects of a partition, bytes of objects that a task remembers as bases of deltas, and rows and bytes of a batch.
PART_OBJECTS, REMEMBERED, BATCH_ROWS, BATCH_BYTES = 20_000, 64 << 20, 512, 4 << 20


class Broken(ValueError):
    """A pack, index or object that isn't as the format says."""


class Index:
    """A pack's index: object ids in ascending order and the offset of each."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        self.data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        if self.data[:8] != INDEX_MAGIC:
            raise Broken(f"{path} is no index of version 2")
        self.n = struct.unpack_from(">I", self.data, 8 + 255 * 4)[0]
        self.ids = 8 + 256 * 4

    def id_at(self, k: int) -> bytes:
        return self.data[self.ids + 20 * k : self.ids + 20 * k + 20]

    def offset(self, k: int) -> int:
        small = self.ids + 24 * self.n
        own = struct.unpack_from(">I", self.data, small + 4 * k)[0]
        return own if own < 1 << 31 else struct.unpack_from(">Q", self.data, small + 4 * self.n + 8 * (own & 0x7FFFFFFF))[0]

    def find(self, object_id: bytes) -> int | None:
        first = object_id[0]
        low = struct.unpack_from(">I", self.data, 8 + 4 * (first - 1))[0] if first else 0
        high = struct.unpack_from(">I", self.data, 8 + 4 * first)[0]
        while low < high:
            mid = (low + high) // 2
            if self.id_at(mid) < object_id:
                low = mid + 1
            else:
                high = mid
        return low if low < self.n and self.id_at(low) == object_id else None


class Pack:
    """A pack with its index."""

    def __init__(self, path: str):
        self.index = Index(path[: -len(".pack")] + ".idx")
        self.file = open(path, "rb")  # noqa: SIM115
        self.data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        if self.data[:4] != b"PACK":
            raise Broken(f"{path} is no pack")
        self.held: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self.bytes = 0

    def header(self, at: int) -> tuple[int, int, int, int | None]:
        """Kind, size as stored, where the data begin, and the offset of the base of a delta."""
        begin, c = at, self.data[at]
        kind, size, shift = c >> 4 & 7, c & 15, 4
        while c & 128:
            at += 1
            c = self.data[at]
            size |= (c & 127) << shift
            shift += 7
        at += 1
        if kind == OFS_DELTA:
            c = self.data[at]
            back = c & 127
            while c & 128:
                at += 1
                c = self.data[at]
                back = (back + 1 << 7) | (c & 127)
            return kind, size, at + 1, begin - back
        if kind == REF_DELTA:
            k = self.index.find(self.data[at : at + 20])
            if k is None:
                raise Broken("the base of a delta is not in its pack")
            return kind, size, at + 20, self.index.offset(k)
        if kind not in TYPES:
            raise Broken(f"no object is of kind {kind}")
        return kind, size, at, None

    def inflated(self, at: int, size: int, most: int | None = None) -> bytes:
        """The data at an offset: all `size` bytes, or the first `most`."""
        own, out, want = zlib.decompressobj(), [], size if most is None else min(most, size)
        held = 0
        while held < want and not own.eof:
            piece = own.decompress(own.unconsumed_tail or self.data[at : at + 65_536], want - held)
            if not own.unconsumed_tail:
                at += 65_536
            if not piece and at >= len(self.data):
                break
            out.append(piece)
            held += len(piece)
        if held < want:
            raise Broken("an object ends too early")
        return b"".join(out)

    def described(self, at: int) -> tuple[str, int]:
        """Type and size of the object at an offset, without its content."""
        kind, size, data, base = self.header(at)
        if base is None:
            return TYPES[kind], size
        head = self.inflated(data, size, 24)  # two sizes of at most ten bytes each
        _, place = _varint(head, 0)
        whole = _varint(head, place)[0]
        while base is not None:
            kind, _, _, base = self.header(base)
        return TYPES[kind], whole

    def read(self, at: int) -> tuple[str, bytes]:
        """Type and content of the object at an offset. The chain of deltas is followed down to what is remembered or whole, then applied upward."""
        chain = []
        while at not in self.held:
            kind, size, data, base = self.header(at)
            if base is None:
                own = TYPES[kind], self.inflated(data, size)
                self._remember(at, own)
                break
            chain.append((at, data, size))
            at = base
        else:
            own = self.held[at]
            self.held.move_to_end(at)
        for place, data, size in reversed(chain):
            own = own[0], applied(own[1], self.inflated(data, size))
            self._remember(place, own)
        return own

    def _remember(self, at: int, own: tuple[str, bytes]) -> None:
        if len(own[1]) > REMEMBERED // 4:
            return
        self.held[at] = own
        self.bytes += len(own[1])
        while self.bytes > REMEMBERED:
            self.bytes -= len(self.held.popitem(last=False)[1][1])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise Broken("a delta ends too early")
        c = data[at]
        value |= (c & 127) << shift
        at, shift = at + 1, shift + 7
        if not c & 128:
            return value, at


def applied(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: pieces of the base and of its own."""
    held, at = _varint(delta, 0)
    size, at = _varint(delta, at)
    if held != len(base):
        raise Broken("a delta is of another base")
    out = []
    while at < len(delta):
        c = delta[at]
        at += 1
        if c & 128:
            begin = length = 0
            for k in range(4):
                if c >> k & 1:
                    begin |= delta[at] << 8 * k
                    at += 1
            for k in range(3):
                if c >> 4 + k & 1:
                    length |= delta[at] << 8 * k
                    at += 1
            out.append(base[begin : begin + (length or 65_536)])
        elif c:
            out.append(delta[at : at + c])
            at += c
        else:
            raise Broken("a delta holds an unknown command")
    whole = b"".join(out)
    if len(whole) != size:
        raise Broken("a delta makes an object of another size")
    return whole


def loose(path: str, most: int) -> tuple[str, int, bytes | None]:
    """Type, size and content of a loose object; no content beyond `most` bytes."""
    own, head = zlib.decompressobj(), b""
    with open(path, "rb") as file:
        head = own.decompress(file.read(4096), 64)
        kind, _, rest = head.partition(b" ")
        digits, end, content = rest.partition(b"\0")
        if not end or not digits.isdigit():
            raise Broken(f"{path} is no object")
        size = int(digits)
        if size > most:
            return kind.decode(), size, None
        pieces = [content]
        while not own.eof:
            piece = own.unconsumed_tail or file.read(65_536)
            if not piece:
                raise Broken(f"{path} ends too early")
            pieces.append(own.decompress(piece))
    content = b"".join(pieces)
    if len(content) != size:
        raise Broken(f"{path} holds an object of another size")
    return kind.decode(), size, content


@dataclass
class Range(InputPartition):
    """Objects low to high of the index of a pack; or, without a pack, the loose objects whose ids begin with digit."""

    pack: str | None
    low: int
    high: int
    digit: str = ""


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").rstrip("/")
        self.most = int(options.get("max_bytes", 2 << 20))
        self.types = {x.strip() for x in options.get("types", "commit,tree,blob,tag").split(",")}
        self.part = int(options.get("part_objects", PART_OBJECTS))
        self.verify = options.get("verify", "true").lower() == "true"

    def partitions(self) -> list[Range]:
        objects, out = f"{self.root}/objects", []
        if not os.path.isdir(objects):
            raise FileNotFoundError(f"{self.root} is no bare repository")
        packs = f"{objects}/pack"
        for name in sorted(os.listdir(packs)) if os.path.isdir(packs) else []:
            if name.endswith(".pack") and os.path.exists(f"{packs}/{name[:-5]}.idx"):
                with open(f"{packs}/{name[:-5]}.idx", "rb") as file:
                    n = struct.unpack_from(">I", file.read(8 + 256 * 4), 8 + 255 * 4)[0]
                out += [Range(f"{packs}/{name}", low, min(low + self.part, n)) for low in range(0, n, self.part)]
        held = {x[0] for x in os.listdir(objects) if len(x) == 2 and x not in ("pack", "info")}
        return out + [Range(None, 0, 0, digit) for digit in sorted(held)] or [Range(None, 0, 0, "-")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._packed(partition) if partition.pack else self._loose(partition.digit):
            rows.append(row)
            size += len(row[3] or b"")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _packed(self, part: Range) -> Iterator[tuple[str, str, int, bytes | None]]:
        pack = Pack(part.pack)
        # neighbours in a pack share bases
        for at, k in sorted((pack.index.offset(k), k) for k in range(part.low, part.high)):
            kind, size = pack.described(at)
            if kind in self.types:
                content = pack.read(at)[1] if size <= self.most else None
                yield self._verified(pack.index.id_at(k).hex(), kind, size, content)

    def _loose(self, digit: str) -> Iterator[tuple[str, str, int, bytes | None]]:
        objects = f"{self.root}/objects"
        for folder in sorted(x for x in os.listdir(objects) if len(x) == 2 and x[0] == digit):
            for name in sorted(os.listdir(f"{objects}/{folder}")):
                if len(name) == 38:
                    kind, size, content = loose(f"{objects}/{folder}/{name}", self.most)
                    if kind in self.types:
                        yield self._verified(folder + name, kind, size, content)

    def _verified(self, object_id: str, kind: str, size: int, content: bytes | None) -> tuple[str, str, int, bytes | None]:
        if self.verify and content is not None and hashlib.sha1(f"{kind} {size}\0".encode() + content).hexdigest() != object_id:
            raise Broken(f"object {object_id} holds something else")
        return object_id, kind, size, content


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["object_id", "type", "size", "content"])


class GitObjects(DataSource):
    """object_id, type, size and content (null beyond max_bytes) of all objects; one that several packs hold comes several times.

    Options: path, max_bytes, types (a list of commit, tree, blob, tag), part_objects, verify.
    """

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def objects(spark: SparkSession, path: str, max_bytes: int = 2 << 20, types: str = "commit,tree,blob,tag", **options: str) -> DataFrame:
    spark.dataSource.register(GitObjects)
    reader = spark.read.format("git_objects").option("path", path).option("max_bytes", str(max_bytes)).option("types", types)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def entries(trees: DataFrame) -> DataFrame:
    """tree_id, mode, name, object_id of the entries of trees (object_id, content)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple[str, str, str, str]] = []
            for tree, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                at = 0
                while at < len(data):
                    blank = data.index(b" ", at)
                    end = data.index(b"\0", blank)
                    out.append((tree, data[at:blank].decode().zfill(6), data[blank + 1 : end].decode("utf-8", "replace"), data[end + 1 : end + 21].hex()))
                    at = end + 21
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["tree_id", "mode", "name", "object_id"])

    return trees.select("object_id", "content").mapInArrow(run, "tree_id string, mode string, name string, object_id string")


def listing(known: DataFrame, root: str, depth: int = 64) -> DataFrame:
    """mode, object_id and path of the files below a tree: its own entries, then those of its folders, a join for each level.

    known: stored entries. Submodules and links to other folders are entries of their own; at most depth levels are
    followed, and each is written, so that the next one starts from a table.
    """
    from cairn.sources.store import stored

    spark = known.sparkSession
    level = spark.createDataFrame([(root, "")], "tree_id string, prefix string")
    done = None
    for _ in range(depth):
        met = stored(level.join(known, "tree_id").select("mode", "object_id", F.concat("prefix", "name").alias("path")), "tree")
        files = met.filter("mode <> '040000'")
        done = files if done is None else done.unionByName(files)
        level = met.filter("mode = '040000'").select(F.col("object_id").alias("tree_id"), F.concat("path", F.lit("/")).alias("prefix"))
        if level.isEmpty():
            return done
    raise ValueError(f"the tree is deeper than {depth} folders")


def tree_of(commits: DataFrame, commit: str) -> str:
    """The tree of a commit (of commits: object_id, content)."""
    row = commits.filter(F.col("object_id") == commit).select(F.regexp_extract(F.col("content").cast("string"), r"\Atree ([0-9a-f]{40})", 1).alias("tree")).first()
    if row is None or not row["tree"]:
        raise ValueError(f"{commit} is no commit of the repository")
    return row["tree"]
