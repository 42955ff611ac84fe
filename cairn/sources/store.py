"""Versioned storage: immutable Parquet versions and a small manifest of which is current.

A version is a folder named by its key; it is written once and never changed. Publishing rewrites the
manifest only. One driver writes at a time (lock), since plain Parquet has no transactions.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from cairn.functions.canonical import fingerprint

_locks: dict[str, threading.Lock] = defaultdict(threading.Lock)


class ImmutableVersion(Exception):
    """A published version would have been changed."""


@contextlib.contextmanager
def lock(name: str) -> Iterator[None]:
    """One writer for each branch within this driver; waiting is not offered, as a second writer is a fault of the caller."""
    own = _locks[name]
    if not own.acquire(blocking=False):
        raise RuntimeError(f"{name} is being written already")
    try:
        yield
    finally:
        own.release()


def digest(configuration: dict) -> str:
    """Identity of a configuration, whatever the order of its keys: the same digest means a version can be reused."""
    return fingerprint(configuration)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for name in the folder that spark.checkpoint.dir names, deleted when the driver ends; a temporary one serves local masters where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    folder = f"{shared.rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"

    atexit.register(lambda: spark.sparkContext._jsc is not None and delete(spark, folder))
    return folder


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are deleted when it is written, and not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


_passing: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but those that last: what is made of them must be stored by then."""
    own: list[str] = []
    _passing.append(own)
    try:
        yield
    finally:
        _passing.pop()
        for path in own:
            delete(spark, path)


def stored(df: DataFrame, name: str, *by: str, lasting: bool = False) -> DataFrame:
    """df as a table in a scratch folder of its own, in folders by the columns named: made once, however often it is read. What was shuffled for it goes when it is written."""
    path = scratch(df.sparkSession, name)
    if _passing and not lasting:
        _passing[-1].append(path)
    with _shuffles_dropped(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty folder: there or not, never in between."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


class Store:
    """Versions of one dataset under root: root/version=<key>, and root/published/<key> marks."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, version: int) -> str:
        return f"{self.root}/data/version={version}"

    def published(self, version: int) -> bool:
        return exists(self.spark, f"{self.root}/published/{version}")

    def write(self, version: int, df: DataFrame, chunk: int = 0) -> None:
        """Write or rewrite a draft, in files of at most chunk rows where wanted; a published version is refused."""
        if self.published(version):
            raise ImmutableVersion(f"version {version} is published")
        df.write.mode("overwrite").option("maxRecordsPerFile", chunk).parquet(self._path(version))

    def reset(self, version: int) -> None:
        """Delete a draft."""
        if self.published(version):
            raise ImmutableVersion(f"version {version} is published")
        delete(self.spark, self._path(version))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._path(version))

    def publish(self, version: int) -> None:
        """Freeze a version that has rows."""
        if self.read(version).isEmpty():
            raise ValueError(f"version {version} is empty")
        mark(self.spark, f"{self.root}/published/{version}")
