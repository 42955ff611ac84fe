"""Version-control sources: trees, refs, blobs and sizes, parsed from the tool's own output.

Running the tool is the driver's business and outside Spark; these functions take what it printed.
"""

from __future__ import annotations

import re
import subprocess
import threading
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tree(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a recursive long listing ended by NULs: mode, object_id, size_bytes, path; only blobs."""
    return tree_entries(spark.read.text(path, lineSep="\0"))


def tree_entries(lines: DataFrame) -> DataFrame:
    """From a column value: mode, type, object and size parted by blanks, a tab, the path."""
    part = lambda k: F.regexp_extract("value", r"(?s)^(\d{6}) +(\w+) +([0-9a-f]+) +(\d+|-)\t(.+)$", k)
    own = lines.select(part(1).alias("mode"), part(2).alias("type"), part(3).alias("object_id"), F.expr("try_cast(regexp_extract(value, '(?s)^\\\\d{6} +\\\\w+ +[0-9a-f]+ +(\\\\d+|-)\\t', 1) AS BIGINT)").alias("size_bytes"), part(5).alias("path"))
    return own.filter(F.col("type") == "blob").select("mode", "object_id", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "path")


def refs(lines: DataFrame) -> DataFrame:
    """Branches of a listing "object<TAB>refs/heads/name" in column value: name, head, by name."""
    own = lines.select(F.regexp_extract("value", r"^([0-9a-f]{40})\s", 1).alias("head"), F.regexp_extract("value", r"\srefs/heads/(.+)$", 1).alias("name"))
    return own.filter((F.col("name") != "") & (F.col("head") != "")).select("name", "head").orderBy("name")


def remote_probe(lines: DataFrame, *keys: str) -> DataFrame:
    """default_branch and head of symbolic listings, one for each of keys: "ref: refs/heads/x<TAB>HEAD" and "object<TAB>HEAD"."""
    said = lambda pattern: F.max(F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")))
    return lines.groupBy(*keys).agg(said(r"^ref: refs/heads/(\S+)\s+HEAD$").alias("default_branch"), said(r"^([0-9a-f]{40})\s+HEAD$").alias("head"))


def repository_bytes(lines: DataFrame) -> DataFrame:
    """bytes of "key: KiB" lines: loose, packed and garbage, summed."""
    key, n = F.substring_index("line", ": ", 1), F.expr("try_cast(substring_index(line, ': ', -1) AS BIGINT)")
    return lines.agg((F.coalesce(F.sum(F.when(key.isin("size", "size-pack", "size-garbage"), n)), F.lit(0)) * 1024).alias("bytes"))


def readable(content: Column, most: int) -> Column:
    """Whether a blob may be parsed: not too large, and UTF-8."""
    return (F.octet_length(content) <= most) & F.is_valid_utf8(content)


def blobs(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Whole files as path, text; those too large or not UTF-8 have null text and refused true."""
    own = spark.read.format("binaryFile").load(path)
    fine = F.coalesce((F.col("length") <= most) & F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    return own.select("path", F.when(fine, F.col("content").cast("string")).alias("text"), (~fine).alias("refused"))


_syncing: dict[str, threading.Lock] = {}


def sync(url: str, root: str, organization: str, repository: int, timeout: float = 600) -> str:
    """Clone a bare copy below root, or fetch into the one that is there; one at a time for each repository. Returns its path.

    This runs on the driver, before Spark has anything to read.
    """
    if not re.fullmatch(r"[\w-]+", organization):
        raise ValueError("the organisation is no folder name")
    path = Path(root) / organization / f"{int(repository)}.git"
    with _syncing.setdefault(str(path), threading.Lock()):
        if path.exists():
            subprocess.run(["git", "--git-dir", str(path), "fetch", "--prune", "--quiet", "origin", "+refs/heads/*:refs/heads/*"], check=True, capture_output=True, timeout=timeout)
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            subprocess.run(["git", "clone", "--bare", "--quiet", "--", url, str(path)], check=True, capture_output=True, timeout=timeout)
    return str(path)
