"""Line dedup (3): boilerplate lines by their distinct-site spread.

Each line that isn't blank gets a 128-bit hash (of the line with white space at its ends removed).
Sketches (HyperLogLog) of the sites of each hash merge by aggregation, so a line that is everywhere
costs a row per task. Lines whose estimate is clearly above the threshold are boilerplate, those
clearly below are not, and those in between get exact distinct counts. Then boilerplate goes out of
all texts, wherever it stands.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import batches, column, saved, scope, strings

#: log2 of the sketch's registers; its relative error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 11
#: Estimates this many errors around the threshold are settled by exact counts (at least one site).
ERRORS = 8
#: Boilerplate hashes that may be broadcast (16 bytes each); beyond that the joined path runs.
BROADCAST_LINES = 1_000_000


#: White space that ends of lines are compared without.
ENDS = " \t\x0b\x0c\r"


def digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def line_sites(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """(line, site) of all lines that aren't blank, each once per batch of rows."""

    def lines(part: pa.RecordBatch) -> dict:
        seen = set()
        for text, site in zip(strings(part, "text_"), column(part, "site_").to_pylist(), strict=True):
            seen.update((x, site) for x in {y.strip(ENDS) for y in text.split("\n")} if x)
        pairs = list(seen)
        return {"line": [digest(x) for x, _ in pairs], "site": [s for _, s in pairs]}

    rows = docs.select(docs[text_col].cast("string").alias("text_"), F.coalesce(docs[site_col].cast("string"), F.lit("")).alias("site_"))
    return batches(rows, lines, "line binary, site string")


def boilerplate(docs: DataFrame, min_sites: int, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Hashes (line) of the lines that stand in at least min_sites distinct sites; null sites count as one site."""
    pairs = line_sites(docs, text_col, site_col)
    margin = max(1.0, ERRORS * 1.04 / 2 ** (LG_K / 2) * min_sites)
    sketches = pairs.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin)
    spread = saved(spread)
    clear = spread.filter(F.col("sites") > min_sites + margin).select("line")
    near = spread.filter(F.col("sites") <= min_sites + margin).select("line")
    exact = pairs.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select("line")
    return clear.unionByName(exact)


def line_dedup(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """All rows and columns of docs with text_col cleaned, and n_lines and n_removed (long) added.

    A line is what stands between line feeds; blank lines are kept and never counted. A removed line
    takes one line feed with it. Null texts stay null, with n_lines 0. Null sites count as one site.
    Repeated rows are cleaned alike. Columns of docs named n_lines or n_removed are replaced.
    An empty table gives an empty result.
    """
    with scope(docs.sparkSession):
        bad = saved(boilerplate(docs, min_sites, text_col, site_col), keep=True)
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*others)
    names = [f.name for f in docs.schema]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", n_lines long, n_removed long"

    if bad.count() <= broadcast_lines:
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in bad.toLocalIterator()))

        def clean(part: pa.RecordBatch) -> dict:
            return _cleaned(part, names, text_col, [sent.value] * part.num_rows)

        return batches(docs, clean, schema)
    # Too many to broadcast: each row meets the hashes of its own boilerplate lines, by a key for the row.
    keyed = docs.withColumn("row_", F.xxhash64(*[F.col(f"`{n}`").cast("string") for n in names]))

    def own(part: pa.RecordBatch) -> dict:
        pairs = {(k, digest(x)) for k, t in zip(column(part, "row_").to_pylist(), strings(part, text_col), strict=True) for x in {y.strip(ENDS) for y in t.split("\n")} if x}
        return {"row_": [k for k, _ in pairs], "line": [x for _, x in pairs]}

    found = batches(keyed.select("row_", text_col), own, "row_ long, line binary").join(bad, "line", "left_semi").groupBy("row_").agg(F.collect_set("line").alias("bad_"))

    def clean_own(part: pa.RecordBatch) -> dict:
        return _cleaned(part, names, text_col, [{bytes(y) for y in x or ()} for x in column(part, "bad_").to_pylist()])

    return batches(keyed.join(found, "row_", "left").drop("row_"), clean_own, schema)


def _cleaned(part: pa.RecordBatch, names: list[str], text_col: str, bad: list) -> dict:
    out, n_lines, n_removed = [], [], []
    for text, sites in zip(column(part, text_col).to_pylist(), bad, strict=True):
        lines = [] if text is None else text.split("\n")
        kept, held = [], 0
        for x in lines:
            bare = x.strip(ENDS)
            held += bool(bare)
            if not bare or digest(bare) not in sites:
                kept.append(x)
        out.append(None if text is None else "\n".join(kept))
        n_lines.append(held)
        n_removed.append(len(lines) - len(kept))
    return {n: column(part, n) for n in names} | {text_col: out, "n_lines": n_lines, "n_removed": n_removed}
