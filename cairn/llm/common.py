"""Plumbing shared by the operators: table access, checkpoints, Arrow batches, hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that the word and normalisation rules name: U+0020 and U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"
#: Rows in one Arrow batch. Texts of any length may come, so batches hold few rows.
BATCH_ROWS = 512


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a Python worker, whatever the length of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) != BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a local one only where none is named."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if own is None:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        own = set_.get() if set_.isDefined() else None
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="cairn-shared-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def saved(df: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """df as a table written to the shared folder, so that lineage ends there and sizes are known to the planner.

    A checkpoint would keep the estimated sizes of the plan before it, which compound from join to
    join. The table goes when the innermost scope ends (keep: the one around it), or else with the
    driver; tables of a Scratch go with it.
    """
    spark = df.sparkSession
    path = path or fresh(spark)
    df.write.parquet(path)
    _tidied(spark)
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession) -> str:
    """A new path for a table in the shared folder."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are saved inside are deleted at the end, when what was made of them must be stored."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.pop()
        for path in own:
            _delete(spark, path)


class Scratch:
    """Tables of one computation: a slot that is written again gives up its earlier table, and drop() ends them all once the result is stored elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held, self.folder = spark, {}, f"{_folder(spark)}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame, slot: str | None = None) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        out = saved(df, path)
        if slot is not None:
            if slot in self.held:
                _delete(self.spark, self.held[slot])
            self.held[slot] = path
        return out

    def drop(self) -> None:
        _delete(self.spark, self.folder)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cairn-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_tidy: set[str] = set()


def _tidied(spark: SparkSession) -> None:
    """Delete the session's tables when the driver ends."""
    app = spark.sparkContext.applicationId
    if app in _tidy:
        return
    _tidy.add(app)
    folder = _folder(spark)

    def delete() -> None:
        if spark.sparkContext._jsc is not None:
            _delete(spark, folder)

    atexit.register(delete)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, size: int = 4 << 20) -> DataFrame:
    """Map Arrow batches through fn, which returns columns (a dict of arrays or lists) or None.

    A batch of more than BATCH_ROWS rows, or of more than size bytes, goes to fn in slices.
    """
    out_schema = _arrow_schema(df.sparkSession, schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in sliced(part, size=size):
                got = fn(piece)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([_array(got[f.name], f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, schema)


def sliced(part: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    if not part.num_rows:
        return
    step = max(1, min(rows, int(part.num_rows * size / max(part.nbytes, 1)) or 1))
    for at in range(0, part.num_rows, step):
        yield part.slice(at, step)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def texts(part: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The whole texts as UTF-8; null is empty."""
    return [x or b"" for x in part.column(part.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def strings(part: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in part.column(part.schema.get_field_index(name)).to_pylist()]


def column(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), vectorised; seed picks an independent one."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Ids that may be broadcast for a semi join (some 24 bytes each in memory); more are met by a shuffle.
BROADCAST_IDS = 1_000_000


def with_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """rows whose id_col is in ids (one column of that name, distinct, stored): without a shuffle of rows while ids are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), id_col, "left_semi")


#: A key of more than one row in SHARE, and of more than KEY_ROWS, is dealt over several tasks; fewer than SHARE keys can be so large.
SHARE, KEY_ROWS = 1_000, 64


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, size: str, deal: list[str], how: str = "inner", share: int = SHARE, key_rows: int = KEY_ROWS) -> DataFrame:
    """rows joined with facts (stored; one row a key, size: how many rows have it), without a task that gets all rows of a large key.

    Rows of a large key are dealt into salts by a hash of deal, and its fact is copied for each salt. A
    key is large with more than a share of the rows that facts counts, so there are fewer than share of
    them, which the driver names in the plan. Rows with a null key are dealt too; they meet nothing.
    """
    whole = facts.agg(F.sum(size).alias("n"), F.max(size).alias("most")).first()
    most = max(key_rows, (whole["n"] or 0) // share)
    salts = -(-(whole["most"] or 0) // most)
    large = [r[key] for r in facts.filter(F.col(size) > most).select(key).collect()] if salts > 1 else []
    hot = F.col(key).isin(large) if large else F.lit(False)
    hashed = F.xxhash64(*deal)
    salt = F.when(F.col(key).isNull(), F.pmod(hashed, F.lit(1 << 20))).when(hot, F.pmod(hashed, F.lit(max(salts, 1)))).otherwise(F.lit(0))
    copies = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(max(salts, 1) - 1))).otherwise(F.array(F.lit(0)))) if large else F.lit(0)
    return rows.withColumn("salt_", salt.cast("int")).join(facts.withColumn("salt_", copies), [key, "salt_"], how).drop("salt_")


#: Rows of a range whose running totals one task makes.
RANGE_ROWS = 100_000


def summed_before(df: DataFrame, order: list[Column], columns: list[str], rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df, which has as many rows, with <c>_before for each of columns: the sum of c over all rows before the row in this order, which has no ties.

    Rows are dealt into ranges of the order, a task for each; ranges are added up by their totals, one
    row for each range. The table with its ranges is written, so the ranges stay as they are.
    """
    ranges = max(1, -(-rows // range_rows))
    range_ = F.lit(0) if ranges == 1 else F.spark_partition_id()
    dealt = (df if ranges == 1 else df.repartitionByRange(ranges, *order)).withColumn("range_", range_)
    dealt = dealt if ranges == 1 else saved(dealt)
    earlier = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in columns})
    if ranges == 1:
        return own.drop("range_")
    sums = dealt.groupBy("range_").agg(*[F.sum(c).alias(f"{c}_sum_") for c in columns])
    ahead = Window.partitionBy(F.lit(0)).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("range_"), *[F.coalesce(F.sum(f"{c}_sum_").over(ahead), F.lit(0)).alias(f"{c}_base_") for c in columns])
    out = own.join(F.broadcast(sums), "range_")  # a row for each range
    return out.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_base_") for c in columns}).drop("range_", *[f"{c}_base_" for c in columns])
