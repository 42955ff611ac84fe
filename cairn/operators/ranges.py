"""Numbers of rows within keys, dealt over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.store import stored

#: Rows of a range in which rows of one key are numbered.
RANGE_ROWS = 500_000


def numbered(rows: DataFrame, key: str, order: list[str], name: str, n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows (n of them) with name, their number (from 0) within key in an order without ties; a key of many rows is dealt over many tasks.

    Rows are dealt into ranges of (key, order), numbered inside each, and moved on by how many rows of
    the key lie in the ranges before: a row for each range and key.
    """
    ranges = max(1, -(-n // range_rows))
    if ranges == 1:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    dealt = stored(rows.repartitionByRange(ranges, key, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("nth_", F.row_number().over(Window.partitionBy("range_", key).orderBy(*order)) - 1)
    sums = dealt.groupBy("range_", key).agg(F.count(F.lit(1)).alias("held_"))
    ahead = Window.partitionBy(key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base_", F.coalesce(F.sum("held_").over(ahead), F.lit(0))).select("range_", F.col(key).alias("key_"), "base_")
    met = inside.join(base, (inside["range_"] == base["range_"]) & inside[key].eqNullSafe(base["key_"])).drop(base["range_"])
    return met.withColumn(name, (F.col("nth_") + F.col("base_")).cast("int")).drop("range_", "key_", "nth_", "base_")
