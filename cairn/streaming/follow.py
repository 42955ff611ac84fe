"""Continuous mode: new snapshot files are taken up as they arrive, a micro-batch a version.

The batch operators stay as they are; this is only the seam. A file that was seen is not taken again
(the stream's checkpoint), and a version that was written before a failure is written again alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cairn.sources.store import Store


def follow(spark: SparkSession, incoming: str, schema: StructType | str, store: Store, checkpoint: str, derive: Callable[[DataFrame], DataFrame], first_version: int = 1, files_a_batch: int = 1000) -> StreamingQuery:
    """Start taking up Parquet files under incoming: each batch becomes a published version of store, made by derive."""

    def take(batch: DataFrame, number: int) -> None:
        version = first_version + number
        if store.published(version) or batch.isEmpty():
            return  # a retry after the version was published
        store.write(version, derive(batch))
        store.publish(version)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(incoming)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
