"""Lifecycle of job rows as frame transformations. Times are given, never read from a clock; locking is the driver's business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(now: int) -> Column:
    return (F.col("status") == "queued") & ~F.col("cancel_requested") & (F.col("attempt_count") < F.col("max_attempts")) & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= now))


def claim_next(jobs: DataFrame, now: int) -> DataFrame:
    """The oldest job that may run."""
    return jobs.filter(eligible(now)).orderBy("created", "id").limit(1)


def after_failure(retryable: Column) -> Column:
    return F.when(F.col("cancel_requested"), "cancelled").when(retryable & (F.col("attempt_count") < F.col("max_attempts")), "queued").otherwise("failed")


def failed(jobs: DataFrame, retryable: Column) -> DataFrame:
    """Running jobs that fail, with next_status."""
    return jobs.filter("status = 'running'").withColumn("next_status", after_failure(retryable))


def expired(jobs: DataFrame, now: int) -> DataFrame:
    """All running jobs whose lease has ended, with next_status."""
    return jobs.filter((F.col("status") == "running") & (F.col("lease_expires") <= now)).withColumn("next_status", after_failure(F.lit(True)))


def recovered(jobs: DataFrame, now: int, batch: int) -> DataFrame:
    """The batch of expired jobs that one pass recovers, oldest lease first."""
    return expired(jobs, now).orderBy("lease_expires", "id").limit(batch)


def balanced() -> Column:
    return (F.col("processed_files") + F.col("skipped_files") + F.col("failed_files") == F.col("total_files")) & (F.col("failed_files") == 0)


def completable(jobs: DataFrame) -> DataFrame:
    """Running jobs that may succeed: finalizing, counters balanced, none failed, not cancelled."""
    return jobs.filter((F.col("status") == "running") & (F.col("phase") == "finalizing") & ~F.col("cancel_requested") & balanced())


def cancelled(jobs: DataFrame) -> DataFrame:
    """What a request to cancel does: queued jobs end, running ones are flagged, others stay."""
    return jobs.withColumns({"next_status": F.when(F.col("status") == "queued", "cancelled").otherwise(F.col("status")), "flagged": F.col("status").isin("queued", "running") | F.col("cancel_requested")})


def heartbeat(jobs: DataFrame, worker: str, now: int, lease: int) -> DataFrame:
    """lease_expires after a beat of worker: only the owner's running jobs whose lease still holds are extended."""
    own = (F.col("status") == "running") & (F.col("worker") == worker) & (F.col("lease_expires") > now)
    return jobs.withColumn("lease_expires", F.when(own, F.lit(now + lease).cast("long")).otherwise(F.col("lease_expires")))


def retried(jobs: DataFrame) -> DataFrame:
    """New queued rows for jobs that failed or were cancelled, linked to them."""
    return jobs.filter(F.col("status").isin("failed", "cancelled")).select(F.col("id").alias("retry_of"), F.lit("queued").alias("status"), F.lit(0).cast("long").alias("attempt_count"), "max_attempts")
