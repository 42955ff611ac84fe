from types import SimpleNamespace

from cairn.plans.ops import job_retry


def test_job_retry_takes_every_expired_job(spark):
    n = 1_000_003
    jobs = spark.range(n).selectExpr("id", "'running' AS status", "id % 500 AS lease_expires", "true AS cancel_requested", "0L AS attempt_count", "3L AS max_attempts")
    assert job_retry(SimpleNamespace(jobs=jobs)).count() == n
