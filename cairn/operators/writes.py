"""State changes and appends as frame transformations: synchronised repositories, invitations, errors and audit rows. Times are given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Outcomes of an audit row.
OUTCOMES = ("success", "failure")


def synchronized(repositories: DataFrame, states: DataFrame, now: int) -> DataFrame:
    """repositories after attempts to synchronise some of them.

    states: id, ok, seen_branch, seen_bytes. Success sets status, times and size, and the default branch
    where one was seen; failure sets the status and the time of the attempt alone; others stay.
    """
    met = repositories.join(states.select("id", F.col("ok").alias("ok_"), "seen_branch", "seen_bytes"), "id", "left")
    tried, fine = F.col("ok_").isNotNull(), F.coalesce("ok_", F.lit(False))
    at = F.lit(now).cast("long")
    return met.withColumns(
        {
            "status": F.when(fine, "synced").when(tried, "failed").otherwise(F.col("status")),
            "attempted_at": F.when(tried, at).otherwise(F.col("attempted_at")),
            "synced_at": F.when(fine, at).otherwise(F.col("synced_at")),
            "size_bytes": F.when(fine, F.col("seen_bytes")).otherwise(F.col("size_bytes")),
            "default_branch": F.when(fine, F.coalesce("seen_branch", "default_branch")).otherwise(F.col("default_branch")),
        }
    ).drop("ok_", "seen_branch", "seen_bytes")


def invited(invitations: DataFrame, users: DataFrame, roles: DataFrame, now: int, lifetime: int) -> DataFrame:
    """invitations (organization_id, email, token, role_ids) with result: created, email_taken or unknown_role; and for those created token_hash and expires.

    A role must belong to the organisation; an address must be free in all organisations, and of several
    invitations to one the least token has it. The token itself is stored nowhere.
    """
    address = F.lower(F.trim(F.col("email")))
    own = invitations.withColumns({"email": address, "token_hash": F.sha2("token", 256)})
    asked = own.select("organization_id", "token", F.explode(F.array_distinct("role_ids")).alias("role_id"))
    known = asked.join(roles.select("organization_id", F.col("id").alias("role_id")), ["organization_id", "role_id"], "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("known_"))
    taken = users.select(F.lower("email").alias("email"), F.lit(True).alias("taken_")).distinct()
    first = own.groupBy("email").agg(F.min("token").alias("first_"))
    met = own.join(known, "token", "left").join(taken, "email", "left").join(first, "email")
    result = F.when(F.coalesce("taken_", F.lit(False)) | (F.col("token") != F.col("first_")), "email_taken").when(F.coalesce("known_", F.lit(0)) != F.size("role_ids"), "unknown_role").otherwise("created")
    made = F.col("result") == "created"
    out = met.withColumn("result", result)
    return out.select("organization_id", "email", "result", F.when(made, F.col("token_hash")).alias("token_hash"), F.when(made, F.lit(now + lifetime).cast("long")).alias("expires"))


def accepted(users: DataFrame, tokens: DataFrame, now: int) -> DataFrame:
    """users (status, token_hash, token_expires) after tokens (token) were presented: a known one that hasn't expired makes its user active, once."""
    shown = tokens.select(F.sha2("token", 256).alias("token_hash"), F.lit(True).alias("shown_")).distinct()
    fine = F.coalesce("shown_", F.lit(False)) & (F.col("token_expires") > now)
    met = users.join(shown, "token_hash", "left").withColumn("fine_", F.coalesce(fine, F.lit(False)))
    none = lambda c: F.when(~F.col("fine_"), F.col(c))
    out = met.withColumns({"status": F.when(F.col("fine_"), "active").otherwise(F.col("status")), "token_hash": none("token_hash"), "token_expires": none("token_expires"), "accepted_at": F.when(F.col("fine_"), F.lit(now).cast("long"))})
    return out.drop("shown_", "fine_")


def with_errors(errors: DataFrame, new: DataFrame, jobs: DataFrame, now: int) -> DataFrame:
    """errors (job_id, worker, code) and those of new whose worker owns the job's lease at now."""
    owned = jobs.filter((F.col("status") == "running") & (F.col("lease_expires") > now)).select(F.col("id").alias("job_id"), "worker")
    return errors.unionByName(new.join(owned, ["job_id", "worker"], "left_semi").select(*errors.columns))


def with_audit(audit: DataFrame, events: DataFrame, types: list[str]) -> DataFrame:
    """audit (id, event_type, outcome, identifier_hash) and a row for each of events (id, event_type, outcome, identifier) of a known type and outcome; identifiers are hashed, and what isn't known is left out, as audit never fails a request."""
    fine = events.filter(F.col("event_type").isin(*types) & F.col("outcome").isin(*OUTCOMES))
    return audit.unionByName(fine.select("id", "event_type", "outcome", F.sha2(F.lower(F.trim("identifier")), 256).alias("identifier_hash")))
