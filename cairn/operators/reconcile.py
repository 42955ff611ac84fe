"""Reconciliation of what is observed with what is known: the one primitive behind manifests, branches, symbols and dependencies.

Plain Parquet takes no MERGE, so a reconciliation is a full outer join on the key that returns the
next state, written as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(known: DataFrame, observed: DataFrame, keys: list[str], changed: list[str]) -> DataFrame:
    """One row per key with action: created, updated, unchanged or removed.

    known brings id and old values (old_*), observed the new ones (new_*); keys are null-safe by the
    caller's choice of columns. Shuffles both sides once, on the keys.
    """
    rest = [c for c in known.columns if c not in keys]
    old = known.select(*keys, *[F.col(c).alias(f"old_{c}") for c in rest], F.lit(True).alias("was"))
    new = observed.select(*keys, *[F.col(c).alias(f"new_{c}") for c in observed.columns if c not in keys], F.lit(True).alias("is"))
    both = old.join(new, keys, "full_outer")
    same = F.lit(True)
    for c in changed:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    action = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return both.withColumn("action", action).drop("was", "is")


def counts(reconciled: DataFrame, actions: tuple[str, ...] = ("created", "updated", "removed")) -> DataFrame:
    return reconciled.agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions])


def soft_deleted(known: DataFrame, observed: DataFrame, keys: list[str], columns: list[str], status: str = "status") -> DataFrame:
    """The next state of a table with soft deletes: observed rows are active (revived where deleted), unseen ones deleted; action tells what a row goes through."""
    both = reconcile(known, observed, keys, [])
    seen = F.col("action") != "removed"
    was = F.col(f"old_{status}")
    action = F.when(F.col("action") == "created", "created").when(seen & (was == "deleted"), "restored").when(seen, "seen").when(was == "deleted", "gone").otherwise("deleted")
    values: dict[str, Column] = {c: F.when(seen, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")) for c in columns}
    return both.select(*keys, F.col("old_id").alias("id"), *[v.alias(c) for c, v in values.items()], F.when(seen, "active").otherwise("deleted").alias(status), action.alias("action"))


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with those rows of new whose key it lacks; of several new rows with one key the smallest."""
    fresh = new.join(existing.select(*keys), keys, "left_anti")
    rest = [c for c in new.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else fresh.distinct()
    return existing.unionByName(first.select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """existing overwritten by new where keys meet; of several new rows the last by order."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in keys]), F.col(order)).alias("r")).select(*keys, "r.*")
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*existing.columns))
