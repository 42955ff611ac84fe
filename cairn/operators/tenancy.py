"""Users, roles, permissions, sessions and audit, as scoped queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def permissions(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Distinct permissions of each user."""
    return user_roles.join(role_permissions, "role_id").select("user_id", "permission").distinct()


def has_all(granted: DataFrame, required: list[str]) -> DataFrame:
    """Users and whether they hold all required permissions (relational division; all of none is true)."""
    own = F.collect_set("permission")
    return granted.groupBy("user_id").agg((F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), own)) == 0).alias("allowed"))


def owners(users: DataFrame, user_roles: DataFrame, roles: DataFrame, role: str = "OWNER") -> DataFrame:
    """Active holders of a role by organisation."""
    holding = user_roles.join(roles.filter(F.col("name") == role).select(F.col("id").alias("role_id")), "role_id").select(F.col("user_id").alias("id"))
    return users.filter("status = 'active'").join(holding, "id").groupBy("organization_id").agg(F.count_distinct("id").alias("owners"))


def last_owner_guard(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Owners and whether they may lose the role: another active owner must remain."""
    held = user_roles.join(roles.filter("name = 'OWNER'").select(F.col("id").alias("role_id")), "role_id").select(F.col("user_id").alias("id"))
    return users.join(held, "id", "left_semi").join(owners(users, user_roles, roles), "organization_id", "left").select("id", (F.coalesce("owners", F.lit(0)) - F.when(F.col("status") == "active", 1).otherwise(0) > 0).alias("removable"))


def with_roles(page: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """A page of users with their role names, sorted: the page is cut by users before roles are joined."""
    named = user_roles.join(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), "role_id")
    held = page.select("id").join(named.select(F.col("user_id").alias("id"), "role"), "id").groupBy("id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return page.join(held, "id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


def rotation(now: Column, token: Column) -> Column:
    """What a presented refresh token does to a session."""
    gone = F.col("revoked").isNotNull() | (F.col("expires") <= now)
    return F.when(gone, "invalid").when(F.col("token") != token, "reused").otherwise("rotated")


def active_sessions(sessions: DataFrame, now: int) -> DataFrame:
    return sessions.filter((F.col("expires") > now) & F.col("revoked").isNull())


def session_order() -> list[Column]:
    return [F.desc_nulls_last("last_used"), F.desc("created_at"), F.desc("id")]


def revoked(sessions: DataFrame, user: Column, now: int) -> DataFrame:
    """All unrevoked sessions of a user ended at now."""
    return sessions.withColumn("revoked", F.when((F.col("user_id") == user) & F.col("revoked").isNull(), F.lit(now).cast("long")).otherwise(F.col("revoked")))


def identities(sessions: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """Active sessions of active users."""
    own = users.filter("status = 'active'").select(F.col("id").alias("user_id"), "email")
    return active_sessions(sessions, now).join(own, "user_id")


def branch_health(branches: DataFrame) -> DataFrame:
    """Branches of each repository: all, active ones, default ones and when the last was synchronised."""
    return branches.groupBy("repository_id").agg(F.count(F.lit(1)).alias("branches"), F.count_if(F.col("status") == "active").alias("active"), F.count_if("is_default").alias("defaults"), F.max("synced").alias("last_synced"))


def with_branch_health(repositories: DataFrame, branches: DataFrame) -> DataFrame:
    """repositories with their branches and active ones; 0 without any."""
    own = branch_health(branches).select(F.col("repository_id").alias("id"), "branches", "active")
    return repositories.join(own, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("branches", "active")})
