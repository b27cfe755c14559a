"""Shared workspaces: which ones a user sees, who may do what, and removal with everything that belongs to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The roles that each capability is open to.
CAPABILITIES = {
    "read": ("viewer", "operator", "admin"),
    "write": ("operator", "admin"),
    "execute": ("operator", "admin"),
    "manage_engagement": ("operator", "admin"),
    "manage_users": ("admin",),
}


def visible(spaces: DataFrame, runs: DataFrame, members: DataFrame, user: int | None = None) -> DataFrame:
    """spaces(id, owner_id, created_at, ...) with run_count, newest first; with a user, those they own or belong to.

    runs(space_id) are counted before the join; members(space_id, user_id) is a semi-join, so a user who owns a
    space and belongs to it sees it once.
    """
    if user is not None:
        own = members.where(F.col("user_id") == user).select(F.col("space_id").alias("id")).unionByName(spaces.where(F.col("owner_id") == user).select("id"))
        spaces = spaces.join(own, "id", "left_semi")
    counts = runs.groupBy(F.col("space_id").alias("id")).agg(F.count(F.lit(1)).alias("run_count"))
    return spaces.join(counts, "id", "left").fillna(0, ["run_count"]).orderBy(F.desc("created_at"), "id")


def access(requests: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """requests(user_id, user_role, space_id, ...) with `allowed`: administrators everywhere, others where they own
    the space or belong to it; never where the user is null."""
    owners = spaces.select(F.col("id").alias("space_id"), "owner_id").dropDuplicates(["space_id"])
    belongs = members.select("space_id", "user_id").distinct().withColumn("belongs", F.lit(True))
    rows = requests.join(owners, "space_id", "left").join(belongs, ["space_id", "user_id"], "left")
    inside = F.col("owner_id").isNotNull() & (F.col("owner_id") == F.col("user_id")) | F.col("belongs").isNotNull() & F.col("owner_id").isNotNull()
    admin = F.coalesce(F.col("user_role") == "admin", F.lit(False))
    return rows.withColumn("allowed", F.col("user_id").isNotNull() & (admin | F.coalesce(inside, F.lit(False)))).select(*requests.columns, "allowed")


def role_can(role: Column, capability: Column) -> Column:
    """Whether a role has a capability; false for unknown ones and nulls."""
    open_to = F.create_map(*[x for k, v in CAPABILITIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(open_to, capability), role), F.lit(False))


def without(rows: DataFrame, removed: DataFrame, key: str = "space_id") -> DataFrame:
    """rows less those of removed(id): apply it to each table of a workspace to delete it with what it holds."""
    return rows.join(removed.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(rows.columns)


def row_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) for each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
