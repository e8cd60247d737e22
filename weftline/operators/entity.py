"""Keyed tables: upserts, reconciliation, look-ups with a default, tenancy, job queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.values import SECOND


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The table with ``rows`` put in by key (unique on both sides). Columns of ``keep`` stay as they were where they were set."""
    joined = table.alias("o").join(rows.withColumn("_hit", F.lit(True)).alias("n"), keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in rows.columns:
            return F.col(f"o.{c}").alias(c)
        if c in keep:
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        return F.when(F.col("n._hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*[value(c) for c in table.columns])


def latest(rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """One row per key: the last one in the order of version (last write wins)."""
    order = W.partitionBy(*keys).orderBy(*version)
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def reconcile(table: DataFrame, rows: DataFrame, keys: list[str], scope: list[str], draft: Column) -> DataFrame:
    """upsert, and rows of the table go that are drafts, in a scope that ``rows`` covers, and not among its keys."""
    scopes = rows.select(*scope).distinct().withColumn("_in", F.lit(True))
    names = rows.select(*keys).distinct().withColumn("_named", F.lit(True))
    marked = table.join(scopes, scope, "left").join(names, keys, "left")
    kept = marked.where(F.coalesce("_named", F.lit(False)) | ~F.coalesce("_in", F.lit(False)) | ~draft).select(*table.columns)
    return upsert(kept, rows, keys)


def with_default(df: DataFrame, profiles: DataFrame, key: str, default: str) -> DataFrame:
    """Adds the columns of profiles: all rows of the own key if there are any, else all rows of the key ``default``."""
    own = profiles.select(key).distinct().withColumn("_own", F.lit(True))
    keyed = df.join(own, key, "left").withColumn("_use", F.when(F.col("_own"), F.col(key)).otherwise(F.lit(default))).drop("_own")
    right = profiles.withColumnRenamed(key, "_use").withColumn("profile", F.col("_use"))
    return keyed.join(right, "_use").drop("_use")


def visible(rows: DataFrame, members: DataFrame, user: str, roles: tuple[str, ...] = ("owner", "admin", "member"), tenant: str = "organization_id") -> DataFrame:
    """Rows of tenants in which the user has one of the roles."""
    mine = members.where((F.col("user_id") == user) & F.col("role").isin(*roles))
    return rows.join(mine.select(tenant).distinct(), tenant, "left_semi")


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Pending jobs, and those in work whose lease is set and over."""
    return jobs.where((F.col("status") == "pending") | (F.col("status").startswith("processing") & F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") < now)))


def queue_head(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The n oldest claimable jobs (a snapshot: no locks)."""
    return claimable(jobs, now).orderBy("created_at", "id").limit(n)


def claim(job: DataFrame, worker: str, token: Column, now: Column, lease_sec: int) -> DataFrame:
    """The claimed rows: token, worker, times and one more attempt; a lease is at least 30 seconds."""
    lease = now + max(30, lease_sec) * SECOND
    changed = {"claim_token": token, "claimed_by": F.lit(worker), "claimed_at": now, "lease_expires_at": lease, "status": F.lit("processing"), "attempt_count": F.col("attempt_count") + 1}
    return job.withColumns(changed)


def finish(jobs: DataFrame, token: Column, status: str) -> DataFrame:
    """Sets the status of the job that still has this token and clears its lease; other rows stay."""
    mine = F.coalesce(F.col("claim_token") == token, F.lit(False))
    out = jobs.withColumn("status", F.when(mine, F.lit(status)).otherwise(F.col("status")))
    return out.withColumn("lease_expires_at", F.when(~mine, F.col("lease_expires_at"))).withColumn("claim_token", F.when(~mine, F.col("claim_token")))


def digest(df: DataFrame, keys: list[str], line: Column, order: list[str]) -> DataFrame:
    """keys, digest: SHA-256 of the lines of each key in order, joined by newlines."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    text = F.array_join(F.transform(rows, lambda x: x["_line"]), "\n")
    return df.groupBy(*keys).agg(F.sha2(text, 256).alias("digest"))


def children(parents: DataFrame, rows: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Parents with an array of their children (structs of ``order`` and ``columns``), empty if there are none."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias(name))
    return parents.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))
