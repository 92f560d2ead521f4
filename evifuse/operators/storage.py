"""Storage ledger: expiry, sweep, promotion, registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import rules


def with_expiry(objects: DataFrame, explicit: str | None = None) -> DataFrame:
    return objects.withColumn("expires_at", rules.expires_at(F.col("retention_class"), F.col("observed_at"), F.col(explicit) if explicit else None))


def expired(status: Column, expires_at: Column, as_of: Column) -> Column:
    return (status == "expired") | F.coalesce(expires_at <= as_of, F.lit(False))


def sweep(objects: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The next objects to expire: by expiry, then id."""
    due = objects.filter((F.col("lifecycle_status") != "expired") & (F.col("expires_at") <= as_of))
    return due.orderBy("expires_at", "storage_object_id").limit(limit).withColumn("lifecycle_status", F.lit("expired"))


def report(objects: DataFrame, as_of: Column) -> DataFrame:
    """Totals by class, by tier, by status and overall, in one pass."""
    o = objects.withColumn("__x", expired(F.col("lifecycle_status"), F.col("expires_at"), as_of))
    o.createOrReplaceTempView("__storage_objects")
    agg = o.groupingSets([[F.col("retention_class")], [F.col("storage_tier")], [F.col("lifecycle_status")], []], "retention_class", "storage_tier", "lifecycle_status").agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("total"),
        F.count_if("__x").alias("expired"),
        F.min(F.when(~F.col("__x"), F.col("expires_at"))).alias("next_expiry"),
    )
    dim = F.when(F.col("g") == 3, "retention_class").when(F.col("g") == 5, "storage_tier").when(F.col("g") == 6, "lifecycle_status").otherwise("all")
    return agg.select(dim.alias("dimension"), F.coalesce("retention_class", "storage_tier", "lifecycle_status", F.lit("all")).alias("value"), "total", "expired", (F.col("total") - F.col("expired")).alias("active"), "next_expiry")


def promote(objects: DataFrame, retention: str, tier: str) -> DataFrame:
    """New class and tier; the expiry follows, none for permanent."""
    out = objects.withColumn("retention_class", F.lit(retention)).withColumn("storage_tier", F.lit(tier)).withColumn("lifecycle_status", F.lit("promoted"))
    return with_expiry(out)


def register(stored: DataFrame, fresh: DataFrame, key: str = "object_key") -> DataFrame:
    """Upsert by key."""
    old = stored.join(fresh.select(key), key, "left_anti")
    return old.unionByName(fresh)
