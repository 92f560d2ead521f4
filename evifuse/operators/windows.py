"""Latest-per-key, versions and change outcomes. Latest rows are aggregates (max_by), so a hot key needs no sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str | Column, where: Column | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``. Combined before the shuffle."""
    if where is not None:
        df = df.filter(where)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, "__row.*")


def first_seen(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")


def replace_by_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version per sort key, deterministically."""
    return latest(df, keys, version)


def change_outcomes(runs: DataFrame, key: str, order: str, fingerprint: str, completed: Column) -> DataFrame:
    """Compare each completed run with the completed run before it: baseline, change or no_change."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(fingerprint).over(w)
    outcome = F.when(before.isNull(), "baseline").when(before != F.col(fingerprint), "change").otherwise("no_change")
    return runs.filter(completed).withColumn("outcome", outcome)


def number_revisions(existing: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """Continue the revision numbers of each key."""
    top = existing.groupBy(key).agg(F.max("revision_number").alias("__top"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return fresh.join(top, key, "left").withColumn("revision_number", (F.coalesce("__top", F.lit(0)) + n).cast("long")).drop("__top")


def per_group_limit(df: DataFrame, group: list[str], order: list[Column], cap: Column | int) -> DataFrame:
    """At most ``cap`` rows of each group in order."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__n") <= cap).drop("__n")
