"""Columnar store and archive: partitioned Parquet, replace-by-version on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.operators.windows import replace_by_version

VERSION_KEY = ["layer_key", "observed_at", "observation_id"]


def write_facts(df: DataFrame, path: str, mode: str = "append") -> None:
    """Monthly partitions, clustered within: one writer per month range, so files stay few and sorted."""
    out = df.withColumn("yyyymm", F.date_format("observed_at", "yyyyMM"))
    out.repartitionByRange("yyyymm", "layer_key", "observed_at").sortWithinPartitions("layer_key", "observed_at", "observation_id").write.mode(mode).partitionBy("yyyymm").parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return replace_by_version(spark.read.parquet(path).drop("yyyymm"), VERSION_KEY, "updated_at")


def export(df: DataFrame, path: str, mode: str = "append") -> None:
    """``layer=<clean key>/date=<day>`` partitions; the key itself stays a column."""
    out = df.withColumn("layer", F.regexp_replace("layer_key", "[^A-Za-z0-9_-]+", "_")).withColumn("date", F.to_date("observed_at"))
    out.repartitionByRange("layer", "date", "observed_at").write.mode(mode).partitionBy("layer", "date").parquet(path)


def read_archive(spark: SparkSession, path: str, layer_key: str | None = None, start=None, end=None) -> DataFrame:
    """Prunes partitions by layer and day, then filters exactly."""
    df = spark.read.parquet(path)
    if layer_key is not None:
        df = df.filter(F.col("layer") == F.regexp_replace(F.lit(layer_key), "[^A-Za-z0-9_-]+", "_")).filter(F.col("layer_key") == layer_key)
    if start is not None:
        df = df.filter((F.col("date") >= F.to_date(F.lit(start))) & (F.col("observed_at") >= F.lit(start)))
    if end is not None:
        df = df.filter((F.col("date") <= F.to_date(F.lit(end))) & (F.col("observed_at") <= F.lit(end)))
    return df.drop("layer", "date")


def layer_counts(df: DataFrame, top: int = 100) -> DataFrame:
    return df.groupBy("layer_key").agg(F.count("*").alias("row_count")).orderBy(F.desc("row_count"), "layer_key").limit(top)


def mirror(df: DataFrame, path: str, limit: int) -> None:
    """The newest rows by update time."""
    df.orderBy(F.desc("updated_at"), F.desc("observation_id")).limit(limit).write.mode("append").parquet(path)


def snapshot(tables: dict[str, DataFrame], path: str, replace: bool = False) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite" if replace else "errorifexists").parquet(f"{path}/{name}")


def restore(spark: SparkSession, names: list[str], path: str) -> dict[str, DataFrame]:
    """Tables in the order of their dependencies."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def event_bundle(events: DataFrame, links: DataFrame, observations: DataFrame, ceiling: str | None = "public") -> DataFrame:
    """One JSON document per event with its visible observations."""
    from evifuse.functions import rules

    shown = observations.filter(rules.visible(F.col("redaction_level"), ceiling))
    parts = links.join(shown, "observation_id").groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("observation_id", "layer_key", "source_domain"))).alias("observations"))
    return events.join(parts, "slug", "left").select("slug", F.to_json(F.struct("slug", "observations")).alias("bundle"))
