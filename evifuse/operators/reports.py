"""Rollups: value counts, buckets in several dimensions, fleet summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.operators.windows import latest


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count by value; null and blank are unknown."""
    v = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("unknown"))
    return df.groupBy(v.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def buckets(df: DataFrame, dimensions: list[str], **measures: Column) -> DataFrame:
    """Measures by each dimension alone and overall, from one pass (grouping sets). Nulls are unknown."""
    d = df.withColumns({c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")) for c in dimensions})
    sets = [[F.col(c)] for c in dimensions] + [[]]
    agg = d.groupingSets(sets, *dimensions).agg(F.count("*").alias("total"), *[m.alias(n) for n, m in measures.items()], *[F.grouping(c).alias(f"__g_{c}") for c in dimensions])
    name, value = F.lit("all"), F.lit("all")
    for c in dimensions:
        name, value = F.when(F.col(f"__g_{c}") == 0, c).otherwise(name), F.when(F.col(f"__g_{c}") == 0, F.col(c)).otherwise(value)
    return agg.select(name.alias("dimension"), value.alias("value"), "total", *measures)


def source_status(sources: DataFrame, runs: DataFrame, tasks: DataFrame, as_of: Column, stale_hours: int) -> DataFrame:
    """Per source: latest run, last success, next schedule, stale and failing marks."""
    last = latest(runs.select("source_id", "source_run_id", "status", "started_at"), ["source_id"], "source_run_id").select("source_id", F.col("source_run_id").alias("latest_run_id"), F.col("status").alias("latest_status"))
    good = runs.filter("status = 'completed'").groupBy("source_id").agg(F.max_by(F.coalesce("finished_at", "started_at"), "source_run_id").alias("last_success_at"))
    plan = tasks.groupBy("source_id").agg(F.min("next_run_at").alias("next_run_at"), F.count("*").alias("task_count"))
    j = sources.join(last, "source_id", "left").join(good, "source_id", "left").join(plan, "source_id", "left").fillna(0, ["task_count"])
    limit = as_of - F.make_dt_interval(F.lit(0), F.lit(stale_hours))
    return j.withColumn("stale", F.col("last_success_at").isNull() | (F.col("last_success_at") < limit)).withColumn("failing", F.coalesce(F.col("latest_status") == "failed", F.lit(False)))


def overdue(next_run: Column, interval_seconds: Column, as_of: Column) -> Column:
    return next_run + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.greatest(interval_seconds, F.lit(60)).cast("decimal(18,6)")) <= as_of


def operations(facts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row per named fact: its rows and those that match; each fact is one aggregate."""
    out = None
    for name, (df, test) in facts.items():
        row = df.agg(F.count("*").alias("total"), F.count_if(test).alias("matched")).select(F.lit(name).alias("fact"), "total", "matched")
        out = row if out is None else out.union(row)
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def custody(log: DataFrame, *, object_type=None, object_id=None, actor=None, action=None, start=None, end=None, limit: int = 200) -> DataFrame:
    for c, v in (("object_type", object_type), ("object_id", object_id), ("actor", actor), ("action", action)):
        if v is not None:
            log = log.filter(F.col(c) == v)
    if start is not None:
        log = log.filter(F.col("created_at") >= start)
    if end is not None:
        log = log.filter(F.col("created_at") <= end)
    return log.orderBy(F.desc("created_at"), F.desc("custody_id")).limit(max(1, min(limit, 5000)))
