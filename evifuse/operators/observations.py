"""Observation intake and query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import geo, rules
from evifuse.functions import text as tx


def query(df: DataFrame, *, layer: str | None = None, domain: str | None = None, trust: str | None = None, start=None, end=None, bbox: tuple | None = None, time_column: str = "observed_at", limit: int | None = 200) -> DataFrame:
    """Filtered listing, newest first; all predicates are plain comparisons that reach the scan."""
    for column, value in (("layer_key", layer), ("source_domain", domain), ("trust_level", trust)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if start is not None:
        df = df.filter(F.col(time_column) >= start)
    if end is not None:
        df = df.filter(F.col(time_column) <= end)
    if bbox is not None:
        df = df.filter(geo.in_bbox(F.col("lon"), F.col("lat"), *bbox))
    return df.orderBy(F.desc(time_column), F.desc("observation_id")).limit(limit) if limit is not None else df


def normalize_records(df: DataFrame, payload: str, layer_key: str) -> DataFrame:
    """JSON records to observations: domain, text, point, time, hash, ground truth. Unknown JSON gives null fields."""
    v = lambda k: F.try_variant_get(F.try_parse_json(payload), f"$.{k}", "string")
    point = geo.valid_point(F.coalesce(v("latitude"), v("lat")), F.coalesce(v("longitude"), v("lon")))
    times = ("observed_at", "occurred_at", "event_time", "timestamp", "published_at", "datetime", "detected_at")
    truths = ("ground_truth", "is_ground_truth", "verified_on_scene", "direct_observation")
    return df.select(
        "*",
        F.lit(layer_key).alias("layer_key"),
        tx.extract_domain(*[v(k) for k in tx.URL_KEYS]).alias("source_domain"),
        tx.content_text(v("text"), v("title"), F.col(payload)).alias("content_text"),
        F.get(point, F.lit(0)).alias("lon"),
        F.get(point, F.lit(1)).alias("lat"),
        rules.parse_time(F.coalesce(*[v(k) for k in times])).alias("observed_at"),
        rules.is_true(F.coalesce(*[v(k) for k in truths])).alias("ground_truth"),
        tx.record_hash(F.col(payload)).alias("raw_hash"),
    )


def dedupe(incoming: DataFrame, stored: DataFrame | None = None, keys=("layer_key", "raw_hash"), order: str | None = None) -> DataFrame:
    """One row per key, none that is stored already."""
    keys = list(keys)
    once = incoming.dropDuplicates(keys) if order is None else incoming.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in incoming.columns if c not in keys]), order).alias("__r")).select(*keys, "__r.*")
    return once if stored is None else once.join(stored.select(*keys).distinct(), keys, "left_anti")


def import_counters(incoming: DataFrame, imported: DataFrame) -> DataFrame:
    """seen = imported + skipped."""
    seen = incoming.agg(F.count("*").alias("seen"))
    return seen.crossJoin(imported.agg(F.count("*").alias("imported"))).withColumn("skipped", F.col("seen") - F.col("imported"))


def skip_unchanged(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """Scans whose payload hash differs from the latest completed or skipped run of the source."""
    last = runs.filter(F.col("status").isin("completed", "skipped")).groupBy("source_id").agg(F.max_by("payload_sha256", "source_run_id").alias("payload_sha256"))
    return scans.join(last, ["source_id", "payload_sha256"], "left_anti")


def fact_rows(df: DataFrame, created_at: str = "created_at") -> DataFrame:
    """Rows for the columnar store: the event time falls back to the creation time."""
    return df.withColumn("observed_at", F.coalesce("observed_at", created_at)).withColumn("lon", F.col("lon").cast("double")).withColumn("lat", F.col("lat").cast("double"))


def fact_defaults(df: DataFrame) -> DataFrame:
    """Defaults on the way back."""
    return df.withColumn("trust_level", F.coalesce("trust_level", F.lit("neutral"))).withColumn("approval_policy", F.coalesce("approval_policy", F.lit("manual_review"))).withColumn("confidence_score", F.coalesce("confidence_score", F.lit(0.0)))


def rule_predicate(rule: dict) -> Column:
    """Compile a rule ``{all: [...]}``, ``{any: [...]}`` or ``{field, op, value}`` into one predicate."""
    if "all" in rule or "any" in rule:
        parts = [rule_predicate(r) for r in rule.get("all", rule.get("any"))]
        out = F.lit("all" in rule)
        for p in parts:
            out = (out & p) if "all" in rule else (out | p)
        return out
    c, v = F.col(rule["field"]), rule.get("value")
    ops = {
        "eq": lambda: c == v,
        "ne": lambda: c != v,
        "gt": lambda: c > v,
        "gte": lambda: c >= v,
        "lt": lambda: c < v,
        "lte": lambda: c <= v,
        "in": lambda: c.isin(*v),
        "contains": lambda: F.contains(F.lower(c), F.lit(str(v).lower())),
        "exists": lambda: c.isNotNull(),
    }
    return F.coalesce(ops[rule["op"]](), F.lit(False))
