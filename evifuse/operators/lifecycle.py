"""Details, health and lifecycle of sources, candidates and investigations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import rules
from evifuse.operators import discovery


def source_detail(runs: DataFrame, storage: DataFrame, custody: DataFrame, source_id: int, most: int = 25) -> DataFrame:
    """(section, object_id): the latest runs of a source, their storage objects, and the custody rows of all three."""
    last = runs.filter(F.col("source_id") == source_id).orderBy(F.desc("source_run_id")).limit(most).select(F.col("source_run_id").alias("object_id"))
    owner = storage.filter("owner_type = 'source_run'").select("storage_object_id", F.col("owner_id").try_cast("long").alias("object_id"))
    kept = owner.join(F.broadcast(last), "object_id", "left_semi").select(F.col("storage_object_id").alias("object_id"))
    about = lambda kind, ids: ids.select(F.lit(kind).alias("object_type"), F.col("object_id").cast("string").alias("object_id"))
    named = about("source_run", last).union(about("storage_object", kept)).union(about("source", last.select(F.lit(source_id).alias("object_id"))).distinct())
    logged = custody_of(custody, named).select(F.col("custody_id").alias("object_id"))
    return last.select(F.lit("run").alias("section"), "object_id").union(kept.select(F.lit("storage"), "object_id")).union(logged.select(F.lit("custody"), "object_id"))


def custody_of(log: DataFrame, objects: DataFrame) -> DataFrame:
    """Custody rows of (object_type, object_id) pairs."""
    return log.join(objects, ["object_type", "object_id"], "left_semi")


def readiness(attempts: DataFrame, promoted: DataFrame, min_evidence: int = 1, min_sources: int = 2) -> DataFrame:
    """Progress of each investigation from its attempts and promoted evidence."""
    done = F.col("status") == "completed"
    uri = F.nullif(F.lower(F.trim("source_uri")), F.lit(""))
    tried = attempts.groupBy("investigation_id").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("status").isin("queued", "running")).alias("pending"), F.count_if(~done).alias("gap_count"), F.countDistinct(F.when(done, uri)).alias("independent_source_count")
    )
    found = promoted.groupBy("investigation_id").agg(F.count("*").alias("evidence_count"))
    j = tried.join(found, "investigation_id", "full_outer").fillna(0)
    ready = (F.col("evidence_count") >= max(1, min_evidence)) & (F.col("independent_source_count") >= max(1, min_sources))
    outcome = F.when(ready, "ready").when((F.col("attempts") > 0) & (F.col("pending") == 0), "insufficient_evidence").otherwise("continue")
    return j.select("investigation_id", "evidence_count", "independent_source_count", "gap_count", outcome.alias("next_outcome"))


def provider_health(providers: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts, failures and state of ``providers(provider_id, enabled)``."""
    n = attempts.groupBy("provider_id").agg(F.count("*").alias("attempt_count"), F.count_if(F.col("status") == "failed").alias("failure_count"))
    j = providers.join(n, "provider_id", "left").fillna(0, ["attempt_count", "failure_count"])
    state = rules.first_reason((F.col("failure_count") > 0, "degraded"), (F.col("attempt_count") > 0, "healthy"), (~F.col("enabled"), "disabled"), otherwise="unknown")
    return j.withColumn("state", state)


def kind_gaps(providers: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Source kinds of the vocabulary that no enabled provider covers."""
    wanted = providers.sparkSession.createDataFrame([(k,) for k in vocabulary], "source_kind string")
    return wanted.join(providers.filter("enabled").select("source_kind"), "source_kind", "left_anti")


def release_expired(candidates: DataFrame, suppressions: DataFrame, as_of: Column) -> DataFrame:
    """Suppressed candidates that only elapsed suppressions cover, with the status they return to."""
    active = suppressions.filter("status = 'active'")
    elapsed = active.filter(F.col("expires_at") <= as_of).withColumn("expires_at", F.lit(None).cast("timestamp"))
    freed = discovery.suppressed(candidates, elapsed, as_of).join(discovery.suppressed(candidates, active, as_of), "candidate_id", "left_anti")
    back = discovery.status(F.col("score_bucket"), F.coalesce("trust_level", F.lit("neutral")), F.lit(None).cast("string"))
    held = candidates.filter("status = 'suppressed'").join(freed, "candidate_id", "left_semi")
    return held.withColumn("status", F.when(F.col("promoted_source_id").isNotNull(), "promoted").otherwise(back))


def promotion_decision(status: Column, kind: Column, interval_seconds: Column, supported: list[str], reference_only: list[str]) -> Column:
    """Ordered promotion rules; kinds that are only referenced promote disabled."""
    return rules.first_reason(
        (status.isin("suppressed", "quarantined"), "rejected_status"),
        (~kind.isin(*supported, *reference_only), "unsupported_kind"),
        (interval_seconds < 60, "interval_too_short"),
        (kind.isin(*reference_only), "promoted_disabled"),
        otherwise="promoted",
    )


def revisit_plan(candidates: DataFrame, as_of: Column, force: bool = False) -> DataFrame:
    """Candidates to check again: not suppressed, and due unless forced."""
    live = candidates.filter(F.coalesce(F.col("status") != "suppressed", F.lit(True)))
    return live if force else live.filter(F.col("next_revisit_at").isNull() | (F.col("next_revisit_at") <= as_of))


def campaign_counts(revisions: DataFrame, campaign: str = "campaign_id") -> DataFrame:
    """Distinct candidates of each campaign, and how many have each latest status."""
    by_status = revisions.groupBy(campaign, "candidate_id").agg(F.max_by("status", "revision_id").alias("status"))
    states = [F.count_if(F.col("status") == s).alias(f"{s}_status_count") for s in ("candidate", "promoted", "suppressed")]
    return by_status.groupBy(campaign).agg(F.count("*").alias("candidate_count"), *states)


def validate_records(records: DataFrame, expected_version: str, fields: list[str], required: list[str]) -> DataFrame:
    """Adds ``quarantine_reason`` to (payload, schema_version): other version, not an object, unknown or missing fields."""
    keys = F.json_object_keys("payload")
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    reason = rules.first_reason(
        (~F.col("schema_version").eqNullSafe(F.lit(expected_version)), "schema version mismatch"),
        (keys.isNull(), "not an object"),
        (F.size(F.array_except(keys, lit(fields))) > 0, "unknown fields"),
        (F.size(F.array_except(lit(required), keys)) > 0, "missing fields"),
        otherwise="",
    )
    return records.withColumn("quarantine_reason", F.nullif(reason, F.lit("")))


def watch_alerts(alerts: DataFrame, watch_id: int, basis: str = "trigger_basis_json") -> DataFrame:
    """Alerts whose trigger names the watch."""
    return alerts.filter(F.try_variant_get(F.try_parse_json(basis), "$.watch_id", "bigint") == watch_id)


def scan_totals(checks: DataFrame) -> DataFrame:
    """Checked, reachable, failing and changed rows of a health scan."""
    return checks.agg(F.count("*").alias("checked"), F.count_if("reachable").alias("reachable"), F.count_if(~F.col("reachable")).alias("failing"), F.count_if(F.col("result").isin("changed", "schema_changed")).alias("changed"))
