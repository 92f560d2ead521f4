"""Filtered lists, details and report indexes over stored rows. Limits are the feature here: every list is a page or a top-n report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.functions import geo, rules
from evifuse.operators import graph, reports
from evifuse.operators.windows import latest


def rows_where(df: DataFrame, limit: int | None = None, order: tuple = (), most: int = 5000, **equal) -> DataFrame:
    """Rows whose columns equal the given values (None: any), in order, a page of at most ``limit``."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    df = df.orderBy(*order) if order else df
    return df if limit is None else df.limit(max(1, min(limit, most)))


def cameras(df: DataFrame, bbox: tuple[float, float, float, float] | None = None, limit: int | None = None, **equal) -> DataFrame:
    """Camera query: last seen first, never seen last."""
    if bbox:
        df = df.filter(geo.in_bbox(F.col("lon"), F.col("lat"), *bbox))
    return rows_where(df, limit, (F.desc_nulls_last("last_observed_at"), F.desc_nulls_last("updated_at"), "camera_key"), **equal)


def storage_objects(df: DataFrame, limit: int = 200, **equal) -> DataFrame:
    """Storage list: next to expire first, what never expires last."""
    return rows_where(df, limit, (F.asc_nulls_last("expires_at"), "storage_object_id"), **equal)


def candidates(df: DataFrame, revisions: DataFrame | None = None, campaign_id=None, run_id=None, min_score: float | None = None, limit: int = 200, **equal) -> DataFrame:
    """Candidate list: best score first; a campaign or run selects candidates with a revision in it."""
    for c, v in (("campaign_id", campaign_id), ("run_id", run_id)):
        if v is not None:
            df = df.join(revisions.filter(F.col(c) == v).select("candidate_id"), "candidate_id", "left_semi")
    if min_score is not None:
        df = df.filter(F.col("score") >= min_score)
    return rows_where(df, limit, (F.desc("score"), F.desc_nulls_last("updated_at"), "candidate_id"), **equal)


def providers(df: DataFrame, capability: str | None = None, jurisdiction: str | None = None, limit: int | None = None, **equal) -> DataFrame:
    for c, v in (("capabilities", capability), ("jurisdictions", jurisdiction)):
        if v is not None:
            df = df.filter(F.array_contains(c, v))
    return rows_where(df, limit, ("provider_id",), **equal)


def of_entity(edges: DataFrame, entity_id) -> DataFrame:
    """Edges with the entity at either end."""
    return edges.filter((F.col("subject_entity_id") == entity_id) | (F.col("object_entity_id") == entity_id))


def relevant_alerts(alerts: DataFrame, events: DataFrame, observations: DataFrame) -> DataFrame:
    """Alerts of the events, or triggered by the observations: two semi-joins, each alert once."""
    of_event = alerts.join(events.select("event_id").distinct(), "event_id", "left_semi").select("alert_id")
    triggered = alerts.join(observations.select(F.col("observation_id").alias("trigger_observation_id")).distinct(), "trigger_observation_id", "left_semi").select("alert_id")
    return alerts.join(of_event.union(triggered).distinct(), "alert_id", "left_semi")


CITED = ("observation_id", "source_domain", "layer_key", "confidence_score", "trust_level", "approval_policy", "observed_at")


def citations(members: DataFrame, key: str) -> DataFrame:
    """Products with one citation struct per observation, in order of observation."""
    cited = F.struct(*[c for c in CITED if c in members.columns])
    return members.groupBy(key).agg(F.array_sort(F.collect_list(cited)).alias("citations"))


def flatten_citations(products: DataFrame, order: str) -> DataFrame:
    """The first citation of each (observation, domain, layer) over products in order."""
    rows = products.select(order, F.posexplode("citations").alias("__at", "c"))
    first = rows.groupBy(*[F.col(f"c.{k}").alias(k) for k in ("observation_id", "source_domain", "layer_key")]).agg(F.min_by(F.struct("c"), F.struct(order, "__at")).alias("__r"))
    return first.select("__r.c.*")


def entity_profile(entity_id, aliases: DataFrame, edges: DataFrame, cites: DataFrame) -> DataFrame:
    """One row: aliases, incident edges, evidence count and the sorted citation links."""
    own, root = of_entity(edges, entity_id), F.lit(entity_id).alias("entity_id")
    found = own.select("assertion_id").join(cites, "assertion_id").agg(F.count("*").alias("evidence_count"), F.array_sort(F.collect_set("source_uri")).alias("provenance_links"))
    names = aliases.filter(F.col("entity_id") == entity_id).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    ids = own.agg(F.array_sort(F.collect_list("assertion_id")).alias("relationships"))
    return names.select(root, "*").join(ids.select(root, "*"), "entity_id").join(found.select(root, "*"), "entity_id")


def coverage_status(profile: DataFrame) -> DataFrame:
    """``insufficient_evidence`` where no relationship is visible or none is cited, else ``ok``."""
    none = (F.size("relationships") == 0) | (F.col("evidence_count") == 0)
    return profile.withColumn("status", F.when(none, "insufficient_evidence").otherwise("ok"))


def claim_next(queue: DataFrame, as_of: Column, limit: int = 1) -> DataFrame:
    """The next tasks to take: queued ones, and running ones whose lease has ended; highest priority, then oldest."""
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_expires_at") <= as_of))
    return queue.filter(free).orderBy(F.desc("priority"), "created_at", "task_id").limit(limit)


def next_run(reference: Column, interval_seconds: Column) -> Column:
    return reference + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.greatest(interval_seconds, F.lit(60)).cast("decimal(18,6)"))


def best_time(*values: Column) -> Column:
    """The latest of several time texts that parse; arrays of texts count as well when passed through ``F.array``."""
    return F.array_max(F.transform(F.array(*values), lambda v: F.try_to_timestamp(F.trim(v))))


def exportable(df: DataFrame, ceiling: str) -> DataFrame:
    """The rows, or an error that names a level above the ceiling: an export fails as a whole."""
    ok = rules.visible(F.col("redaction_level"), ceiling)
    fails = F.raise_error(F.concat(F.lit("redaction level above the ceiling: "), F.coalesce("redaction_level", F.lit("unknown"))))
    return df.filter(F.when(ok, True).otherwise(fails.cast("boolean")))


def run_counts(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs of the given tasks, and how many failed."""
    return runs.join(tasks.select("task_id").distinct(), "task_id", "left_semi").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"))


def top_sections(statuses: DataFrame, sections: dict[str, Column], order: tuple, limit: int = 25) -> DataFrame:
    """(section, position, rows of ``statuses``): the first ``limit`` rows of each test, by one window over what any test selects."""
    marked = statuses.withColumn("section", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in sections.items()]))))
    ranked = marked.withColumn("position", F.row_number().over(Window.partitionBy("section").orderBy(*order)))
    return ranked.filter(F.col("position") <= limit)


def source_index(statuses: DataFrame, limit: int = 25) -> DataFrame:
    """Stale, failing and unscheduled sources of ``reports.source_status``, by source."""
    tests = {"stale": F.col("stale"), "failing": F.col("failing"), "unscheduled": F.col("task_count") == 0}
    return top_sections(statuses, tests, ("source_id",), limit).select("section", "position", "source_id")


def scheduler_index(tasks: DataFrame, runs: DataFrame, as_of: Column, maintenance: tuple[str, ...], limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """(sections, totals): overdue, failing and maintenance tasks; runs, failures and those of maintenance tasks."""
    last = latest(runs.select("task_id", "task_run_id", "status"), ["task_id"], "task_run_id").select("task_id", F.col("status").alias("last_status"))
    due = reports.overdue(F.col("next_run_at"), F.col("interval_seconds"), as_of)
    upkeep = F.col("task_type").isin(*maintenance)
    tests = {"overdue": F.col("enabled") & F.coalesce(due, F.lit(False)), "failing": F.col("last_status") == "failed", "maintenance": upkeep}
    sections = top_sections(tasks.join(last, "task_id", "left"), tests, ("task_id",), limit).select("section", "position", "task_id")
    kinds = runs.join(tasks.select("task_id", upkeep.alias("upkeep")), "task_id", "left")
    failed, of_upkeep = F.col("status") == "failed", F.coalesce("upkeep", F.lit(False))
    totals = kinds.agg(F.count("*").alias("runs"), F.count_if(failed).alias("failed"), F.count_if(of_upkeep).alias("maintenance_runs"), F.count_if(of_upkeep & failed).alias("maintenance_failed"))
    return sections, totals


def discovery_index(found: DataFrame, health: DataFrame, as_of: Column, stale_hours: int = 24, limit: int = 25) -> DataFrame:
    """Failing, stale and due candidates, best score first. ``health(candidate_id, check_id, reachable, status)``."""
    last = latest(health, ["candidate_id"], "check_id").select("candidate_id", "reachable", F.col("status").alias("health_status"))
    unreachable = F.coalesce(~F.col("reachable") & (F.col("health_status") != "observed_reference"), F.lit(False))
    before = as_of - F.make_dt_interval(F.lit(0), F.lit(stale_hours))
    tests = {
        "failing": (F.col("failure_count") > 0) | unreachable,
        "stale": F.col("last_checked_at").isNull() | (F.col("last_checked_at") < before),
        "due": F.coalesce(F.col("next_revisit_at") <= as_of, F.lit(False)),
    }
    return top_sections(found.join(last, "candidate_id", "left"), tests, (F.desc("score"), "candidate_id"), limit).select("section", "position", "candidate_id", "score")


def camera_index(inventory: DataFrame, tasks_in_scope: DataFrame, runs: DataFrame, before: Column, limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """(stale cameras, totals of tasks in scope and their runs)."""
    stale = top_sections(inventory, {"stale": F.col("last_observed_at").isNull() | (F.col("last_observed_at") < before)}, (F.asc_nulls_first("last_observed_at"), "camera_key"), limit)
    scoped = tasks_in_scope.select("task_id").distinct()
    per = runs.groupBy("task_id").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"))
    totals = scoped.join(per, "task_id", "left").agg(F.count("*").alias("tasks"), F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
    return stale.select("position", "camera_key"), totals


def candidate_detail(candidate_id, parts: dict[str, tuple[DataFrame, str]], limit: int = 200) -> DataFrame:
    """(section, object_id): the latest rows of each part (table, id column) that belong to the candidate."""
    out = None
    for name, (df, key) in parts.items():
        own = df.filter(F.col("candidate_id") == candidate_id).orderBy(F.desc(key)).limit(limit).select(F.lit(name).alias("section"), F.col(key).cast("long").alias("object_id"))
        out = own if out is None else out.union(own)
    return out


def incident_counts(edges: DataFrame) -> DataFrame:
    """(entity_id, n) over both ends of every edge."""
    return graph.incident(edges).groupBy("entity_id").agg(F.count("*").alias("n"))
