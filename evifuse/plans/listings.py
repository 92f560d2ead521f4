"""Lists, details and report indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.operators import cameras, listings, reports
from evifuse.plans.fleet import AS_OF, AS_OF_US, CAMERA_SQL, HOUR, STORAGE_AS_OF_US, _cameras, _micros
from evifuse.plans.registry import query
from evifuse.plans.views import view

#: Sections of statuses: the first rows of each.
TOP = "SELECT section, CAST(position AS INT) AS position, {what} FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY {order}) AS position FROM ({parts})) WHERE position <= {limit}"


def _top(parts: dict[str, str], source: str, order: str, what: str, limit: int = 25) -> str:
    return TOP.format(parts=" UNION ALL ".join(f"SELECT '{n}' AS section, * FROM {source} WHERE {test}" for n, test in parts.items()), order=order, what=what, limit=limit)


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(
    f"""last AS (SELECT source_id, arg_max(status, source_run_id) AS latest_status, arg_max(started_us, source_run_id) FILTER (status = 'completed') AS us FROM runs GROUP BY 1),
st AS (SELECT source_id, us IS NULL OR us < {AS_OF_US - 6 * HOUR} AS stale, latest_status = 'failed' AS failing, source_id % 4 = 0 AS loose FROM last) """
    + _top({"stale": "stale", "failing": "failing", "unscheduled": "loose"}, "st", "source_id", "source_id"),
    ("runs",),
)
def source_report_index(spark, d):
    runs = view(spark, d, "runs").withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    tasks = runs.filter("source_id % 4 <> 0").select("source_id", F.col("started_at").alias("next_run_at"))
    return listings.source_index(reports.source_status(runs.select("source_id").distinct(), runs, tasks, _now(), 6))


def _tasks(spark, d):
    t = view(spark, d, "runs").groupBy(F.col("source_id").alias("task_id")).agg(F.max("started_at").alias("m"))
    kind = F.when(F.col("task_id") % 5 == 0, "storage_cleanup").otherwise("source_sync")
    return t.withColumn("next_run_at", F.expr("m + make_dt_interval(0, 0, cast(task_id % 2000 as int))")).withColumn("interval_seconds", (60 * (F.col("task_id") % 30)).cast("int")).withColumn("task_type", kind).withColumn("enabled", F.col("task_id") % 7 != 0)


def _task_runs(spark, d):
    return view(spark, d, "runs").select(F.col("source_id").alias("task_id"), F.col("source_run_id").alias("task_run_id"), "status", "started_at")


@query(
    f"""t AS (SELECT source_id AS task_id, max(started_us) + 60000000 * (source_id % 2000) + 1000000 * greatest(60 * (source_id % 30), 60) AS due, arg_max(status, source_run_id) AS s FROM runs GROUP BY source_id) """
    + _top({"overdue": f"task_id % 7 <> 0 AND due <= {AS_OF_US}", "failing": "s = 'failed'", "maintenance": "task_id % 5 = 0"}, "t", "task_id", "task_id"),
    ("runs",),
)
def scheduler_report_index(spark, d):
    return listings.scheduler_index(_tasks(spark, d), _task_runs(spark, d), _now(), ("storage_cleanup",))[0]


@query("SELECT count(*) AS runs, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (source_id % 5 = 0) AS maintenance_runs, count(*) FILTER (source_id % 5 = 0 AND status = 'failed') AS maintenance_failed FROM runs", ("runs",))
def scheduler_report_totals(spark, d):
    return listings.scheduler_index(_tasks(spark, d), _task_runs(spark, d), _now(), ("storage_cleanup",))[1]


@query(
    """c AS (SELECT candidate_id, arg_max(score, revision_id) AS score, candidate_id % 13 = 0 AS broken, max(revision_id) AS r FROM revisions GROUP BY 1) """
    + _top({"failing": "broken OR r % 17 = 0", "stale": "candidate_id % 6 = 0 OR candidate_id % 10 = 1", "due": "candidate_id % 4 = 1"}, "c", "score DESC, candidate_id", "candidate_id, score"),
    ("revisions",),
)
def discovery_report_index(spark, d):
    r = view(spark, d, "revisions")
    i = F.col("candidate_id")
    day = lambda n: _now() + F.make_dt_interval(F.lit(n))
    found = r.groupBy("candidate_id").agg(F.max_by("score", "revision_id").alias("score")).withColumn("failure_count", F.when(i % 13 == 0, 2).otherwise(0))
    found = found.withColumn("last_checked_at", F.when(i % 6 != 0, F.when(i % 10 == 1, day(-2)).otherwise(day(0)))).withColumn("next_revisit_at", F.when(i % 4 < 2, F.when(i % 4 == 1, day(-1)).otherwise(day(1))))
    health = r.select("candidate_id", F.col("revision_id").alias("check_id"), (F.col("revision_id") % 17 != 0).alias("reachable"), F.lit("checked").alias("status"))
    return listings.discovery_index(found, health, _now())


@query(f"{CAMERA_SQL} SELECT camera_key, t_us FROM inv WHERE layer_key = 'click' AND active AND lon BETWEEN -95.5 AND -94.5 AND lat BETWEEN 29.2 AND 30.4 ORDER BY t_us DESC, camera_key LIMIT 50", ("obs",))
def camera_query(spark, d):
    inv = cameras.inventory(_cameras(spark, d)).withColumn("updated_at", F.col("last_observed_at"))
    got = listings.cameras(inv, (-95.5, 29.2, -94.5, 30.4), 50, layer_key="click", active=True)
    return got.select("camera_key", _micros("last_observed_at").alias("t_us"))


@query(f"{CAMERA_SQL} SELECT CAST(row_number() OVER (ORDER BY t_us, camera_key) AS INT) AS position, camera_key FROM inv WHERE t_us < {AS_OF_US - 24 * HOUR} ORDER BY 1 LIMIT 25", ("obs",))
def camera_report_index(spark, d):
    inv = cameras.inventory(_cameras(spark, d))
    return listings.camera_index(inv, _tasks(spark, d), _task_runs(spark, d), _now() - F.expr("INTERVAL 24 HOURS"))[0]


@query("SELECT count(DISTINCT source_id) AS tasks, count(*) AS runs, count(*) FILTER (status = 'failed') AS failed FROM runs WHERE source_id % 3 = 1", ("runs",))
def camera_report_totals(spark, d):
    inv = cameras.inventory(_cameras(spark, d))
    return listings.camera_index(inv, _tasks(spark, d).filter("task_id % 3 = 1"), _task_runs(spark, d), _now())[1]


@query(f"SELECT storage_object_id, storage_tier FROM storage WHERE storage_tier = 'cold' AND lifecycle_status = 'active' ORDER BY CASE WHEN retention_class = 'permanent' THEN NULL ELSE observed_us END NULLS LAST, storage_object_id LIMIT 200", ("storage",))
def storage_list(spark, d):
    o = view(spark, d, "storage").withColumn("expires_at", F.when(F.col("retention_class") != "permanent", F.col("observed_at")))
    return listings.storage_objects(o, storage_tier="cold", lifecycle_status="active").select("storage_object_id", "storage_tier")


@query("c AS (SELECT candidate_id, max(score) AS score FROM revisions WHERE status = 'candidate' GROUP BY 1) SELECT candidate_id, score FROM c WHERE score >= 100000 AND candidate_id IN (SELECT candidate_id FROM revisions WHERE run_id = 1997) ORDER BY score DESC, candidate_id LIMIT 200", ("revisions",))
def candidate_list(spark, d):
    r = view(spark, d, "revisions")
    best = r.filter("status = 'candidate'").groupBy("candidate_id").agg(F.max("score").alias("score")).withColumn("updated_at", F.lit(AS_OF))
    return listings.candidates(best, r, run_id=1997, min_score=100000.0).select("candidate_id", "score")


@query("SELECT section, object_id FROM (SELECT 'revision' AS section, revision_id AS object_id FROM revisions WHERE candidate_id = 7 ORDER BY 2 DESC LIMIT 200) UNION ALL SELECT section, object_id FROM (SELECT 'promotion' AS section, revision_id AS object_id FROM revisions WHERE candidate_id = 7 AND status = 'promoted' ORDER BY 2 DESC LIMIT 200)", ("revisions",))
def candidate_detail(spark, d):
    r = view(spark, d, "revisions")
    return listings.candidate_detail(7, {"revision": (r, "revision_id"), "promotion": (r.filter("status = 'promoted'"), "revision_id")})


@query("SELECT observation_id AS alert_id FROM obs WHERE user_id % 11 = 0 OR (observation_id + 1) IN (SELECT observation_id FROM obs WHERE layer_key = 'error')", ("obs",))
def event_alerts(spark, d):
    """Alerts of some events, or triggered by an observation of one layer."""
    o = view(spark, d, "obs")
    alerts = o.select(F.col("observation_id").alias("alert_id"), F.col("user_id").alias("event_id"), (F.col("observation_id") + 1).alias("trigger_observation_id"))
    return listings.relevant_alerts(alerts, o.filter("user_id % 11 = 0").select(F.col("user_id").alias("event_id")), o.filter("layer_key = 'error'")).select("alert_id")


@query("SELECT DISTINCT observation_id, source_domain, layer_key FROM obs", ("obs",))
def cited_observations(spark, d):
    """Two products cite every observation; the first citation stays."""
    o = view(spark, d, "obs")
    twice = o.withColumn("product_id", F.explode(F.array(F.col("user_id"), F.col("user_id") + 1000)))
    return listings.flatten_citations(listings.citations(twice, "product_id"), "product_id").select("observation_id", "source_domain", "layer_key")


@query(
    """own AS (SELECT assertion_id FROM assertions WHERE subject_entity_id = 3 OR object_entity_id = 3)
SELECT 3::BIGINT AS entity_id, (SELECT count(*) FROM own) AS relationships, count(*) AS evidence_count, count(DISTINCT source_uri) AS links, CASE WHEN count(*) = 0 THEN 'insufficient_evidence' ELSE 'ok' END AS status FROM own JOIN citations USING (assertion_id)""",
    ("assertions", "citations"),
)
def entity_profile(spark, d):
    aliases = spark.createDataFrame([(3, "Three"), (3, "Drei"), (4, "Four")], "entity_id long, alias string")
    p = listings.coverage_status(listings.entity_profile(F.lit(3).cast("long"), aliases, view(spark, d, "assertions"), view(spark, d, "citations")))
    return p.select(F.col("entity_id").cast("long").alias("entity_id"), F.size("relationships").cast("long").alias("relationships"), "evidence_count", F.size("provenance_links").cast("long").alias("links"), "status")


@query(f"SELECT storage_object_id AS task_id FROM storage WHERE storage_object_id % 3 = 0 OR (storage_object_id % 3 = 1 AND observed_us <= {STORAGE_AS_OF_US}) ORDER BY storage_object_id % 10 DESC, observed_us, storage_object_id LIMIT 20", ("storage",))
def queue_claims(spark, d):
    i = F.col("storage_object_id")
    q = view(spark, d, "storage").select(i.alias("task_id"), F.when(i % 3 == 0, "queued").when(i % 3 == 1, "running").otherwise("done").alias("status"), F.col("observed_at").alias("lease_expires_at"), (i % 10).alias("priority"), F.col("observed_at").alias("created_at"))
    return listings.claim_next(q, F.lit("2000-01-01").cast("timestamp_ntz"), 20).select("task_id")
