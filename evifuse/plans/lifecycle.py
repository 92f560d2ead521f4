"""Queries of details, health, lifecycles and text signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.functions import signals
from evifuse.functions import text as tx
from evifuse.operators import lifecycle
from evifuse.plans.registry import query
from evifuse.plans.views import view
from evifuse.session import table

HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '')"


@query(
    """SELECT investigation_id, evidence_count, independent_source_count, gap_count, CASE WHEN evidence_count >= 10 AND independent_source_count >= 5 THEN 'ready' WHEN a > 0 AND p = 0 THEN 'insufficient_evidence' ELSE 'continue' END AS next_outcome FROM (
SELECT user_id AS investigation_id, count(*) FILTER (event_type = 'purchase') AS evidence_count, count(DISTINCT concat('s', event_id % 7)) FILTER (event_type = 'view') AS independent_source_count, count(*) FILTER (event_type NOT IN ('view', 'purchase')) AS gap_count,
count(*) FILTER (event_type <> 'purchase') AS a, count(*) FILTER (event_type = 'click') AS p FROM events GROUP BY 1)""",
)
def readiness(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "investigation_id")
    status = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "click", "queued").otherwise("failed")
    tried = e.filter("event_type <> 'purchase'").select("investigation_id", status.alias("status"), F.concat(F.lit(" S"), (F.col("event_id") % 7).cast("string"), F.lit(" ")).alias("source_uri"))
    return lifecycle.readiness(tried, e.filter("event_type = 'purchase'"), 10, 5)


@query(
    """p AS (SELECT c_custkey AS provider_id, c_acctbal >= 0 AS enabled FROM customer), a AS (SELECT user_id AS provider_id, count(*) AS n, count(*) FILTER (layer_key = 'error') AS f FROM obs GROUP BY 1)
SELECT provider_id, coalesce(n, 0) AS attempt_count, coalesce(f, 0) AS failure_count, CASE WHEN f > 0 THEN 'degraded' WHEN n > 0 THEN 'healthy' WHEN NOT enabled THEN 'disabled' ELSE 'unknown' END AS state FROM p LEFT JOIN a USING (provider_id)""",
    ("obs",),
)
def provider_health(spark, d):
    o = view(spark, d, "obs")
    providers = table(spark, d, "customer").select(F.col("c_custkey").alias("provider_id"), (F.col("c_acctbal") >= 0).alias("enabled"))
    tried = o.select(F.col("user_id").alias("provider_id"), F.when(F.col("layer_key") == "error", "failed").otherwise("completed").alias("status"))
    return lifecycle.provider_health(providers, tried).select("provider_id", "attempt_count", "failure_count", "state")


@query(
    f"""SELECT page_id AS candidate_id, CASE WHEN page_id % 5 = 0 THEN 'promoted' WHEN page_id % 3 = 0 THEN 'ignored' WHEN page_id % 3 = 1 THEN 'deferred' ELSE 'candidate' END AS status
FROM (SELECT page_id, {HOST} AS h FROM pages) WHERE (h = 'example.com' OR ends_with(h, '.example.com')) AND h <> 'spam-farm.example.com'"""
)
def released_candidates(spark, d):
    i = F.col("page_id")
    c = table(spark, d, "pages").select(
        i.alias("candidate_id"), tx.normalize_domain(F.col("url")).alias("domain"), F.col("url").alias("canonical_url"), F.lit("suppressed").alias("status"),
        F.when(i % 3 == 0, "ignore").when(i % 3 == 1, "revisit_later").otherwise("keep_candidate").alias("score_bucket"), F.lit(None).cast("string").alias("trust_level"), F.when(i % 5 == 0, i).alias("promoted_source_id"),
    )
    rows = [("domain", "example.com", "2020-01-01", "active"), ("domain", "spam-farm.example.com", None, "active"), ("domain", "example.net", "2030-01-01", "active"), ("domain", "example.org", "2020-01-01", "expired")]
    s = spark.createDataFrame(rows, "scope string, value string, e string, status string").withColumn("expires_at", F.to_timestamp("e"))
    return lifecycle.release_expired(c, s, F.lit("2024-01-01").cast("timestamp")).select("candidate_id", "status")


@query(
    """r AS (SELECT source_run_id AS i FROM runs WHERE source_id = 7 ORDER BY 1 DESC LIMIT 25), s AS (SELECT storage_object_id AS i FROM storage WHERE storage_object_id IN (SELECT i FROM r)),
c AS (SELECT event_id AS i FROM events WHERE (event_type = 'view' AND user_id = 7) OR (event_type = 'click' AND event_id IN (SELECT i FROM r)) OR (event_type = 'purchase' AND event_id IN (SELECT i FROM s)))
SELECT 'run' AS section, i AS object_id FROM r UNION ALL SELECT 'storage', i FROM s UNION ALL SELECT 'custody', i FROM c""",
    ("runs", "storage"),
)
def source_detail(spark, d):
    s = view(spark, d, "storage").select("storage_object_id", F.lit("source_run").alias("owner_type"), F.col("storage_object_id").cast("string").alias("owner_id"))
    kind = F.expr("CASE event_type WHEN 'view' THEN 'source' WHEN 'click' THEN 'source_run' WHEN 'purchase' THEN 'storage_object' ELSE 'other' END")
    log = table(spark, d, "events").select(F.col("event_id").alias("custody_id"), kind.alias("object_type"), F.when(kind == "source", F.col("user_id")).otherwise(F.col("event_id")).cast("string").alias("object_id"))
    return lifecycle.source_detail(view(spark, d, "runs"), s, log, 7)


@query("last AS (SELECT run_id, candidate_id, arg_max(status, revision_id) AS s FROM revisions GROUP BY 1, 2) SELECT run_id, count(*) AS candidate_count, count(*) FILTER (s = 'candidate') AS candidate_status_count, count(*) FILTER (s = 'promoted') AS promoted_status_count, count(*) FILTER (s = 'suppressed') AS suppressed_status_count FROM last GROUP BY 1", ("revisions",))
def campaign_counts(spark, d):
    return lifecycle.campaign_counts(view(spark, d, "revisions"), "run_id")


@query("SELECT CASE WHEN status = 'suppressed' THEN 'rejected_status' WHEN score_bucket = '5-LOW' THEN 'unsupported_kind' WHEN candidate_id % 100 < 60 THEN 'interval_too_short' WHEN score_bucket = '1-URGENT' THEN 'promoted_disabled' ELSE 'promoted' END AS decision, count(*) AS n FROM revisions GROUP BY 1", ("revisions",))
def promotion_decisions(spark, d):
    r = view(spark, d, "revisions")
    rule = lifecycle.promotion_decision(F.col("status"), F.col("score_bucket"), F.col("candidate_id") % 100, ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], ["1-URGENT"])
    return r.groupBy(rule.alias("decision")).agg(F.count("*").alias("n"))


@query("SELECT event_id, 20.0::DOUBLE + (event_id % 40) AS lat, CAST(-(user_id % 90) AS DOUBLE) AS lon, concat('Route ', user_id) AS route FROM events")
def text_coordinates(spark, d):
    s = lambda c: c.cast("string")
    lat, lon = s(20 + F.col("event_id") % 40), s(-(F.col("user_id") % 90))
    t = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("seen lat: "), lat, F.lit(", lon="), lon)).otherwise(F.concat(F.lit("at longitude="), lon, F.lit(" and latitude: "), lat))
    e = table(spark, d, "events").withColumn("t", F.concat(t, F.lit("; near Route "), s(F.col("user_id"))))
    return e.select("event_id", F.get(signals.text_points(F.col("t")), F.lit(0)).alias("p"), F.get(signals.routes(F.col("t")), F.lit(0)).alias("route")).select("event_id", "p.lat", "p.lon", "route")


@query("SELECT o_orderkey, concat(strftime(o_orderdate, '%Y-%m-%dT'), '09:', lpad((o_orderkey % 60)::VARCHAR, 2, '0'), ':00+02:00') AS stamp FROM orders")
def compact_timestamps(spark, d):
    o = table(spark, d, "orders")
    clock = F.concat(F.lit("09"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    return o.select("o_orderkey", signals.compact_timestamp(F.date_format("o_orderdate", "yyyyMMdd"), clock, F.lit("+0200")).alias("stamp"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def nested_values(spark, d):
    deep = F.concat(F.lit('{"x": [1, {"y": '), F.col("props"), F.lit("}]}"))
    return table(spark, d, "events").select("event_id", signals.nested_value(deep, "k").alias("k"))


@query("SELECT sha256('OBJECT<k: NUMBER>') AS fingerprint, count(*) AS n FROM events")
def schema_fingerprints(spark, d):
    return table(spark, d, "events").groupBy(signals.json_fingerprint(F.col("props")).alias("fingerprint")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_id % 5 = 0 THEN 'schema version mismatch' WHEN event_id % 5 = 1 THEN 'unknown fields' WHEN event_id % 5 = 2 THEN 'not an object' END AS quarantine_reason, count(*) AS n FROM events GROUP BY 1")
def record_validation(spark, d):
    i = F.col("event_id") % 5
    payload = F.when(i == 1, '{"k": 1, "z": 2}').when(i == 2, "[1]").otherwise(F.col("props"))
    r = table(spark, d, "events").select(payload.alias("payload"), F.when(i == 0, "v1").otherwise("v2").alias("schema_version"))
    return lifecycle.validate_records(r, "v2", ["k"], ["k"]).groupBy("quarantine_reason").agg(F.count("*").alias("n"))


@query(
    """SELECT CASE WHEN lon BETWEEN -95.5 AND -94.6 AND lat BETWEEN 29.4 AND 30.2 THEN 100.0::DOUBLE WHEN layer_key = 'click' AND source_domain = 's3.example.com' THEN 95.0::DOUBLE WHEN layer_key = 'click' THEN 92.0::DOUBLE WHEN source_domain = 's3.example.com' THEN 90.0::DOUBLE ELSE 8.0::DOUBLE END AS score, count(*) AS n FROM obs GROUP BY 1""",
    ("obs",),
)
def geo_relevance(spark, d):
    o = view(spark, d, "obs")
    points = F.array(F.struct("lat", "lon"))
    score = signals.geo_relevance(points, F.array("source_domain"), F.array("layer_key"), F.array().cast("array<string>"), F.lit("point"), {"bbox": (-95.5, 29.4, -94.6, 30.2), "jurisdictions": ["CLICK"], "places": ["S3-Example-Com"]})
    return o.groupBy(score.alias("score")).agg(F.count("*").alias("n"))
