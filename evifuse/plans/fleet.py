"""Fleet queries: runs, tasks, storage, cameras, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.functions import rules
from evifuse.operators import cameras, observations, planning, reports, storage, watches, windows
from evifuse.plans.registry import query
from evifuse.plans.views import view

AS_OF = "2024-01-25 00:00:00"
AS_OF_US = 1706140800000000
STORAGE_AS_OF_US = 946684800000000  # 2000-01-01
HOUR = 3_600_000_000


def _micros(c):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


@query("SELECT source_id, max(source_run_id) AS source_run_id, arg_max(status, source_run_id) AS status FROM runs GROUP BY 1", ("runs",))
def latest_run_per_source(spark, d):
    return windows.latest(view(spark, d, "runs").select("source_id", "source_run_id", "status"), ["source_id"], "source_run_id")


@query("SELECT source_id, arg_max(started_us, source_run_id) AS last_success_us FROM runs WHERE status = 'completed' GROUP BY 1", ("runs",))
def latest_success(spark, d):
    return windows.latest(view(spark, d, "runs").select("source_id", "source_run_id", "started_us", "status"), ["source_id"], "source_run_id", F.col("status") == "completed").select("source_id", F.col("started_us").alias("last_success_us"))


@query("SELECT source_id, min(source_run_id) AS source_run_id, arg_min(layer_key, source_run_id) AS layer_key FROM runs GROUP BY 1", ("runs",))
def first_run_per_source(spark, d):
    return windows.first_seen(view(spark, d, "runs").select("source_id", "source_run_id", "layer_key"), ["source_id"], "source_run_id")


@query("SELECT source_run_id, CASE WHEN b IS NULL THEN 'baseline' WHEN b <> payload_sha256 THEN 'change' ELSE 'no_change' END AS outcome FROM (SELECT *, lag(payload_sha256) OVER (PARTITION BY source_id ORDER BY source_run_id) AS b FROM runs WHERE status = 'completed')", ("runs",))
def change_outcomes(spark, d):
    return windows.change_outcomes(view(spark, d, "runs"), "source_id", "source_run_id", "payload_sha256", F.col("status") == "completed").select("source_run_id", "outcome")


@query("last AS (SELECT source_id, arg_max(payload_sha256, source_run_id) AS h FROM runs WHERE status IN ('completed', 'skipped') GROUP BY 1) SELECT r.source_run_id FROM runs r LEFT JOIN last l USING (source_id) WHERE r.status = 'failed' AND (l.h IS NULL OR l.h <> r.payload_sha256)", ("runs",))
def skip_unchanged_scans(spark, d):
    runs = view(spark, d, "runs")
    return observations.skip_unchanged(runs.filter("status = 'failed'").select("source_id", "source_run_id", "payload_sha256"), runs).select("source_run_id")


@query(
    """s AS (SELECT source_id, arg_max(source_kind, source_run_id) AS kind, arg_max(layer_key, source_run_id) AS layer, arg_max(status, source_run_id) AS st FROM runs GROUP BY 1)
SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(layer) = 0 THEN 'layer' WHEN grouping(st) = 0 THEN 'latest_status' ELSE 'all' END AS dimension, coalesce(kind, layer, st, 'all') AS value, count(*) AS total, count(*) FILTER (st = 'failed') AS failing FROM s GROUP BY GROUPING SETS ((kind), (layer), (st), ())""",
    ("runs",),
)
def source_summary(spark, d):
    last = windows.latest(view(spark, d, "runs").select("source_id", "source_run_id", "source_kind", "layer_key", "status"), ["source_id"], "source_run_id")
    s = last.select(F.col("source_kind").alias("kind"), F.col("layer_key").alias("layer"), F.col("status").alias("latest_status"))
    return reports.buckets(s.withColumn("bad", F.col("latest_status") == "failed"), ["kind", "layer", "latest_status"], failing=F.count_if("bad"))


@query("SELECT source_kind AS value, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1", ("runs",))
def run_buckets(spark, d):
    got = reports.buckets(view(spark, d, "runs"), ["source_kind"], completed=F.count_if(F.col("status") == "completed"), failed=F.count_if(F.col("status") == "failed"))
    return got.filter("dimension = 'source_kind'").drop("dimension")


@query(
    f"""tasks AS (SELECT source_id, max(started_us) + 60000000 * (source_id % 2000) AS next_us, 60 * (source_id % 30) AS every FROM runs GROUP BY source_id)
SELECT count(*) AS total, count(*) FILTER (source_id % 7 <> 0) AS enabled, count(*) FILTER (next_us <= {AS_OF_US}) AS due, count(*) FILTER (next_us + 1000000 * greatest(every, 60) <= {AS_OF_US}) AS overdue FROM tasks""",
    ("runs",),
)
def scheduler_summary(spark, d):
    t = view(spark, d, "runs").groupBy("source_id").agg(F.max("started_at").alias("m"))
    t = t.withColumn("next", F.expr("m + make_dt_interval(0, 0, cast(source_id % 2000 as int))")).withColumn("every", (60 * (F.col("source_id") % 30)).cast("int"))
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return t.agg(F.count("*").alias("total"), F.count_if(F.col("source_id") % 7 != 0).alias("enabled"), F.count_if(F.col("next") <= as_of).alias("due"), F.count_if(reports.overdue(F.col("next"), F.col("every"), as_of)).alias("overdue"))


@query(
    f"""last AS (SELECT source_id, max(source_run_id) AS latest_run_id, arg_max(status, source_run_id) AS latest_status FROM runs GROUP BY 1),
good AS (SELECT source_id, arg_max(started_us, source_run_id) AS us FROM runs WHERE status = 'completed' GROUP BY 1)
SELECT source_id, latest_run_id, latest_status, us AS last_success_us, us IS NULL OR us < {AS_OF_US - 48 * HOUR} AS stale, coalesce(latest_status = 'failed', false) AS failing FROM last LEFT JOIN good USING (source_id)""",
    ("runs",),
)
def source_status(spark, d):
    runs = view(spark, d, "runs").withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    tasks = runs.select("source_id", F.col("started_at").alias("next_run_at"))
    got = reports.source_status(runs.select("source_id").distinct(), runs, tasks, F.lit(AS_OF).cast("timestamp_ntz"), 48)
    return got.select("source_id", "latest_run_id", "latest_status", _micros("last_success_at").alias("last_success_us"), "stale", "failing")


@query("SELECT 'runs' AS fact, count(*) AS total, count(*) FILTER (status = 'failed') AS matched FROM runs UNION ALL SELECT 'storage', count(*), count(*) FILTER (lifecycle_status = 'expired') FROM storage UNION ALL SELECT 'observations', count(*), count(*) FILTER (ground_truth) FROM obs", ("runs", "storage", "obs"))
def operations_report(spark, d):
    return reports.operations({"runs": (view(spark, d, "runs"), F.col("status") == "failed"), "storage": (view(spark, d, "storage"), F.col("lifecycle_status") == "expired"), "observations": (view(spark, d, "obs"), F.col("ground_truth"))})


@query("SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts(spark, d):
    from evifuse.session import table

    return reports.table_counts({n: table(spark, d, n) for n in ("orders", "events", "documents")})


EXPIRY_SQL = "CASE retention_class WHEN 'ephemeral' THEN observed_us + 24 * 3600000000 WHEN 'operational' THEN observed_us + 168 * 3600000000 WHEN 'investigative' THEN observed_us + 720 * 3600000000 END"


@query(
    f"""o AS (SELECT *, {EXPIRY_SQL} AS e FROM storage), x AS (SELECT *, lifecycle_status = 'expired' OR coalesce(e <= {STORAGE_AS_OF_US}, false) AS dead FROM o)
SELECT CASE WHEN grouping(retention_class) = 0 THEN 'retention_class' WHEN grouping(storage_tier) = 0 THEN 'storage_tier' WHEN grouping(lifecycle_status) = 0 THEN 'lifecycle_status' ELSE 'all' END AS dimension, coalesce(retention_class, storage_tier, lifecycle_status, 'all') AS value, count(*) AS total, count(*) FILTER (dead) AS expired, count(*) FILTER (NOT dead) AS active, min(CASE WHEN NOT dead THEN e END) AS next_expiry_us
FROM x GROUP BY GROUPING SETS ((retention_class), (storage_tier), (lifecycle_status), ())""",
    ("storage",),
)
def storage_report(spark, d):
    got = storage.report(storage.with_expiry(view(spark, d, "storage")), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return got.select("dimension", "value", "total", "expired", "active", _micros("next_expiry").alias("next_expiry_us"))


@query(f"SELECT storage_object_id, {EXPIRY_SQL} AS expires_us, 'expired' AS lifecycle_status FROM storage WHERE lifecycle_status <> 'expired' AND {EXPIRY_SQL} <= {STORAGE_AS_OF_US} ORDER BY 2, 1 LIMIT 100", ("storage",))
def storage_sweep(spark, d):
    got = storage.sweep(storage.with_expiry(view(spark, d, "storage")), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), 100)
    return got.select("storage_object_id", _micros("expires_at").alias("expires_us"), "lifecycle_status")


@query("SELECT storage_object_id, 'investigative' AS retention_class, 'promoted' AS lifecycle_status, observed_us + 720 * 3600000000 AS expires_us FROM storage", ("storage",))
def storage_promotion(spark, d):
    got = storage.promote(view(spark, d, "storage"), "investigative", "cold")
    return got.select("storage_object_id", "retention_class", "lifecycle_status", _micros("expires_at").alias("expires_us"))


def _cameras(spark, d):
    """Camera observations: fields by arithmetic on the observation id."""
    o = view(spark, d, "obs")
    i = F.col("observation_id")
    url = lambda k, m: F.when(i % m == 0, F.concat(F.lit(f"https://{k}.example.com/"), F.col("user_id").cast("string")))
    return o.select(
        "observation_id", "layer_key", "source_domain", "lon", "lat", "confidence_score", F.col("observed_at").alias("last_observed_at"),
        F.when(i % 2 == 0, F.concat(F.lit("cam"), F.col("user_id").cast("string"))).alias("camera_id"),
        F.concat(F.lit("North "), F.col("user_id").cast("string")).alias("name"),
        F.when(i % 5 == 0, "offline").when(i % 5 < 3, "active").alias("status"),
        url("img", 4).alias("image_url"), url("str", 6).alias("stream_url"), url("page", 3).alias("page_url"),
        F.lit("traffic").alias("provider"), F.lit("road view").alias("content_text"),
    )


CAMERA_SQL = """c AS (SELECT *, CASE WHEN observation_id % 2 = 0 THEN concat('cam', user_id) END AS camera_id, concat('North ', user_id) AS name, CASE WHEN observation_id % 5 = 0 THEN 'offline' WHEN observation_id % 5 < 3 THEN 'active' END AS st,
CASE WHEN observation_id % 4 = 0 THEN concat('https://img.example.com/', user_id) END AS image_url, CASE WHEN observation_id % 6 = 0 THEN concat('https://str.example.com/', user_id) END AS stream_url, CASE WHEN observation_id % 3 = 0 THEN concat('https://page.example.com/', user_id) END AS page_url FROM obs),
cam AS (SELECT *, coalesce(st, 'unknown') AS status, concat(coalesce(camera_id, concat('north-', user_id)), '-', substr(sha256(concat(source_domain, '|', coalesce(camera_id, ''), '|', coalesce(image_url, ''), '|', coalesce(stream_url, ''), '|', lower(name), '|', printf('%.6f,%.6f', lon, lat))), 1, 16)) AS camera_key FROM c WHERE image_url IS NOT NULL OR stream_url IS NOT NULL OR camera_id IS NOT NULL),
inv AS (SELECT *, status IN ('active', 'online', 'open', 'ok') OR (status NOT IN ('inactive', 'offline', 'closed', 'disabled') AND (image_url IS NOT NULL OR stream_url IS NOT NULL)) AS active FROM cam QUALIFY row_number() OVER (PARTITION BY camera_key ORDER BY observation_id) = 1)"""


@query(f"{CAMERA_SQL} SELECT camera_key, observation_id, status, active FROM inv", ("obs",))
def camera_inventory(spark, d):
    return cameras.inventory(_cameras(spark, d)).select("camera_key", "observation_id", "status", "active")


@query(
    f"""{CAMERA_SQL}, e AS (SELECT *, 'image' AS endpoint_kind, image_url AS u FROM inv UNION ALL SELECT *, 'stream', stream_url FROM inv UNION ALL SELECT *, 'page', page_url FROM inv),
s AS (SELECT endpoint_kind, round(greatest(0, least(1, 0.1::DOUBLE + CASE endpoint_kind WHEN 'stream' THEN 0.25::DOUBLE WHEN 'image' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN active THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN status = 'active' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN camera_id IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + 0.1::DOUBLE + CASE WHEN t_us >= {AS_OF_US - 48 * HOUR} THEN 0.1::DOUBLE ELSE 0 END + confidence_score * 0.1::DOUBLE - CASE WHEN endpoint_kind = 'page' AND (image_url IS NOT NULL OR stream_url IS NOT NULL) THEN 0.05::DOUBLE ELSE 0 END)), 3) AS score FROM e WHERE u IS NOT NULL)
SELECT endpoint_kind, CASE WHEN score >= 0.85 THEN 'graduated' WHEN score >= 0.7 THEN 'ready' WHEN score >= 0.45 THEN 'review' ELSE 'candidate' END AS endpoint_status, count(*) AS n, round(sum(score), 0) AS scores FROM s GROUP BY 1, 2""",
    ("obs",),
)
def camera_endpoints(spark, d):
    e = cameras.endpoints(cameras.inventory(_cameras(spark, d)), F.lit(AS_OF).cast("timestamp_ntz"))
    return e.groupBy("endpoint_kind", "endpoint_status").agg(F.count("*").alias("n"), F.round(F.sum("graduation_score"), 0).alias("scores"))


@query(f"{CAMERA_SQL} SELECT CASE WHEN grouping(layer_key) = 0 THEN 'layer_key' WHEN grouping(source_domain) = 0 THEN 'source_domain' WHEN grouping(status) = 0 THEN 'status' ELSE 'all' END AS dimension, coalesce(layer_key, source_domain, status, 'all') AS value, count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (t_us < {AS_OF_US - 24 * HOUR}) AS stale FROM inv GROUP BY GROUPING SETS ((layer_key), (source_domain), (status), ())", ("obs",))
def camera_summary(spark, d):
    inv = cameras.inventory(_cameras(spark, d)).withColumn("old", cameras.stale(F.col("last_observed_at"), F.lit(AS_OF).cast("timestamp_ntz"), 24))
    return reports.buckets(inv, ["layer_key", "source_domain", "status"], active=F.count_if("active"), stale=F.count_if("old"))


@query(f"{CAMERA_SQL} SELECT CASE WHEN b.camera_key IS NULL THEN 'created' WHEN a.camera_key IS NULL THEN 'kept' WHEN a.status <> b.status THEN 'updated' ELSE 'unchanged' END AS action, count(*) AS n FROM (SELECT camera_key, status FROM inv WHERE observation_id % 3 <> 0) a FULL JOIN (SELECT camera_key, CASE WHEN observation_id % 4 = 1 THEN 'broken' ELSE status END AS status FROM inv WHERE observation_id % 7 <> 0) b ON a.camera_key = b.camera_key GROUP BY 1", ("obs",))
def camera_upsert(spark, d):
    inv = cameras.inventory(_cameras(spark, d))
    stored = inv.filter("observation_id % 7 <> 0").withColumn("status", F.when(F.col("observation_id") % 4 == 1, "broken").otherwise(F.col("status")))
    return cameras.upsert(stored, inv.filter("observation_id % 3 <> 0")).groupBy("action").agg(F.count("*").alias("n"))


@query(f"{CAMERA_SQL}, t(task_id, tl, td) AS (VALUES (1, 'click', 's1.example.com'), (2, NULL, 'example.com'), (3, 'view', NULL)) SELECT task_id::BIGINT AS task_id, count(*) AS n FROM inv JOIN t ON coalesce(tl = layer_key, true) AND coalesce(td = source_domain OR ends_with(source_domain, concat('.', td)) OR ends_with(td, concat('.', source_domain)), true) GROUP BY 1", ("obs",))
def camera_task_scope(spark, d):
    tasks = spark.createDataFrame([(1, "click", "s1.example.com"), (2, None, "example.com"), (3, "view", None)], "task_id long, layer_key string, source_domain string")
    return cameras.task_scope(tasks, cameras.inventory(_cameras(spark, d))).groupBy("task_id").agg(F.count("*").alias("n"))


@query(
    """a AS (SELECT observation_id AS seq, user_id AS source_id, source_domain AS domain_class, CASE WHEN layer_key = 'error' THEN 'failed' WHEN layer_key = 'view' THEN 'stale' ELSE 'success' END AS outcome, CASE WHEN observation_id % 2 = 0 THEN 'timeout' ELSE 'parse' END AS fk FROM obs),
b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY domain_class ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM a),
c AS (SELECT *, CASE WHEN outcome = 'success' THEN 'none' WHEN outcome = 'failed' AND fk = 'timeout' AND n <= 40 AND m < 400 THEN 'retry_source' ELSE 'record_research_gap' END AS action FROM b)
SELECT action, count(*) AS n, sum(CASE WHEN action = 'retry_source' THEN least(3600.0::DOUBLE, 60.0::DOUBLE * pow(2.0, n - 1)) END) AS delay FROM c GROUP BY 1""",
    ("obs",),
)
def coverage_actions(spark, d):
    o = view(spark, d, "obs")
    a = o.select(F.col("observation_id").alias("seq"), F.col("user_id").alias("source_id"), F.col("source_domain").alias("domain_class"), F.when(F.col("layer_key") == "error", "failed").when(F.col("layer_key") == "view", "stale").otherwise("success").alias("outcome"), F.when(F.col("observation_id") % 2 == 0, "timeout").otherwise("parse").alias("failure_kind"))
    return planning.coverage_actions(a, max_retries=40, class_budget=400).groupBy("action").agg(F.count("*").alias("n"), F.sum("delay_seconds").alias("delay"))


@query(
    """c AS (SELECT DISTINCT user_id AS source_id, source_domain AS domain_class, user_id % 13 AS r, user_id % 5 <> 0 AS enabled FROM obs), used AS (SELECT source_domain AS domain_class, count(DISTINCT user_id) AS u FROM obs WHERE user_id % 11 = 0 GROUP BY 1)
SELECT source_id, domain_class FROM (SELECT c.*, row_number() OVER (PARTITION BY c.domain_class ORDER BY r, source_id) AS n, 3 - coalesce(u, 0) AS rest FROM c LEFT JOIN used USING (domain_class) WHERE enabled AND source_id % 11 <> 0) WHERE n <= rest ORDER BY r, source_id LIMIT 25""",
    ("obs",),
)
def alternate_sources(spark, d):
    o = view(spark, d, "obs")
    c = o.select(F.col("user_id").alias("source_id"), F.col("source_domain").alias("domain_class"), (F.col("user_id") % 13).alias("alternate_rank"), (F.col("user_id") % 5 != 0).alias("enabled")).distinct()
    tried = c.filter("source_id % 11 = 0").select("source_id")
    used = c.filter("source_id % 11 = 0").groupBy("domain_class").agg(F.count("*").alias("used"))
    return planning.alternates(c, tried, used, 3, 25).select("source_id", "domain_class")


@query(
    """RECURSIVE s AS (SELECT DISTINCT user_id % 4 AS question_id, user_id AS source_id, layer_key AS source_class, source_domain AS domain, user_id % 6 AS relevance, confidence_score AS trust FROM obs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, trust DESC, source_class, domain, source_id) AS n FROM s),
folded(question_id, n, picked, ok) AS (SELECT DISTINCT question_id, 0::BIGINT, []::STRUCT(c VARCHAR, d VARCHAR)[], false FROM ranked UNION ALL
  SELECT question_id, n, CASE WHEN fits THEN list_append(picked, {'c': source_class, 'd': domain}) ELSE picked END, fits FROM (SELECT r.question_id, r.n, r.source_class, r.domain, f.picked, len(f.picked) < 12 AND len([x FOR x IN f.picked IF x.c = r.source_class]) < 5 AND len([x FOR x IN f.picked IF x.d = r.domain]) < 3 AS fits FROM folded f JOIN ranked r ON r.question_id = f.question_id AND r.n = f.n + 1))
SELECT question_id, source_id, 1000 + relevance * 10 + CAST(floor(trust * 10) AS BIGINT) AS priority FROM folded JOIN ranked USING (question_id, n) WHERE ok""",
    ("obs",),
)
def research_plan(spark, d):
    """Greedy selection under three caps."""
    o = view(spark, d, "obs")
    s = o.select((F.col("user_id") % 4).alias("question_id"), F.col("user_id").alias("source_id"), F.col("layer_key").alias("source_class"), F.col("source_domain").alias("domain"), (F.col("user_id") % 6).alias("relevance"), F.col("confidence_score").alias("trust")).dropDuplicates(["question_id", "source_id", "source_class"])
    return planning.research_plan(s, 5, 3, 12)


@query(
    """f AS (SELECT observation_id AS frontier_id, source_domain AS domain, user_id % 17 AS priority FROM obs)
SELECT frontier_id, domain, priority FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, frontier_id) AS n FROM f) WHERE n <= 5 ORDER BY priority DESC, frontier_id LIMIT 40""",
    ("obs",),
)
def frontier_batch(spark, d):
    from evifuse.operators.discovery import frontier_batch as batch

    f = view(spark, d, "obs").select(F.col("observation_id").alias("frontier_id"), F.col("source_domain").alias("domain"), (F.col("user_id") % 17).alias("priority"))
    return batch(f, 5, 40)


@query(
    """p AS (SELECT user_id AS provider_id, bool_or(user_id % 6 <> 0) AS ok, CASE user_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'maps' ELSE 'news' END AS cap FROM obs GROUP BY 1, 3), w(capability) AS (VALUES ('search'), ('maps'), ('news'), ('archive'))
SELECT capability, count(provider_id) AS configured, count(*) FILTER (ok) AS available, count(*) FILTER (ok) = 0 AS gap FROM w LEFT JOIN p ON p.cap = w.capability GROUP BY 1""",
    ("obs",),
)
def provider_coverage(spark, d):
    p = view(spark, d, "obs").select(F.col("user_id").alias("provider_id")).distinct()
    p = p.withColumn("capabilities", F.array(F.when(F.col("provider_id") % 3 == 0, "search").when(F.col("provider_id") % 3 == 1, "maps").otherwise("news"))).withColumn("enabled", F.lit(True)).withColumn("health", F.when(F.col("provider_id") % 6 == 0, "unhealthy").otherwise("healthy"))
    return planning.provider_coverage(p, ["search", "maps", "news", "archive"])


@query("SELECT user_id % 5 AS k, CASE WHEN user_id % 5 = 0 THEN 'domain_paused' WHEN user_id % 7 = 0 THEN 'provider_disabled' WHEN user_id % 11 = 0 THEN 'schema_quarantined' WHEN user_id % 9 = 0 THEN 'provider_disabled' WHEN layer_key = 'error' THEN 'unsupported_capability' WHEN user_id % 13 = 0 THEN 'unsafe_target' WHEN user_id % 17 = 0 THEN 'origin_not_allowed' ELSE 'allowed' END AS decision, count(*) AS n FROM obs GROUP BY 1, 2", ("obs",))
def provider_decisions(spark, d):
    u = F.col("user_id")
    can = {"click": "search", "view": "fetch_feed", "purchase": "fetch_static", "signup": "parse_document"}
    url = F.when(u % 13 == 0, "http://127.0.0.1/x").when(u % 17 == 0, "https://other.org/a/x").otherwise("https://X.org/a/x")
    o = view(spark, d, "obs").select(
        (u % 5).alias("k"), (u % 5 == 0).alias("paused"), (u % 7 != 0).alias("enabled"), F.when(u % 11 == 0, "schema_quarantined").when(u % 9 == 0, "degraded").otherwise("healthy").alias("health"),
        F.array(*[F.lit(c) for c in can.values()]).alias("capabilities"), rules.lookup(F.col("layer_key"), can, "other").alias("capability"), url.alias("url"), F.array(F.lit("https://x.org/a/")).alias("base_urls"),
    )
    return o.withColumn("decision", planning.provider_decision(o)).groupBy("k", "decision").agg(F.count("*").alias("n"))


@query("SELECT status, nxt, legal, count(*) AS n FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'planning' WHEN 2 THEN 'collecting' ELSE 'reporting' END AS status, CASE event_id % 3 WHEN 0 THEN 'collecting' WHEN 1 THEN 'failed' ELSE 'ready' END AS nxt, CASE WHEN event_id % 3 = 0 THEN user_id % 4 = 1 WHEN event_id % 3 = 1 THEN event_id % 2 = 0 ELSE user_id % 4 = 3 END AS legal FROM events) GROUP BY 1, 2, 3")
def state_transitions(spark, d):
    from evifuse.session import table

    e = table(spark, d, "events")
    s = e.select(F.expr("CASE user_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'planning' WHEN 2 THEN 'collecting' ELSE 'reporting' END").alias("status"), F.expr("CASE event_id % 3 WHEN 0 THEN 'collecting' WHEN 1 THEN 'failed' ELSE 'ready' END").alias("nxt"), F.when(F.col("event_id") % 2 == 0, "done").alias("stop_reason"))
    return planning.transitions(s, wanted="nxt").groupBy("status", "nxt", "legal").agg(F.count("*").alias("n"))


@query("SELECT user_id AS watch_id, count(*) AS total, count(*) FILTER (event_id % 3 = 0) AS material, count(*) FILTER (event_type = 'error') AS failed, sha256(concat(user_id, '|', count(*), '|', count(*) FILTER (event_id % 3 = 0), '|', count(*) FILTER (event_type = 'error'))) AS digest FROM events GROUP BY 1")
def watch_report(spark, d):
    r = view(spark, d, "runs").select(F.col("source_id").alias("watch_id"), "status", (F.col("source_run_id") % 3 == 0).alias("material"))
    return watches.report(r)


@query(
    """r AS (SELECT source_run_id AS watch_run_id, source_id AS watch_id, lag(payload_sha256) OVER (PARTITION BY source_id ORDER BY source_run_id) AS b, payload_sha256 AS f FROM runs WHERE status = 'completed')
SELECT watch_run_id, watch_id FROM r WHERE b <> f AND watch_run_id % 3 = 0 AND watch_run_id < 9000 AND watch_id % 4 < 2 ORDER BY watch_run_id DESC LIMIT 50""",
    ("runs",),
)
def watch_feed(spark, d):
    runs = view(spark, d, "runs").select(F.col("source_id").alias("watch_id"), F.col("source_run_id").alias("watch_run_id"), "status", F.col("payload_sha256").alias("fingerprint"))
    r = watches.outcomes(runs).withColumn("material", F.col("watch_run_id") % 3 == 0).withColumn("citation_ids", F.array(F.col("watch_run_id")))
    w = runs.select("watch_id").distinct().withColumn("redaction_level", F.when(F.col("watch_id") % 4 == 0, "public").when(F.col("watch_id") % 4 == 1, "").when(F.col("watch_id") % 4 == 2, "secret").otherwise("odd"))
    return watches.feed(r, w, cursor=9000).select("watch_run_id", "watch_id")


@query("SELECT user_id AS run, count(*) AS matches, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR))) AS fingerprint FROM events WHERE event_type = 'error' AND value > 20 GROUP BY 1")
def watch_rule_fingerprints(spark, d):
    from evifuse.session import table

    e = table(spark, d, "events").withColumnRenamed("event_id", "observation_id").withColumnRenamed("user_id", "run")
    return watches.evaluate_rule(e, {"all": [{"field": "event_type", "op": "eq", "value": "error"}, {"field": "value", "op": "gt", "value": 20}]}, "run")


@query("SELECT CASE user_id % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' WHEN 2 THEN 'confidential' WHEN 3 THEN 'secret' ELSE 'odd' END AS level, user_id % 5 < 3 OR user_id % 5 = 4 AS shown, count(*) AS n FROM events GROUP BY 1, 2")
def redaction_visibility(spark, d):
    level = F.expr("CASE user_id % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' WHEN 2 THEN 'confidential' WHEN 3 THEN 'secret' ELSE 'odd' END")
    return view(spark, d, "obs").select(level.alias("level")).withColumn("shown", rules.visible(F.col("level"), "confidential")).groupBy("level", "shown").agg(F.count("*").alias("n"))


WATCHES = [(1, "view", None, 200, 0.5, None, 200), (2, None, "s1.example.com", 50, 0.0, None, 50), (3, "click", "s3.example.com", 100, 0.6, None, 100), (4, None, None, 1000, 0.0, "7", 25), (5, "none", None, 20, 0.0, None, 20)]
_WATCH_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in w) + ")" for w in WATCHES)


@query(
    f"""w(watch_id, wl, wd, depth, least, term, most) AS (VALUES {_WATCH_ROWS}),
r AS (SELECT w.*, o.observation_id AS i, o.confidence_score AS c, o.content_json AS j, row_number() OVER (PARTITION BY watch_id ORDER BY o.observation_id DESC) AS n FROM w JOIN obs o ON coalesce(wl = o.layer_key, true) AND coalesce(wd = o.source_domain, true)),
k AS (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY i DESC) AS p FROM r WHERE n <= depth AND c >= least AND (term IS NULL OR contains(lower(j), term))),
f AS (SELECT watch_id, count(*) AS matches, min(c) AS confidence, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i DESC) AS ids FROM k WHERE p <= most GROUP BY 1)
SELECT w.watch_id::BIGINT AS watch_id, coalesce(matches, 0) AS matches, coalesce(confidence, 0.0::DOUBLE) AS confidence, sha256(coalesce(ids, '')) AS fingerprint FROM w LEFT JOIN f USING (watch_id)""",
    ("obs",),
)
def observation_watches(spark, d):
    rows = [(*w[:5], [w[5]] if w[5] else None, w[6]) for w in WATCHES]
    w = spark.createDataFrame(rows, "watch_id long, layer_key string, source_domain string, read_limit int, min_confidence double, terms array<string>, max_results int")
    return watches.observation_watches(w, view(spark, d, "obs"), F.col("content_json"), 1000).drop("ids")


@query(
    """w AS (SELECT c_custkey AS watch_id, CASE c_nationkey % 3 WHEN 0 THEN 'source_delta' WHEN 1 THEN 'source_health' ELSE 'investigation_watch' END AS kind, c_acctbal >= 0 AS enabled FROM customer),
l AS (SELECT source_id, max(source_run_id) AS i, arg_max(status, source_run_id) AS s, arg_max(payload_sha256, source_run_id) AS p FROM runs GROUP BY 1),
e AS (SELECT *, CASE WHEN kind = 'investigation_watch' AND NOT enabled THEN 'source is missing or disabled' WHEN kind <> 'source_health' AND i IS NULL THEN 'source has no run' END AS error FROM w LEFT JOIN l ON source_id = watch_id)
SELECT watch_id, i AS source_run_id, error, CASE WHEN error IS NULL THEN CASE WHEN kind <> 'source_health' THEN p WHEN NOT enabled THEN 'disabled' WHEN i IS NULL THEN 'never_run' ELSE s END END AS fingerprint FROM e""",
    ("runs",),
)
def source_watches(spark, d):
    from evifuse.session import table

    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "source_id")
    kind = F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'source_delta' WHEN 1 THEN 'source_health' ELSE 'investigation_watch' END")
    sources = c.select("source_id", (F.col("c_acctbal") >= 0).alias("enabled"))
    return watches.source_watches(c.select(F.col("source_id").alias("watch_id"), "source_id", kind.alias("watch_type")), sources, view(spark, d, "runs"))
