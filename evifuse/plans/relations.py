"""Evidence, materiality, graph, inventory and discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.functions import rules
from evifuse.operators import discovery, evidence, graph, reports, windows
from evifuse.plans.registry import query
from evifuse.plans.views import view
from evifuse.session import table

CLAIM_SQL = """e AS (SELECT *, source_trust * greatest(0.25::DOUBLE, 1 - least(greatest(10957.0::DOUBLE - ship_day, 0), 730) / 1460.0::DOUBLE) AS w FROM evidence WHERE relation <> 'context'),
best AS (SELECT claim_id, relation, w FROM e QUALIFY row_number() OVER (PARTITION BY claim_id, relation, independence_key ORDER BY source_trust DESC, evidence_id) = 1),
side AS (SELECT claim_id, relation, least(1.0::DOUBLE, avg(w) + 0.12::DOUBLE * (count(*) - 1)) AS s, count(*) AS n FROM best GROUP BY 1, 2),
claim AS (SELECT c.claim_id, coalesce(max(s) FILTER (relation = 'supports'), 0) AS sw, coalesce(max(s) FILTER (relation = 'contradicts'), 0) AS cw, coalesce(max(n) FILTER (relation = 'supports'), 0) AS sn, coalesce(max(n) FILTER (relation = 'contradicts'), 0) AS cn FROM (SELECT DISTINCT claim_id FROM evidence) c LEFT JOIN side USING (claim_id) GROUP BY 1)"""


def _evidence(spark, d):
    e = view(spark, d, "evidence")
    return e.withColumn("age_days", F.lit(10957.0) - F.col("ship_day")).withColumn("fit", F.lit(1.0)).withColumn("completeness", F.lit(1.0))


@query(f"{CLAIM_SQL} SELECT claim_id, round(greatest(0, least(1, sw * (1 - 0.55::DOUBLE * cw))), 9) AS confidence, sn AS support_count, cn AS conflict_count FROM claim", ("evidence",))
def claim_assessment(spark, d):
    return evidence.assess_claims(_evidence(spark, d)).select("claim_id", F.round("confidence", 9).alias("confidence"), "support_count", "conflict_count")


@query(f"{CLAIM_SQL} SELECT CASE WHEN sn = 0 OR round(greatest(0, least(1, sw * (1 - 0.55::DOUBLE * cw))), 3) < 0.45 THEN 'insufficient_evidence' WHEN cn > 0 THEN 'contested' ELSE 'supported' END AS status, count(*) AS n FROM claim GROUP BY 1", ("evidence",))
def claim_status(spark, d):
    return evidence.assess_claims(_evidence(spark, d), minimum=0.45).groupBy("status").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT event_id AS seq, user_id, event_type, sha256(props) AS h, user_id % 23 AS src, value, user_id % 10 < 4 AS has_event FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY seq) > 1 AS dup, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq) > 1 AS claim_seen, row_number() OVER (PARTITION BY user_id, event_type, src ORDER BY seq) > 1 AS pair_seen, row_number() OVER (PARTITION BY src ORDER BY seq) > 1 AS src_seen FROM s),
t AS (SELECT *, CASE WHEN dup THEN 'no_material_change' WHEN event_type = 'error' THEN 'contradiction' WHEN seq % 19 = 0 THEN 'visual_change_candidate' WHEN NOT claim_seen THEN 'new_fact' WHEN NOT pair_seen THEN 'corroboration' WHEN NOT src_seen THEN 'new_source' ELSE 'no_material_change' END AS update_type,
round(0.2::DOUBLE * (NOT dup)::INT + 0.2::DOUBLE * (NOT pair_seen)::INT + 0.2::DOUBLE * least(1, greatest(0, value / 100.0::DOUBLE)) + 0.1::DOUBLE * 0.5::DOUBLE + 0.1::DOUBLE * 0.25::DOUBLE + 0.1::DOUBLE * has_event::INT, 6) AS score FROM f)
SELECT seq, update_type, score FROM t""",
)
def materiality(spark, d):
    e = table(spark, d, "events")
    lit = lambda v, t: F.lit(v).cast(t)
    stream = e.select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("evidence_id"), F.lit("1").alias("evidence_version"), F.col("user_id").cast("string").alias("claim_id"), F.col("event_type").alias("claim_version"),
        F.sha2("props", 256).alias("content_hash"), (F.col("user_id") % 23).cast("string").alias("source_independence_key"), F.when(F.col("event_type") == "error", "contradicts").otherwise("supports").alias("claim_relation"),
        (F.col("event_id") % 19 == 0).alias("visual_change"), lit(None, "string").alias("previous_status"), lit(None, "string").alias("status"), F.lit(0.8).alias("confidence"), lit(None, "double").alias("previous_confidence"),
        (F.col("value") / 100.0).alias("claim_impact"), F.lit(0.5).alias("temporal_relevance"), F.lit(0.25).alias("geographic_relevance"), F.when(F.col("user_id") % 10 < 4, F.col("event_id")).alias("event_id"), F.array(F.lit("c")).alias("citation_ids"),
    )
    return evidence.materiality(stream).select("seq", "update_type", "score")


@query(
    """v AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round((c + 1) / 2, 5) AS similarity FROM p""".replace("v AS", "WITH v AS", 1),
)
def cosine_pairs(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(evidence.cosine01(F.col("embedding"), F.col("other")), 5).alias("similarity"))


@query("SELECT event_id, bit_count(xor(event_id, user_id * 7919)) AS distance FROM events")
def hash_distances(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", evidence.hex_hamming(F.lower(F.hex("event_id")), F.lower(F.hex(F.col("user_id") * 7919))).cast("tinyint").alias("distance"))


EDGE_SQL = "edge AS (SELECT * FROM assertions)"


def _edges(spark, d):
    a = view(spark, d, "assertions").withColumn("valid_from", F.col("valid_us")).withColumn("valid_to", F.col("valid_us"))
    return graph.eligible(a, view(spark, d, "citations"))


@query(f"{EDGE_SQL}, ends AS (SELECT assertion_id, confidence_score, subject_entity_id AS entity_id FROM edge UNION ALL SELECT assertion_id, confidence_score, object_entity_id FROM edge), b AS (SELECT entity_id, sum(confidence_score) AS c, count(*) AS n FROM ends GROUP BY 1), s AS (SELECT entity_id, count(DISTINCT source_uri) AS k FROM ends JOIN citations USING (assertion_id) GROUP BY 1) SELECT entity_id, n AS relationship_count, k AS distinct_source_count, round(c + 0.1::DOUBLE * k + 0.05::DOUBLE * n, 4) AS score FROM b JOIN s USING (entity_id)", ("assertions", "citations"))
def prominence(spark, d):
    return graph.prominence(_edges(spark, d), view(spark, d, "citations")).select("entity_id", "relationship_count", "distinct_source_count", F.round("score", 4).alias("score"))


@query(
    """RECURSIVE edge AS (SELECT assertion_id, subject_entity_id AS a, object_entity_id AS b FROM assertions),
both_ways AS (SELECT assertion_id, a AS u, b AS v FROM edge UNION ALL SELECT assertion_id, b, a FROM edge),
walk(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT v, depth + 1 FROM walk JOIN both_ways ON u = node WHERE depth < 3)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY 1""",
    ("assertions",),
)
def network_nodes(spark, d):
    a = view(spark, d, "assertions")
    nodes, _ = graph.network_slice(a, view(spark, d, "citations"), F.lit(1).cast("long"), 3)
    return nodes.select("node", "depth")


@query(
    """RECURSIVE edge AS (SELECT assertion_id, subject_entity_id AS a, object_entity_id AS b FROM assertions),
both_ways AS (SELECT assertion_id, a AS u, b AS v FROM edge UNION ALL SELECT assertion_id, b, a FROM edge),
walk(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT v, depth + 1 FROM walk JOIN both_ways ON u = node WHERE depth < 3)
SELECT e.assertion_id, n AS evidence_count FROM edge e JOIN (SELECT assertion_id, count(*) AS n FROM citations GROUP BY 1) USING (assertion_id) WHERE e.assertion_id IN (SELECT assertion_id FROM both_ways JOIN walk ON u = node WHERE depth < 3)""",
    ("assertions", "citations"),
)
def network_relationships(spark, d):
    a = view(spark, d, "assertions")
    return graph.network_slice(a, view(spark, d, "citations"), F.lit(1).cast("long"), 3)[1].select("assertion_id", "evidence_count")


@query("SELECT jurisdiction, count(DISTINCT e)::BIGINT AS entity_count FROM (SELECT jurisdiction, subject_entity_id AS e FROM assertions UNION ALL SELECT jurisdiction, object_entity_id FROM assertions) GROUP BY 1", ("assertions",))
def regional_clusters(spark, d):
    return graph.regional_clusters(view(spark, d, "assertions"))


@query("SELECT source_reliability, count(*) AS n FROM assertions JOIN citations USING (assertion_id) WHERE confidence_score >= 0.95 AND valid_us BETWEEN 820454400000000 AND 946684800000000 AND source_reliability = 'high' GROUP BY 1", ("assertions", "citations"))
def graph_edge_filter(spark, d):
    a = view(spark, d, "assertions").withColumn("valid_from", F.col("valid_us")).withColumn("valid_to", F.col("valid_us"))
    c = view(spark, d, "citations")
    got = graph.eligible(a, c, since=820454400000000, until=946684800000000, min_confidence=0.95, reliability=["high"])
    return got.join(c, "assertion_id").groupBy("source_reliability").agg(F.count("*").alias("n"))


DIFF_SQL = "last AS (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY run_id, candidate_id ORDER BY revision_id DESC) = 1), b AS (SELECT * FROM last WHERE run_id = 1996), a AS (SELECT * FROM last WHERE run_id = 1997)"


def _runs(spark, d):
    r = windows.latest(view(spark, d, "revisions"), ["run_id", "candidate_id"], "revision_id")
    return r.filter("run_id = 1996"), r.filter("run_id = 1997")


@query(f"{DIFF_SQL} SELECT coalesce(a.candidate_id, b.candidate_id) AS candidate_id, CASE WHEN b.candidate_id IS NULL THEN 'added' WHEN a.candidate_id IS NULL THEN 'disappeared' WHEN a.content_hash <> b.content_hash OR a.score_bucket <> b.score_bucket OR abs(a.score - b.score) >= 0.01 THEN 'changed' ELSE 'same' END AS change, coalesce(a.status = 'promoted' AND (b.status IS NULL OR b.status <> 'promoted'), false) AS newly_promoted, coalesce(a.status = 'suppressed' AND (b.status IS NULL OR b.status <> 'suppressed'), false) AS newly_suppressed FROM b FULL JOIN a ON a.candidate_id = b.candidate_id", ("revisions",))
def inventory_diff(spark, d):
    return discovery.inventory_diff(*_runs(spark, d))


@query("SELECT run_id, candidate_id, max(revision_id) AS revision_id, arg_max(status, revision_id) AS status FROM revisions GROUP BY 1, 2", ("revisions",))
def latest_revision(spark, d):
    return windows.latest(view(spark, d, "revisions").select("run_id", "candidate_id", "revision_id", "status"), ["run_id", "candidate_id"], "revision_id")


@query("SELECT score_bucket AS value, count(*) AS n FROM revisions GROUP BY 1", ("revisions",))
def value_counts(spark, d):
    return reports.value_counts(view(spark, d, "revisions"), "score_bucket")


@query("last AS (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY revision_id DESC) = 1) SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(score_bucket) = 0 THEN 'score_bucket' ELSE 'all' END AS dimension, coalesce(status, score_bucket, 'all') AS value, count(*) AS total, round(sum(score), 2) AS score FROM last GROUP BY GROUPING SETS ((status), (score_bucket), ())", ("revisions",))
def candidate_inventory(spark, d):
    last = windows.latest(view(spark, d, "revisions"), ["candidate_id"], "revision_id")
    return reports.buckets(last, ["status", "score_bucket"], score=F.round(F.sum("score"), 2))


@query("SELECT revision_id, candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY revision_id) + coalesce(t, 0) AS revision_number FROM (SELECT * FROM revisions WHERE run_id > 1996) r LEFT JOIN (SELECT candidate_id, count(*) AS t FROM revisions WHERE run_id <= 1996 GROUP BY 1) USING (candidate_id)", ("revisions",))
def revision_numbers(spark, d):
    from pyspark.sql import Window

    r = view(spark, d, "revisions")
    old = r.filter("run_id <= 1996").withColumn("revision_number", F.row_number().over(Window.partitionBy("candidate_id").orderBy("revision_id")))
    return windows.number_revisions(old, r.filter("run_id > 1996"), "candidate_id", "revision_id").select("revision_id", "candidate_id", "revision_number")


@query("x AS (SELECT run_id, candidate_id % 3 AS dom, status = 'candidate' AS junk, revision_id % 29 = 0 AS robots FROM revisions), g AS (SELECT run_id, dom, count(*) AS n, count(*) FILTER (junk) AS j, count(*) FILTER (robots) AS r FROM x GROUP BY 1, 2) SELECT run_id, sum(n)::BIGINT AS total, sum(n) >= 10 AND sum(j) / sum(n) >= 0.8 AS junk_spike, max(n) >= 10 AND max(n) / sum(n) >= 0.7 AS domain_spike, sum(r) >= 5 AS robots_spike FROM g GROUP BY 1", ("revisions",))
def run_warnings(spark, d):
    r = view(spark, d, "revisions").select("run_id", (F.col("candidate_id") % 3).alias("domain"), (F.col("status") == "candidate").alias("junk"), (F.col("revision_id") % 29 == 0).alias("robots_blocked"))
    return discovery.run_warnings(r)


@query("s AS (SELECT candidate_id, arg_max(run_id, revision_id) AS c, arg_max(score, revision_id) AS v FROM revisions WHERE run_id <= 1996 GROUP BY 1), f AS (SELECT candidate_id, arg_max(run_id, revision_id) AS c, arg_max(score, revision_id) AS v FROM revisions WHERE run_id > 1996 GROUP BY 1) SELECT coalesce(s.candidate_id, f.candidate_id) AS candidate_id, CASE WHEN s.v IS NULL OR f.v >= s.v THEN f.c ELSE s.c END AS campaign_id, CASE WHEN s.v IS NULL OR f.v >= s.v THEN f.v ELSE s.v END AS score FROM s FULL JOIN f ON s.candidate_id = f.candidate_id", ("revisions",))
def score_ownership(spark, d):
    last = lambda df: windows.latest(df.select("candidate_id", "revision_id", F.col("run_id").alias("campaign_id"), "score"), ["candidate_id"], "revision_id")
    r = view(spark, d, "revisions")
    return discovery.keep_score(last(r.filter("run_id <= 1996")), last(r.filter("run_id > 1996")))


@query(
    """x AS (SELECT revision_id, revision_id % 101 AS a, candidate_id % 97 AS b, revision_id % 7 = 0 AS q, candidate_id % 5 = 0 AS ro FROM revisions),
t AS (SELECT *, round(greatest(0, least(100, 0.18::DOUBLE * a + 0.18::DOUBLE * b + 0.1::DOUBLE * a + 0.12::DOUBLE * b + 0.1::DOUBLE * 60 + 0.1::DOUBLE * 80 + 0.12::DOUBLE * 50 + 0.1::DOUBLE * 90 - round(20 * 0.10::DOUBLE, 2) - round(12 * 0.15::DOUBLE, 2))), 2) AS total FROM x)
SELECT CASE WHEN q THEN 'quarantine' WHEN ro THEN 'ignore' WHEN total >= 72 THEN 'promote_now' WHEN total >= 52 THEN 'keep_candidate' WHEN total >= 32 THEN 'revisit_later' ELSE 'ignore' END AS bucket, count(*) AS n, round(sum(total), 0) AS total FROM t GROUP BY 1""",
    ("revisions",),
)
def candidate_scores(spark, d):
    a, b = (F.col("revision_id") % 101).cast("double"), (F.col("candidate_id") % 97).cast("double")
    r = view(spark, d, "revisions").select(
        a.alias("relevance"), b.alias("geo"), a.alias("temporal"), b.alias("structural"), F.lit(60.0).alias("freshness"), F.lit(80.0).alias("stability"), F.lit(50.0).alias("trust"), F.lit(90.0).alias("novelty"), F.lit(20.0).alias("operational_cost"), F.lit(12.0).alias("redundancy_penalty"), (F.col("revision_id") % 7 == 0).alias("quarantine"), (F.col("candidate_id") % 5 == 0).alias("reference_only")
    )
    return discovery.score(r).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("total_score"), 0).alias("total"))


@query("SELECT CASE WHEN status = 'promoted' THEN 'promoted' WHEN status = 'suppressed' THEN 'suppressed' WHEN candidate_id % 10 = 0 OR score_bucket = '1-URGENT' THEN 'quarantined' WHEN score_bucket = '5-LOW' THEN 'ignored' WHEN score_bucket = '3-MEDIUM' THEN 'deferred' ELSE 'candidate' END AS status, count(*) AS n FROM revisions GROUP BY 1", ("revisions",))
def candidate_status(spark, d):
    r = view(spark, d, "revisions")
    bucket = rules.lookup(F.col("score_bucket"), {"1-URGENT": "quarantine", "5-LOW": "ignore", "3-MEDIUM": "revisit_later"}, "keep_candidate")
    s = discovery.status(bucket, F.when(F.col("candidate_id") % 10 == 0, "blocked").otherwise("neutral"), F.col("status"))
    return r.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT content_hash AS h, CASE WHEN p IS NOT NULL AND p <> content_hash THEN 'schema_changed' WHEN q IS NOT NULL AND q <> score_bucket THEN 'changed' ELSE 'healthy' END AS result, count(*) AS n FROM (SELECT *, lag(content_hash) OVER w AS p, lag(score_bucket) OVER w AS q FROM revisions WINDOW w AS (PARTITION BY candidate_id ORDER BY revision_id)) GROUP BY 1, 2", ("revisions",))
def health_results(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("candidate_id").orderBy("revision_id")
    r = view(spark, d, "revisions").withColumn("p", F.lag("content_hash").over(w)).withColumn("q", F.lag("score_bucket").over(w))
    return r.groupBy(F.col("content_hash").alias("h"), discovery.health_result(F.col("q"), F.col("score_bucket"), F.col("p"), F.col("content_hash")).alias("result")).agg(F.count("*").alias("n"))
