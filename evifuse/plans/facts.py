"""Observation queries: filters, trust, versions, clustering, geofences, archive."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evifuse.functions import geo, rules
from evifuse.operators import fusion, geofence, lookups, observations, windows
from evifuse.plans.registry import query
from evifuse.plans.views import view
from evifuse.session import shared_dir
from evifuse.sources import archive

PROFILES = [
    ("example.com", "neutral", "manual_review", False),
    ("s1.example.com", "trusted", "auto_approve_stable", True),
    ("s2.example.com", "trusted", "auto_approve_stable", True),
    ("s3.example.com", "blocked", "reject", False),
    ("3.example.com", "trusted", "auto_approve_stable", True),
]
PROFILE_SQL = "profiles(domain, trust_level, approval_policy, integrity_source) AS (VALUES ('example.com', 'neutral', 'manual_review', false), ('s1.example.com', 'trusted', 'auto_approve_stable', true), ('s2.example.com', 'trusted', 'auto_approve_stable', true), ('s3.example.com', 'blocked', 'reject', false), ('3.example.com', 'trusted', 'auto_approve_stable', true))"
#: Fences: a square with a hole, a triangle in two parts, a disabled one.
SQUARE = [[[[-95.9, 29.1], [-95.1, 29.1], [-95.1, 30.3], [-95.9, 30.3]], [[-95.6, 29.4], [-95.4, 29.4], [-95.4, 29.9], [-95.6, 29.9]]]]
TRIANGLES = [[[[-95.0, 29.0], [-94.2, 29.3], [-94.9, 30.1]]], [[[-94.6, 30.2], [-94.1, 30.2], [-94.3, 30.9]]]]
FENCES = [(1, True, SQUARE), (2, True, TRIANGLES), (3, False, SQUARE)]


def profiles(spark):
    return spark.createDataFrame(PROFILES, "domain string, trust_level string, approval_policy string, integrity_source boolean")


def fences(spark):
    return spark.createDataFrame(FENCES, "geofence_id long, enabled boolean, polygons array<array<array<array<double>>>>")


def _edges_sql() -> str:
    rows = []
    for i, on, polygons in FENCES:
        for p, rings in enumerate(polygons):
            for r, ring in enumerate(rings):
                for a, b in zip([ring[-1], *ring], ring):
                    rows.append(f"({i}, {str(on).lower()}, {p}, {r}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)")
    return "edges(fence, enabled, poly, ring, x1, y1, x2, y2) AS (VALUES " + ", ".join(rows) + ")"


INSIDE_SQL = f"""{_edges_sql()},
rings AS (SELECT observation_id, trust_level, layer_key, fence, poly, ring, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (CASE WHEN y2 = y1 THEN 1e-12 ELSE y2 - y1 END) + x1 THEN 1 ELSE 0 END) % 2 AS odd
  FROM obs CROSS JOIN edges WHERE enabled GROUP BY ALL),
inside AS (SELECT DISTINCT observation_id, trust_level, layer_key, fence FROM (SELECT observation_id, trust_level, layer_key, fence, poly, max(CASE WHEN ring = 0 THEN odd ELSE 0 END) AS o, max(CASE WHEN ring > 0 THEN odd ELSE 0 END) AS h FROM rings GROUP BY ALL) WHERE o = 1 AND h = 0)"""


@query("SELECT observation_id, layer_key, source_domain, t_us, lon, lat, trust_level FROM obs WHERE layer_key = 'purchase' AND trust_level = 'trusted' AND lon BETWEEN -96 AND -95.2 AND lat BETWEEN 29.2 AND 30.5 ORDER BY t_us DESC, observation_id DESC LIMIT 200", ("obs",))
def observation_query(spark, d):
    got = observations.query(view(spark, d, "obs"), layer="purchase", trust="trusted", bbox=(-96.0, 29.2, -95.2, 30.5), time_column="t_us")
    return got.select("observation_id", "layer_key", "source_domain", "t_us", "lon", "lat", "trust_level")


@query("SELECT layer_key, count(*) AS n FROM obs WHERE lon BETWEEN -95.5 AND -94.5 AND lat BETWEEN 29.5 AND 30.0 AND t_us BETWEEN 1704412800000000 AND 1705622400000000 GROUP BY 1", ("obs",))
def bbox_time_counts(spark, d):
    got = observations.query(view(spark, d, "obs"), bbox=(-95.5, 29.5, -94.5, 30.0), start=1704412800000000, end=1705622400000000, time_column="t_us", limit=None)
    return got.groupBy("layer_key").agg(F.count("*").alias("n"))


@query(
    f"""{PROFILE_SQL}, best AS (SELECT o.observation_id, arg_max(p.domain, length(p.domain)) AS domain FROM obs o JOIN profiles p ON o.source_domain = p.domain OR ends_with(o.source_domain, concat('.', p.domain)) GROUP BY 1)
SELECT coalesce(p.trust_level, 'neutral') AS trust_level, coalesce(p.approval_policy, 'manual_review') AS approval_policy, p.domain AS trust_domain, count(*) AS n,
round(avg(CASE coalesce(p.trust_level, 'neutral') WHEN 'trusted' THEN 0.85::DOUBLE WHEN 'blocked' THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END), 6) AS score
FROM obs o LEFT JOIN best b USING (observation_id) LEFT JOIN profiles p ON p.domain = b.domain GROUP BY 1, 2, 3""",
    ("obs",),
)
def trust_annotation(spark, d):
    got = lookups.annotate_trust(view(spark, d, "obs"), profiles(spark))
    return got.groupBy("trust_level", "approval_policy", "trust_domain").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 6).alias("score"))


@query("SELECT count(*) AS seen, count(DISTINCT (layer_key, raw_hash)) AS imported, count(*) - count(DISTINCT (layer_key, raw_hash)) AS skipped FROM obs", ("obs",))
def import_dedupe(spark, d):
    obs = view(spark, d, "obs").select("layer_key", "raw_hash")
    return observations.import_counters(obs, observations.dedupe(obs))


@query("SELECT layer_key, raw_hash, min(observation_id) AS observation_id FROM obs WHERE observation_id % 2 = 1 AND (layer_key, raw_hash) NOT IN (SELECT (layer_key, raw_hash) FROM obs WHERE observation_id % 2 = 0) GROUP BY 1, 2", ("obs",))
def incremental_import(spark, d):
    obs = view(spark, d, "obs").select("observation_id", "layer_key", "raw_hash")
    return observations.dedupe(obs.filter("observation_id % 2 = 1"), obs.filter("observation_id % 2 = 0"), order="observation_id").select("layer_key", "raw_hash", "observation_id")


@query("SELECT user_id, layer_key, max(observation_id) AS observation_id, arg_max(raw_hash, observation_id) AS raw_hash FROM obs GROUP BY 1, 2", ("obs",))
def replace_by_version(spark, d):
    return windows.replace_by_version(view(spark, d, "obs").select("user_id", "layer_key", "observation_id", "raw_hash"), ["user_id", "layer_key"], "observation_id")


@query("SELECT layer_key, count(*) AS row_count FROM obs GROUP BY 1 ORDER BY row_count DESC, layer_key LIMIT 100", ("obs",))
def archive_layer_counts(spark, d):
    return archive.layer_counts(view(spark, d, "obs"))


@query("SELECT layer_key, count(*) AS n, sum(observation_id)::BIGINT AS ids FROM obs WHERE layer_key IN ('click', 'purchase') GROUP BY 1", ("obs",))
def archive_round_trip(spark, d):
    """Export to the partitioned archive and read two layers back with pruning."""
    root = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    archive.export(view(spark, d, "obs"), root)
    both = archive.read_archive(spark, root, "click").unionByName(archive.read_archive(spark, root, "purchase"))
    return both.groupBy("layer_key").agg(F.count("*").alias("n"), F.sum("observation_id").alias("ids"))


@query(
    """cells AS (SELECT *, floor(lon / 0.5) AS cx, floor(lat / 0.5) AS cy, t_us - lag(t_us) OVER (PARTITION BY floor(lon / 0.5), floor(lat / 0.5) ORDER BY t_us, observation_id) AS gap FROM obs),
numbered AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY cx, cy ORDER BY t_us, observation_id) AS k FROM cells),
agg AS (SELECT cx, cy, k, count(*) AS observation_count, count(DISTINCT source_domain) AS sd, count(DISTINCT layer_key) AS ly, avg(confidence_score) AS ac, count(*) FILTER (trust_level = 'trusted') AS trusted, count(*) FILTER (ground_truth) AS truth, (max(t_us) - min(t_us)) / 60000000.0::DOUBLE AS span FROM numbered GROUP BY 1, 2, 3)
SELECT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, CAST(k AS BIGINT) AS k, observation_count, greatest(sd, ly) AS independent_signal_count, round(least(0.99::DOUBLE, ac + 0.15::DOUBLE * greatest(sd - 1, 0) + 0.1::DOUBLE * greatest(ly - 1, 0)), 6) AS verification_score, trusted AS trusted_observation_count, truth AS ground_truth_count, round(span, 3) AS time_span_minutes FROM agg WHERE greatest(sd, ly) >= 2""",
    ("obs",),
)
def cluster_scores(spark, d):
    """Cluster aggregate and score over fixed clusters: time-gap sessions of grid cells."""
    from pyspark.sql import Window

    obs = view(spark, d, "obs").withColumn("cx", F.floor(F.col("lon") / 0.5)).withColumn("cy", F.floor(F.col("lat") / 0.5))
    w = Window.partitionBy("cx", "cy").orderBy("t_us", "observation_id")
    gap = F.col("t_us") - F.lag("t_us").over(w)
    obs = obs.withColumn("new", F.when(gap.isNull() | (gap > 3_600_000_000), 1).otherwise(0)).withColumn("k", F.sum("new").over(w))
    got = fusion.summarize(obs.withColumn("cell", F.struct("cx", "cy", "k")), "cell")
    return got.select("cell.*", "observation_count", "independent_signal_count", F.round("verification_score", 6).alias("verification_score"), "trusted_observation_count", "ground_truth_count", F.round("time_span_minutes", 3).alias("time_span_minutes"))


#: First fit in order of time and id, one observation a step; the open clusters travel as a list.
CLUSTER_SQL = """ordered AS (SELECT row_number() OVER (ORDER BY t_us, observation_id) AS n, t_us, observation_id, lon, lat FROM obs),
folded(n, open, seed, observation_id) AS (
  SELECT 0::BIGINT, []::STRUCT(id BIGINT, last BIGINT, x DOUBLE, y DOUBLE, k BIGINT)[], 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT n, CASE WHEN pos IS NULL THEN list_append(alive, {'id': observation_id, 'last': t_us, 'x': lon, 'y': lat, 'k': 1::BIGINT}) ELSE list_concat(list_append(alive[:pos - 1], {'id': alive[pos].id, 'last': t_us, 'x': alive[pos].x + lon, 'y': alive[pos].y + lat, 'k': alive[pos].k + 1}), alive[pos + 1:]) END,
    coalesce(alive[pos].id, observation_id), observation_id
  FROM (SELECT *, list_position([6371.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)) <= 25.0::DOUBLE FOR h IN [pow(sin((radians(lat) - radians(c.y / c.k)) / 2), 2) + cos(radians(c.y / c.k)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(c.x / c.k)) / 2), 2) FOR c IN alive]], true) AS pos
    FROM (SELECT o.n, o.t_us, o.observation_id, o.lon, o.lat, [c FOR c IN f.open IF o.t_us - c.last <= 3600000000] AS alive FROM folded f JOIN ordered o ON o.n = f.n + 1))),
found AS (SELECT seed AS cluster_seed, count(*) AS observation_count, count(DISTINCT source_domain) AS source_domain_count, count(DISTINCT layer_key) AS layer_count, avg(confidence_score) AS ac, count(*) FILTER (trust_level = 'trusted') AS trusted_observation_count, count(*) FILTER (ground_truth) AS ground_truth_count, min(t_us) AS started_us, max(t_us) AS ended_us, avg(lon) AS centroid_lon, avg(lat) AS centroid_lat, round((max(t_us) - min(t_us)) / 60000000.0::DOUBLE, 3) AS time_span_minutes
  FROM folded JOIN obs USING (observation_id) WHERE n > 0 GROUP BY 1),
scored AS (SELECT *, greatest(source_domain_count, layer_count) AS independent_signal_count, least(0.99::DOUBLE, ac + 0.15::DOUBLE * greatest(source_domain_count - 1, 0) + 0.1::DOUBLE * greatest(layer_count - 1, 0)) AS score FROM found WHERE greatest(source_domain_count, layer_count) >= 2),
events_found AS (SELECT *, concat('event-', substr(sha1(concat_ws('|', cluster_seed, started_us, observation_count)), 1, 12)) AS slug FROM scored)"""


@query(f"RECURSIVE {CLUSTER_SQL} SELECT cluster_seed, observation_count, source_domain_count, layer_count, round(ac, 6) AS avg_confidence, trusted_observation_count, ground_truth_count, started_us, ended_us, round(centroid_lon, 6) AS centroid_lon, round(centroid_lat, 6) AS centroid_lat, independent_signal_count, round(score, 4) AS verification_score, time_span_minutes FROM scored", ("obs",))
def cross_verify(spark, d):
    """Order-dependent clustering over the whole table."""
    got = fusion.cross_verify(view(spark, d, "obs"))
    for c, n in {"verification_score": 4, "time_span_minutes": 3, "avg_confidence": 6, "centroid_lon": 6, "centroid_lat": 6}.items():
        got = got.withColumn(c, F.round(c, n))
    return got


@query(f"RECURSIVE {CLUSTER_SQL} SELECT slug, observation_count, observation_count AS links, round(score, 4) AS verification_score FROM events_found", ("obs",))
def event_fusion(spark, d):
    events, links, _ = fusion.fuse_events(view(spark, d, "obs"))
    return events.join(links.groupBy("slug").agg(F.count("*").alias("links")), "slug").select("slug", "observation_count", "links", F.round("verification_score", 4).alias("verification_score"))


@query(f"RECURSIVE {CLUSTER_SQL} SELECT slug, product_type, CASE WHEN product_type = 'report' THEN concat(head, chr(10), printf('Verification score %.4f over %.3f minutes', score, time_span_minutes)) ELSE head END AS body FROM (SELECT *, printf('%d observations from %d domains in %d layers', observation_count, source_domain_count, layer_count) AS head, unnest(['cited_summary', 'report']) AS product_type FROM events_found)", ("obs",))
def event_products(spark, d):
    return fusion.fuse_events(view(spark, d, "obs"))[2]


@query(f"{PROFILE_SQL} SELECT user_id, count(DISTINCT source_domain) AS integrity_source_count FROM obs WHERE source_domain IN (SELECT domain FROM profiles WHERE integrity_source) GROUP BY 1", ("obs",))
def integrity_membership(spark, d):
    return fusion.integrity_counts(view(spark, d, "obs"), "user_id", profiles(spark))


@query(
    """SELECT layer_key, round(sum(6371.0 * 2 * atan2(sqrt(t), sqrt(1 - t))), 4) AS km FROM (SELECT layer_key, pow(sin((radians(lat) - radians(29.76::DOUBLE)) / 2), 2) + cos(radians(lat)) * cos(radians(29.76::DOUBLE)) * pow(sin((radians(lon) - radians(-95.37::DOUBLE)) / 2), 2) AS t FROM obs) GROUP BY 1""",
    ("obs",),
)
def haversine_sums(spark, d):
    km = geo.haversine_km(F.lit(-95.37), F.lit(29.76), F.col("lon"), F.col("lat"))
    return view(spark, d, "obs").groupBy("layer_key").agg(F.round(F.sum(km), 4).alias("km"))


@query(f"{INSIDE_SQL} SELECT fence::BIGINT AS geofence_id, layer_key, count(*) AS n FROM inside GROUP BY 1, 2", ("obs",))
def geofence_hits(spark, d):
    return geofence.hits(view(spark, d, "obs"), fences(spark)).groupBy("geofence_id", "layer_key").agg(F.count("*").alias("n"))


@query(f"{INSIDE_SQL} SELECT fence::BIGINT AS geofence_id, CASE WHEN trust_level = 'blocked' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM inside WHERE observation_id % 5 <> 0 GROUP BY 1, 2", ("obs",))
def geofence_alerts(spark, d):
    """Every fifth observation already has an open alert."""
    obs = view(spark, d, "obs")
    found = geofence.hits(obs, fences(spark))
    stored = found.filter("observation_id % 5 = 0").select(F.concat(F.lit("geofence:"), F.col("geofence_id").cast("string"), F.lit(":"), F.col("observation_id").cast("string")).alias("dedupe_key"), F.lit("open").alias("status"))
    return geofence.alerts(found, stored).groupBy("geofence_id", "severity").agg(F.count("*").alias("n"))


@query("SELECT observation_id, round(lon * 111319.49079327358, 2) AS x, round(degrees(lon * 111319.49079327358 / 6378137.0), 9) AS lon_back FROM obs", ("obs",))
def mercator_round_trip(spark, d):
    obs = view(spark, d, "obs")
    x = F.col("lon") * 111319.49079327358
    return obs.select("observation_id", F.round(x, 2).alias("x"), F.round(geo.mercator_to_wgs84(x, F.lit(0.0))[0], 9).alias("lon_back"))


@query("SELECT observation_id, concat('POINT (', rtrim(rtrim(printf('%.9f', lon), '0'), '.'), ' ', rtrim(rtrim(printf('%.9f', lat), '0'), '.'), ')') AS wkt FROM obs", ("obs",))
def point_wkt(spark, d):
    return view(spark, d, "obs").select("observation_id", geo.point_wkt(F.col("lon"), F.col("lat")).alias("wkt"))


@query("SELECT CAST(json_extract_string(content_json, '$.k') AS BIGINT) % 5 AS k, count(*) AS n, count(*) FILTER (CAST(json_extract_string(content_json, '$.k') AS BIGINT) <> 0) AS truths FROM obs GROUP BY 1", ("obs",))
def json_fields(spark, d):
    k = F.try_variant_get(F.try_parse_json("content_json"), "$.k", "string")
    return view(spark, d, "obs").groupBy((k.cast("long") % 5).alias("k")).agg(F.count("*").alias("n"), F.count_if(rules.is_true(k)).alias("truths"))


@query("SELECT layer_key, replace(upper(substr(layer_key, 1, 1)) || substr(layer_key, 2), '-', ' ') AS name FROM (SELECT DISTINCT layer_key FROM obs WHERE layer_key <> 'click')", ("obs",))
def missing_layers(spark, d):
    catalog = spark.createDataFrame([("click",)], "layer_key string")
    return lookups.missing_layers(view(spark, d, "obs"), catalog)


@query("SELECT observation_id FROM obs WHERE (layer_key = 'error' OR user_id > 140) AND confidence_score >= 0.5 AND source_domain IN ('s1.example.com', 's5.example.com', 's19.example.com')", ("obs",))
def rule_predicates(spark, d):
    rule = {"all": [{"any": [{"field": "layer_key", "op": "eq", "value": "error"}, {"field": "user_id", "op": "gt", "value": 140}]}, {"field": "confidence_score", "op": "gte", "value": 0.5}, {"field": "source_domain", "op": "in", "value": ["s1.example.com", "s5.example.com", "s19.example.com"]}]}
    return view(spark, d, "obs").filter(observations.rule_predicate(rule)).select("observation_id")
