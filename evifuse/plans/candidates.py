"""Candidate merge and its log, applied in three batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evifuse.functions import urls
from evifuse.operators import candidates, links
from evifuse.plans.documents import CANON_SQL
from evifuse.plans.registry import query
from evifuse.session import shared_dir, table

BUCKET_SQL = "CASE WHEN {s} >= 72 THEN 'promote_now' WHEN {s} >= 52 THEN 'keep_candidate' WHEN {s} >= 32 THEN 'revisit_later' ELSE 'ignore' END"
SEEN_SQL = """o AS MATERIALIZED (SELECT concat('u', user_id) AS url_hash, length(event_type) AS c, event_id AS run_id, ts, least(value, 100.0) AS s, event_type AS h,
row_number() OVER (PARTITION BY user_id ORDER BY event_id * 3 // (SELECT max(event_id) + 1 FROM events), ts, event_id) AS rn FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)"""


def _applied(spark, d) -> str:
    e = table(spark, d, "events")
    end = (e.agg(F.max("event_id")).first()[0] or 0) + 1
    seen = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url_hash"), F.concat(F.lit("https://u.example/"), F.col("user_id").cast("string")).alias("canonical_url"), F.length("event_type").cast("long").alias("campaign_id"),
        F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("observed_at"), F.least("value", F.lit(100.0)).alias("score"), F.lit(None).cast("string").alias("trust_level"), F.col("event_type").alias("content_hash"), F.lit(None).cast("string").alias("schema_hash"),
    )
    root = f"{shared_dir(spark)}/candidates-{uuid.uuid4().hex}"
    for k in range(3):
        candidates.apply_batch(spark, root, k, seen.filter(F.floor(F.col("run_id") * 3 / end) == k))
    return root


@query(
    f"""WITH RECURSIVE {SEEN_SQL},
f AS (SELECT url_hash, rn, s AS score, c AS owner, h, run_id AS first_run_id, run_id AS last_run_id, ts AS seen, ts AS changed FROM o WHERE rn = 1
UNION ALL SELECT o.url_hash, o.rn, CASE WHEN f.owner = o.c OR o.s >= f.score THEN o.s ELSE f.score END, CASE WHEN f.owner = o.c OR o.s >= f.score THEN o.c ELSE f.owner END, o.h, f.first_run_id, o.run_id, o.ts, CASE WHEN o.h <> f.h THEN o.ts ELSE f.changed END FROM f JOIN o ON o.url_hash = f.url_hash AND o.rn = f.rn + 1)
SELECT url_hash, score, {BUCKET_SQL.format(s="score")} AS score_bucket, CASE WHEN score >= 52 THEN 'candidate' WHEN score >= 32 THEN 'deferred' ELSE 'ignored' END AS status, owner AS owner_campaign_id, h AS content_hash, first_run_id, last_run_id, epoch_us(seen) AS last_seen_us, epoch_us(changed) AS last_changed_us, rn AS revisions
FROM f QUALIFY rn = max(rn) OVER (PARTITION BY url_hash)"""
)
def candidate_upsert(spark, d):
    s = candidates.states(spark, _applied(spark, d))
    return s.select("url_hash", "score", "score_bucket", "status", "owner_campaign_id", "content_hash", "first_run_id", "last_run_id", F.unix_micros("last_seen_at").alias("last_seen_us"), F.unix_micros("last_changed_at").alias("last_changed_us"), "revisions")


@query(
    f"""WITH {SEEN_SQL} SELECT url_hash, rn AS revision_number, CASE WHEN rn = 1 THEN 'discovered' ELSE 'rediscovered' END AS revision_kind, coalesce(h <> lag(h) OVER w, true) AS changed, c AS campaign_id, run_id, s AS observed_score, {BUCKET_SQL.format(s="s")} AS observed_bucket
FROM o WINDOW w AS (PARTITION BY url_hash ORDER BY rn)"""
)
def candidate_revisions(spark, d):
    r = candidates.revisions(spark, _applied(spark, d))
    return r.select("url_hash", "revision_number", "revision_kind", "changed", "campaign_id", "run_id", "observed_score", "observed_bucket")


CAMPAIGN = links.Campaign(format_targets=("feed", "csv"), deny=("example.org",), denied_paths=("/the*",))


@query(
    f"""WITH {CANON_SQL},
base AS (SELECT page_id, canonical, regexp_extract(canonical, '^([a-z]+://[^/]*)', 1) AS root FROM canon),
hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
l AS (SELECT b.page_id AS parent_id, NULL AS relation, b.root || h.href AS u, true AS near, b.page_id % 4 AS depth, b.page_id % 11 = 0 AS search FROM hrefs h JOIN base b USING (page_id)
UNION ALL SELECT b.page_id, CASE t.page_id % 5 WHEN 0 THEN 'feed' WHEN 1 THEN 'sitemap' WHEN 2 THEN 'image' ELSE 'link' END, t.canonical, false, b.page_id % 4, b.page_id % 11 = 0 FROM base b JOIN base t ON t.page_id = b.page_id + 1),
m AS (SELECT *, CASE WHEN search THEN 'query_result' WHEN relation = 'sitemap' THEN 'sitemap_expansion' WHEN relation IN ('feed', 'image') THEN 'format_targeted' ELSE 'neighborhood' END AS method FROM l),
r AS (SELECT *, CASE WHEN depth >= 3 THEN 'max_depth' WHEN method = 'format_targeted' AND relation <> 'feed' THEN 'format_not_targeted' WHEN method <> 'query_result' AND NOT near THEN 'cross_domain' END AS skip FROM m),
e AS (SELECT u, count(*) AS n FROM r WHERE skip IS NULL GROUP BY u),
j AS (SELECT n, regexp_replace(regexp_extract(u, '://([^/]*)', 1), '^www\\.', '') AS host, regexp_extract(u, '://[^/?]*([^?]*)', 1) AS path, EXISTS (SELECT 1 FROM base b WHERE b.canonical = e.u AND b.page_id % 7 = 0) AS known FROM e),
w AS (SELECT n, CASE WHEN known THEN 'known' WHEN ('.' || host) LIKE '%.tionsh.example.net' THEN 'active_suppression' WHEN host LIKE '%example.org' THEN 'domain_denylist' WHEN path LIKE '/the%' THEN 'path_denied' END AS reason FROM j)
SELECT state, reason, count(*) AS entries, sum(links)::bigint AS links FROM (
SELECT CASE WHEN reason = 'known' THEN 'known' WHEN reason IS NULL THEN 'queued' ELSE 'blocked' END AS state, reason, CASE WHEN reason = 'known' THEN n ELSE 1 END AS links FROM w
UNION ALL SELECT 'repeated', 'repeated', n - 1 FROM w WHERE n > 1 AND reason IS DISTINCT FROM 'known'
UNION ALL SELECT 'skipped', skip, count(*) FROM r WHERE skip IS NOT NULL GROUP BY method, skip) GROUP BY ALL"""
)
def link_admission(spark, d):
    p = table(spark, d, "pages")
    of = [F.col("page_id").alias("parent_id"), F.col("url").alias("parent_url"), (F.col("page_id") % 4).cast("int").alias("depth"), (F.col("page_id") % 11 == 0).alias("search_page")]
    own = p.select(*of, F.posexplode(urls.html_links(F.col("html"))).alias("position", "url"), F.lit(None).cast("string").alias("relation"), F.lit(True).alias("same_domain"))
    k = F.col("next_id") % 5
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("page_id").alias("next_id"), F.col("url").alias("link"))
    far = p.join(after, "page_id").select(*of, F.lit(1_000_000).alias("position"), F.col("link").alias("url"), F.when(k == 0, "feed").when(k == 1, "sitemap").when(k == 2, "image").otherwise("link").alias("relation"), F.lit(False).alias("same_domain"))
    found = own.unionByName(far).withColumns({"link_source": F.lit(None).cast("string"), "link_format": F.lit(None).cast("string"), "parent_type": F.lit("page")})
    frontier = p.filter("page_id % 7 = 0").select(urls.canonical_url(F.col("url")).alias("c")).select(urls.url_hash(F.col("c")).alias("url_hash"))
    stop = spark.createDataFrame([("domain", "tionsh.example.net", None), ("domain", "example.com", "2020-01-01 00:00:00")], "scope string, value string, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    out = links.admit(found, frontier, CAMPAIGN, stop, F.lit("2024-01-01").cast("timestamp"))
    return out.groupBy("state", "reason").agg(F.count("*").alias("entries"), F.sum("links").alias("links"))
