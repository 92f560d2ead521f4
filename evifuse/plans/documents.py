"""Page and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.functions import rules, urls
from evifuse.functions import text as tx
from evifuse.operators import discovery, entities, planning
from evifuse.plans.registry import query
from evifuse.session import table

HOST_SQL = "lower(regexp_extract(url, '://([^/?#]*)', 1))"
CANON_SQL = f"""c AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, {HOST_SQL} AS h, regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS p, list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))) AS q FROM pages),
canon AS (SELECT page_id, url, concat(s, '://', h, CASE WHEN p = '' THEN '/' ELSE p END, CASE WHEN len(q) > 0 THEN concat('?', array_to_string(q, '&')) ELSE '' END) AS canonical FROM c)"""


@query(f"SELECT regexp_replace({HOST_SQL}, '^www\\.', '') AS domain, count(*) AS n FROM pages GROUP BY 1")
def page_domains(spark, d):
    return table(spark, d, "pages").groupBy(tx.normalize_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"WITH {CANON_SQL} SELECT page_id, canonical AS canonical_url, sha256(canonical) AS url_hash FROM canon")
def canonical_urls(spark, d):
    canonical = table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))
    return canonical.withColumn("url_hash", urls.url_hash(F.col("canonical_url")))


@query(f"WITH {CANON_SQL} SELECT DISTINCT canonical AS canonical_url FROM canon")
def distinct_urls(spark, d):
    return table(spark, d, "pages").select(urls.canonical_url(F.col("url")).alias("canonical_url")).filter("canonical_url is not null").distinct()


@query("SELECT regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/[0-9]{8}(\\.[a-z]+)?$', '/{date}\\1'), '/[0-9]+(\\.[a-z]+)?/?$', '/{id}\\1'), '^$', '/') AS path_pattern, count(*) AS n FROM pages GROUP BY 1")
def path_patterns(spark, d):
    return table(spark, d, "pages").groupBy(urls.path_pattern(F.col("url")).alias("path_pattern")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS links, sha256(html) AS content_hash FROM pages")
def html_signals(spark, d):
    return table(spark, d, "pages").select("page_id", urls.html_title(F.col("html")).alias("title"), F.size(urls.html_links(F.col("html"))).cast("long").alias("links"), F.sha2("html", 256).alias("content_hash"))


@query("SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY 1")
def html_link_counts(spark, d):
    return table(spark, d, "pages").select(F.explode(urls.html_links(F.col("html"))).alias("link")).groupBy("link").agg(F.count("*").alias("n"))


@query(
    f"""SELECT CASE WHEN contains(lower(html), 'openapi') THEN 'api_docs' WHEN contains(lower(html), '<article') OR contains(lower(html), 'newsarticle') THEN 'article_page' ELSE 'html_page' END AS page_type, count(*) AS n FROM pages GROUP BY 1"""
)
def page_types(spark, d):
    p = table(spark, d, "pages")
    article = F.contains(F.lower("html"), F.lit("<article"))
    kind = urls.page_type(F.col("url"), tx.normalize_domain(F.col("url")), urls.html_title(F.col("html")), F.lit(""), F.lit(False), article)
    return p.groupBy(kind.alias("page_type")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN regexp_matches(lower(text), 'live feed|real-time|realtime|updated every minute') THEN 'live' WHEN regexp_matches(lower(text), 'hourly|every hour') THEN 'hourly' WHEN regexp_matches(lower(text), 'daily|every day') THEN 'daily' WHEN regexp_matches(lower(text), 'weekly|every week') THEN 'weekly' WHEN regexp_matches(lower(text), 'monthly|every month') THEN 'monthly' WHEN regexp_matches(lower(text), 'archive|historical|annual dataset') THEN 'archive' END AS cadence, count(*) AS n FROM documents GROUP BY 1")
def cadence_hints(spark, d):
    return table(spark, d, "documents").groupBy(urls.cadence(F.col("text")).alias("cadence")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lower(e) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', 0)) AS e FROM documents) GROUP BY 1, 2")
def email_signals(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(tx.emails(F.col("text"))).alias("e"))
    return docs.select("doc_id", tx.normalize_signal(F.lit("email"), F.col("e")).alias("email")).distinct()


@query(
    """RECURSIVE s AS (SELECT DISTINCT doc_id, lower(e) AS e FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', 0)) AS e FROM documents)),
walk(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM s UNION SELECT w.a, y.doc_id FROM walk w JOIN s x ON x.doc_id = w.b JOIN s y ON y.e = x.e),
lab AS (SELECT a AS doc_id, min(b) AS label FROM walk GROUP BY 1)
SELECT count(DISTINCT l.doc_id) AS observation_count, count(DISTINCT s.e) AS signal_count, round(least(0.99::DOUBLE, 0.84::DOUBLE + least(0.15::DOUBLE, 0.05::DOUBLE * (count(DISTINCT l.doc_id) - 1)) + least(0.1::DOUBLE, 0.05::DOUBLE * (count(DISTINCT source) - 1)) + least(0.06::DOUBLE, 0.03::DOUBLE * (count(DISTINCT lang) - 1))), 6) AS confidence FROM lab l JOIN s USING (doc_id) JOIN documents d USING (doc_id) GROUP BY label HAVING count(DISTINCT l.doc_id) >= 2""".replace("RECURSIVE s AS", "WITH RECURSIVE s AS", 1),
)
def entity_resolution(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("observation_id"), F.col("source").alias("source_domain"), F.col("lang").alias("layer_key"), F.col("text").alias("content_text"))
    found = entities.signals(docs, payload=None).filter("signal_key = 'email'")
    return entities.resolve(found).select("observation_count", "signal_count", F.round("confidence", 6).alias("confidence"))


@query("SELECT sha256(text) AS raw_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("raw_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("SELECT line, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY 1 HAVING count(*) >= 5")
def repeated_lines(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n")).filter("n >= 5")


@query("SELECT doc_id, substr(regexp_replace(regexp_replace(text, '(?i)file://[^ \\t\\r\\n]+', '[local path]', 'g'), '(?i)\\b[a-z]:\\\\[^ \\t\\r\\n]+', '[local path]', 'g'), 1, 4000) AS shown FROM documents")
def public_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.sanitize_public(F.col("text")).alias("shown"))


@query(f"SELECT CASE WHEN ends_with({HOST_SQL}, '.example.org') THEN 'domain_denylist' WHEN regexp_matches(url, '://[^/]*/en/') THEN 'path_denied' WHEN NOT regexp_matches(url, '://[^/]*/[a-z][a-z]/[0-9][^?#]*') THEN 'path_not_allowed' ELSE 'admitted' END AS decision, count(*) AS n FROM pages GROUP BY 1")
def url_admission(spark, d):
    p = table(spark, d, "pages").select(tx.normalize_domain(F.col("url")).alias("domain"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    rule = discovery.admission(p, allow=["example.com", "example.net", "example.org"], deny=["example.org"], denied_paths=["/en/*"], allowed_paths=["/??/*"])
    return p.groupBy(rule.alias("decision")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id FROM pages WHERE regexp_replace({HOST_SQL}, '^www\\.', '') = 'spam-farm.example.com' OR ends_with({HOST_SQL}, '.example.net') OR {HOST_SQL} = 'example.net'")
def active_suppressions(spark, d):
    c = table(spark, d, "pages").select(F.col("page_id").alias("candidate_id"), tx.normalize_domain(F.col("url")).alias("domain"), F.col("url").alias("canonical_url"))
    s = spark.createDataFrame([("domain", "spam-farm.example.com", None), ("domain", "example.net", "2030-01-01"), ("domain", "example.com", "2020-01-01")], "scope string, value string, e string").withColumn("expires_at", F.to_timestamp("e"))
    return discovery.suppressed(c, s, F.lit("2024-01-01").cast("timestamp")).select(F.col("candidate_id").alias("page_id"))


NAME_SQL = f"WITH p AS (SELECT page_id, regexp_replace({HOST_SQL}, '^www\\.', '') AS name, page_id % 3 AS c, page_id % 2 AS d FROM pages), k AS (SELECT *, min(page_id) OVER (PARTITION BY name, c, d) AS class_id FROM p)"


def _persons(spark, d):
    """Persons named by the host of a page; two shared contexts on equal page_id % 3, two domains on unequal page_id % 2."""
    i = F.col("page_id")
    s = lambda c: c.cast("string")
    return table(spark, d, "pages").select(
        i.alias("candidate_id"), F.lit("person").alias("entity_type"), F.array(tx.normalize_domain(F.col("url"))).alias("names"), F.create_map().cast("map<string,string>").alias("ids"),
        F.create_map(F.lit("city"), s(i % 3), F.lit("date"), s(i % 3)).alias("context"), F.array(s(i % 2)).alias("domains"), F.lit(True).alias("cited"), F.lit(0.8).alias("reliability"),
    )


@query(f"{NAME_SQL}, r AS (SELECT class_id, name, c, d, count(*) AS n FROM k GROUP BY ALL) SELECT a.class_id AS left_id, b.class_id AS right_id, a.n AS left_count, b.n AS right_count, CASE WHEN a.d <> b.d AND a.c = b.c THEN 'merge' ELSE 'ambiguous' END AS decision FROM r a JOIN r b ON a.name = b.name AND (a.class_id < b.class_id OR a.class_id = b.class_id AND a.n > 1)")
def merge_decisions(spark, d):
    return entities.merge_pairs(_persons(spark, d))


@query(f"{NAME_SQL} SELECT page_id AS candidate_id, class_id FROM k")
def merge_classes(spark, d):
    return entities.evidence_classes(_persons(spark, d)).select("candidate_id", "class_id")


@query("SELECT lang, CASE WHEN c = 'archive_dataset' THEN 604800 WHEN lang = 'fr' THEN 300 WHEN lang = 'es' THEN 1800 WHEN lang = 'de' THEN 21600 WHEN c = 'api' THEN 3600 ELSE 86400 END AS seconds, count(*) AS n FROM (SELECT lang, CASE doc_id % 3 WHEN 0 THEN 'archive_dataset' WHEN 1 THEN 'api' ELSE 'html_page' END AS c FROM documents) GROUP BY 1, 2")
def revisit_intervals(spark, d):
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN 'archive_dataset' WHEN 1 THEN 'api' ELSE 'html_page' END")
    pace = rules.lookup(F.col("lang"), {"fr": "live", "es": "hourly", "de": "daily"}, "unknown")
    return table(spark, d, "documents").groupBy("lang", rules.revisit_seconds(kind, F.lit("html"), pace, F.lit(False)).alias("seconds")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS query FROM documents")
def research_queries(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalize_query(F.array("text")).alias("query"))


@query("SELECT CASE WHEN page_id % 5 = 0 THEN 'provider_disabled' WHEN page_id % 7 = 0 THEN 'robots_not_supported' WHEN page_id % 3 = 0 THEN 'language_not_supported' WHEN page_id % 11 = 0 THEN 'no_static_collection_capability' ELSE 'planned' END AS reason, count(*) AS n FROM pages GROUP BY 1")
def fleet_plan(spark, d):
    i, words = F.col("page_id"), lambda *xs: F.array(*[F.lit(x) for x in xs])
    p = table(spark, d, "pages").select(
        i.alias("provider_id"), F.lit("public_dataset").alias("source_kind"), (i % 5 != 0).alias("enabled"), F.lit("free").alias("cost"), (i % 7 != 0).alias("robots_supported"),
        F.when(i % 3 == 0, words("de")).otherwise(words("en", "fr")).alias("languages"), F.when(i % 11 == 0, words("search")).otherwise(words("search", "rss_atom")).alias("capabilities"),
    )
    return planning.fleet_plan(p, "new pier").groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT event_id AS run, replace(replace(to_base64(encode(concat('{\"v\":1,\"watch_run_id\":', event_id, '}'))), '+', '-'), '/', '_') AS cursor FROM events")
def feed_cursors(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("run"), tx.cursor_encode(F.col("event_id")).alias("cursor"))
