"""Source discovery: scoring, admission, inventory diff, suppression, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import rules

# Fixed values.
WEIGHTS = {"relevance": 0.18, "geo": 0.18, "temporal": 0.10, "structural": 0.12, "freshness": 0.10, "stability": 0.10, "trust": 0.12, "novelty": 0.10}
BUCKETS = (("promote_now", 72.0), ("keep_candidate", 52.0), ("revisit_later", 32.0))
ALIASES = {"geospatial_relevance": "geo", "structural_usefulness": "structural"}
RELEVANCE = {"api_docs": 75, "archive_dataset": 65, "article_page": 65, "camera_image": 75, "camera_page": 65, "camera_stream": 78, "geojson_endpoint": 80, "government_notice": 78, "open_data_portal": 75, "repeating_status_page": 78, "rss_feed": 75, "atom_feed": 75, "social_reference": 25}


def relevance(document_type: Column, terms: list[str] | None, title: Column, url: Column, text: Column) -> Column:
    terms = [t.strip().lower() for t in terms or [] if t.strip()]
    if not terms:
        return rules.lookup(document_type, {k: float(v) for k, v in RELEVANCE.items()}, 55.0)
    head = F.lower(F.concat_ws(" ", title, url))
    body = F.lower(text)
    n = lambda hay: sum((F.contains(h, F.lit(t)).cast("double") for t in terms for h in [hay]), F.lit(0.0))
    either = sum((F.when(F.contains(head, F.lit(t)) | F.contains(body, F.lit(t)), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))
    return rules.clamp(15 + either / len(terms) * 70 + n(head) / len(terms) * 15, 0.0, 100.0)


def trust_component(level: Column, official: Column) -> Column:
    base = rules.lookup(level, {"trusted": 90.0, "blocked": 0.0}, 50.0)
    return F.when((level != "blocked") & official, F.greatest(base, F.lit(82.0))).otherwise(base)


def redundancy(same_pattern: Column, managed: Column) -> Column:
    return F.least(F.lit(100.0), same_pattern * 12.0 + managed * 60.0)


def bucket(total: Column, quarantine: Column, reference_only: Column) -> Column:
    return rules.first_reason((quarantine, "quarantine"), (reference_only, "ignore"), *[(total >= v, b) for b, v in BUCKETS], otherwise="ignore")


def score(df: DataFrame, custom: dict[str, float] | None = None) -> DataFrame:
    """Total and bucket from component columns, ``operational_cost``, ``redundancy_penalty``, ``quarantine``, ``reference_only``.

    Custom weights replace the named ones and all are scaled to sum to one; quarantine then stays, nothing else does.
    """
    weights = dict(WEIGHTS)
    for k, v in (custom or {}).items():
        k = ALIASES.get(k, k)
        if k in weights:
            weights[k] = max(0.0, float(v))
    whole = sum(weights.values())
    custom_used = bool(custom) and whole > 0
    if custom_used:
        weights = {k: v / whole for k, v in weights.items()}
    else:
        weights = dict(WEIGHTS)
    positive = sum((F.round(F.col(k), 2) * w for k, w in weights.items()), F.lit(0.0))
    penalty = F.round(F.col("operational_cost") * 0.10, 2) + F.round(F.col("redundancy_penalty") * 0.15, 2)
    out = df.withColumn("total_score", F.round(rules.clamp(positive - penalty, 0.0, 100.0), 2))
    return out.withColumn("bucket", bucket(F.col("total_score"), F.col("quarantine"), F.lit(False) if custom_used else F.col("reference_only")))


def status(bucket_: Column, trust: Column, existing: Column) -> Column:
    """Promoted and suppressed are sticky."""
    return rules.first_reason(
        (existing == "promoted", "promoted"),
        (existing == "suppressed", "suppressed"),
        ((trust == "blocked") | (bucket_ == "quarantine"), "quarantined"),
        (bucket_ == "ignore", "ignored"),
        (bucket_ == "revisit_later", "deferred"),
        otherwise="candidate",
    )


def pattern_counts(candidates: DataFrame) -> DataFrame:
    """Candidates of the same domain and path pattern; joined back on the pair."""
    n = candidates.groupBy("domain", "path_pattern").agg(F.count("*").alias("same_pattern_count"))
    return candidates.join(n, ["domain", "path_pattern"])


def inventory_diff(before: DataFrame, after: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Change of each candidate between two runs' latest revisions."""
    b = before.select("candidate_id", *[F.col(c).alias(f"b_{c}") for c in ("content_hash", "schema_hash", "score_bucket", "score", "status")], F.lit(True).alias("b"))
    a = after.select("candidate_id", *[F.col(c).alias(f"a_{c}") for c in ("content_hash", "schema_hash", "score_bucket", "score", "status")], F.lit(True).alias("a"))
    j = b.join(a, "candidate_id", "full_outer")
    differs = ~F.col("b_content_hash").eqNullSafe(F.col("a_content_hash")) | ~F.col("b_schema_hash").eqNullSafe(F.col("a_schema_hash")) | ~F.col("b_score_bucket").eqNullSafe(F.col("a_score_bucket")) | (F.abs(F.col("b_score") - F.col("a_score")) >= threshold)
    newly = lambda s: F.col("a").isNotNull() & (F.col("a_status") == s) & (F.col("b").isNull() | (F.col("b_status") != s))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "disappeared").when(differs, "changed").otherwise("same")
    return j.select("candidate_id", change.alias("change"), F.coalesce(newly("promoted"), F.lit(False)).alias("newly_promoted"), F.coalesce(newly("suppressed"), F.lit(False)).alias("newly_suppressed"))


def admission(df: DataFrame, *, allow: list[str] = (), deny: list[str] = (), denied_paths: list[str] = (), allowed_paths: list[str] = (), policy: Column | None = None) -> Column:
    """Ordered URL admission over ``domain`` and ``path``: first reason wins."""
    within = lambda ds: _any([rules.domain_within(F.col("domain"), F.lit(d)) for d in ds])
    globs = lambda ps: _any([rules.glob(F.col("path"), p) for p in ps])
    cases = [(F.coalesce(F.col("domain"), F.lit("")) == "", "invalid_domain")]
    if allow:
        cases.append((~within(allow), "not_in_domain_allowlist"))
    if deny:
        cases.append((within(deny), "domain_denylist"))
    if policy is not None:
        cases += [(policy == p, f"domain_policy_{p}") for p in ("deny", "block", "quarantine")]
    if denied_paths:
        cases.append((globs(denied_paths), "path_denied"))
    if allowed_paths:
        cases.append((~globs(allowed_paths), "path_not_allowed"))
    return rules.first_reason(*cases, otherwise="admitted")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def suppressed(candidates: DataFrame, suppressions: DataFrame, as_of: Column) -> DataFrame:
    """Candidates under an active suppression of their URL or of a parent domain. Both scopes meet by equality."""
    from evifuse.operators.lookups import suffixes

    live = suppressions.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    by_url = candidates.join(live.filter("scope = 'candidate'").select(F.col("value").alias("canonical_url")).distinct(), "canonical_url", "left_semi").select("candidate_id")
    names = candidates.select("candidate_id", F.explode(suffixes(F.col("domain"))).alias("value"))
    by_domain = names.join(live.filter("scope = 'domain'").select("value").distinct(), "value", "left_semi").select("candidate_id")
    return by_url.union(by_domain).distinct()


def lineage(edges: DataFrame, candidate: int) -> DataFrame:
    """One-hop ancestors and descendants."""
    up = edges.filter(F.col("child_id") == candidate).select(F.col("parent_id").alias("candidate_id"), F.lit("ancestor").alias("role"))
    return up.union(edges.filter(F.col("parent_id") == candidate).select("child_id", F.lit("descendant"))).distinct()


def frontier_batch(frontier: DataFrame, per_domain: int, size: int) -> DataFrame:
    """Next entries by priority, at most ``per_domain`` of a domain."""
    from evifuse.operators.windows import per_group_limit

    top = per_group_limit(frontier, ["domain"], [F.desc("priority"), F.col("frontier_id")], per_domain)
    return top.orderBy(F.desc("priority"), "frontier_id").limit(size)


def run_warnings(fetched: DataFrame) -> DataFrame:
    """Junk, domain and robots spikes of each run over ``(run_id, domain, junk, robots_blocked)``."""
    domains = fetched.groupBy("run_id", "domain").agg(F.count("*").alias("n"), F.count_if("junk").alias("j"), F.count_if("robots_blocked").alias("r"))
    runs = domains.groupBy("run_id").agg(F.sum("n").alias("total"), F.sum("j").alias("junk_count"), F.sum("r").alias("robots_count"), F.max("n").alias("top_domain_count"))
    return runs.select(
        "run_id",
        "total",
        ((F.col("total") >= 10) & (F.col("junk_count") / F.col("total") >= 0.8)).alias("junk_spike"),
        ((F.col("top_domain_count") >= 10) & (F.col("top_domain_count") / F.col("total") >= 0.7)).alias("domain_spike"),
        (F.col("robots_count") >= 5).alias("robots_spike"),
    )


def health_result(previous_content: Column, content: Column, previous_schema: Column, schema: Column) -> Column:
    return rules.first_reason((previous_schema.isNotNull() & (previous_schema != schema), "schema_changed"), (previous_content.isNotNull() & (previous_content != content), "changed"), otherwise="healthy")


def keep_score(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Best score stays unless the same campaign, or an equal or better score, replaces it."""
    j = stored.select("candidate_id", F.col("campaign_id").alias("sc"), F.col("score").alias("ss")).join(fresh.select("candidate_id", F.col("campaign_id").alias("fc"), F.col("score").alias("fs")), "candidate_id", "full_outer")
    take = F.col("ss").isNull() | (F.col("fs").isNotNull() & ((F.col("sc") == F.col("fc")) | (F.col("fs") >= F.col("ss"))))
    return j.select("candidate_id", F.when(take, F.col("fc")).otherwise(F.col("sc")).alias("campaign_id"), F.when(take, F.col("fs")).otherwise(F.col("ss")).alias("score"))


def seeds(spark, queries: list[str], templates: list[str], languages: list[str], locales: list[str]) -> DataFrame:
    """Search seeds: every query in every template, language and locale; a query that is a URL seeds directly."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    q = spark.range(1).select(F.explode(lit(queries)).alias("query"))
    direct = q.filter(F.col("query").rlike("^https?://")).select(F.col("query").alias("url"), F.lit("direct").alias("kind"))
    made = q.filter(~F.col("query").rlike("^https?://")).select("query", F.explode(lit(templates)).alias("t")).select("query", "t", F.explode(lit(languages)).alias("l")).select("query", "t", "l", F.explode(lit(locales)).alias("c"))
    url = F.replace(F.replace(F.replace(F.col("t"), F.lit("{query}"), F.url_encode("query")), F.lit("{language}"), F.col("l")), F.lit("{locale}"), F.col("c"))
    return direct.union(made.select(url, F.lit("search"))).distinct()
