"""Collection planning: retries, alternates, research plans, provider rules, state machine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.functions import rules
from evifuse.operators.windows import per_group_limit

# Fixed values.
TRANSITIONS = {
    "draft": ("planning", "archived", "failed"),
    "planning": ("collecting", "insufficient_evidence", "failed", "archived"),
    "collecting": ("normalizing", "insufficient_evidence", "failed", "archived"),
    "normalizing": ("corroborating", "insufficient_evidence", "failed", "archived"),
    "corroborating": ("reporting", "insufficient_evidence", "failed", "archived"),
    "reporting": ("ready", "insufficient_evidence", "failed", "archived"),
    "ready": ("monitoring", "archived"),
    "monitoring": ("archived",),
    "archived": (),
    "insufficient_evidence": ("archived",),
    "failed": ("archived",),
}
NEEDS_REASON = ("failed", "insufficient_evidence")
RETRIABLE = ("network_error", "timeout", "rate_limited", "server_error")
CAPABILITIES = ("search", "fetch_feed", "fetch_static", "parse_document", "browser_render", "source_health")
STATIC_CAPABILITIES = ("structured_api", "rss_atom", "sitemap", "static_html", "document", "dataset")
SOURCE_TYPES = ("government", "court", "financial", "news", "dataset", "website", "rss", "api", "social", "video")
PRIVATE_HOST = r"^(?:localhost|.*\.localhost|.*\.local|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|0\..*|\[?::1\]?|\[?f[cd][0-9a-f:]*\]?|\[?fe80:.*\]?)$"


def backoff(attempt: Column, base: float = 1.0, most: float = 300.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))


def coverage_actions(attempts: DataFrame, max_retries: int = 2, base: float = 60.0, most: float = 3600.0, class_budget: int = 10) -> DataFrame:
    """Action after each attempt in order of ``seq``: none, retry with a delay, or a recorded gap."""
    by_source = Window.partitionBy("source_id").orderBy("seq")
    by_class = Window.partitionBy("domain_class").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n, m = F.row_number().over(by_source), F.count("*").over(by_class)
    df = attempts.withColumn("source_attempts", n).withColumn("class_attempts", m)
    retry = (F.col("outcome") == "failed") & F.col("failure_kind").isin(*RETRIABLE) & (F.col("source_attempts") <= max_retries) & (F.col("class_attempts") < class_budget)
    action = rules.first_reason((F.col("outcome") == "success", "none"), (retry, "retry_source"), otherwise="record_research_gap")
    return df.withColumn("action", action).withColumn("delay_seconds", F.when(F.col("action") == "retry_source", backoff(F.col("source_attempts"), base, most)))


def alternates(candidates: DataFrame, attempted: DataFrame, used: DataFrame, budget: int, most: int, kinds: list[str] | None = None) -> DataFrame:
    """Untried, enabled candidates by rank under what is left of each class's budget."""
    c = candidates.filter("enabled")
    if kinds is not None:
        c = c.filter(F.col("source_kind").isin(*kinds))
    c = c.join(attempted.select("source_id").distinct(), "source_id", "left_anti").join(used, "domain_class", "left")
    left = F.lit(budget) - F.coalesce("used", F.lit(0))
    return per_group_limit(c, ["domain_class"], [F.col("alternate_rank"), F.col("source_id")], left).orderBy("alternate_rank", "source_id").limit(most)


def research_plan(sources: DataFrame, class_cap: int, domain_cap: int, global_cap: int, question: str = "question_id") -> DataFrame:
    """Greedy picks per question under class, domain and global caps, in order of relevance, trust, class, domain and id.

    Among sources of one class and domain the picked ones come first, for every full cap stays full: only the first
    ``min`` of the caps of each can be picked, and the others go before the shuffle. The caps depend on one another, so the rest is
    folded in order; Spark sorts, and the fold holds the counts of one question.
    """
    order = [F.desc("relevance"), F.desc("trust"), "source_class", "domain", "source_id"]
    few = per_group_limit(sources, [question, "source_class", "domain"], [*order[:2], "source_id"], min(class_cap, domain_cap, global_cap))

    def run_task(batches):
        key, classes, domains, taken = None, {}, {}, 0
        for pdf in batches:
            keep = []
            for q, c, d in zip(pdf[question].tolist(), pdf["source_class"].tolist(), pdf["domain"].tolist()):
                if q != key:
                    key, classes, domains, taken = q, {}, {}, 0
                ok = taken < global_cap and classes.get(c, 0) < class_cap and domains.get(d, 0) < domain_cap
                if ok:
                    classes[c], domains[d], taken = classes.get(c, 0) + 1, domains.get(d, 0) + 1, taken + 1
                keep.append(ok)
            out = pdf[pd.Series(keep, index=pdf.index, dtype=bool)]
            yield out.assign(priority=1000 + out["relevance"] * 10 + (out["trust"] * 10).astype(int))[[question, "source_id", "priority"]]

    ordered = few.repartition(question).sortWithinPartitions(question, *order)
    return ordered.mapInPandas(run_task, f"{question} long, source_id long, priority long")


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def fleet_plan(providers: DataFrame, query: str, languages: tuple[str, ...] = ("en",), kinds: tuple[str, ...] = ()) -> DataFrame:
    """One row per provider of the wanted kinds: why it is blocked, or a task with a stable id.

    ``providers(provider_id, source_kind, enabled, cost, robots_supported, languages, capabilities)``.
    """
    wanted = sorted({x.strip().lower() for x in languages if x.strip()}) or ["en"]
    df = providers.filter(F.col("source_kind").isin(*kinds)) if kinds else providers
    df = df.withColumn("languages", F.filter(_words(wanted), lambda x: F.array_contains("languages", x)))
    df = df.withColumn("capability", F.get(F.filter("capabilities", lambda c: c.isin(*STATIC_CAPABILITIES)), F.lit(0)))
    reason = rules.first_reason(
        (~F.col("enabled") | (F.col("cost") == "disabled"), "provider_disabled"),
        (~F.col("robots_supported"), "robots_not_supported"),
        (F.size("languages") == 0, "language_not_supported"),
        (F.col("capability").isNull(), "no_static_collection_capability"),
        otherwise="planned",
    )
    key = F.concat_ws("\0", F.col("provider_id").cast("string"), "capability", F.lit(query), F.array_join("languages", ","))
    planned = F.col("reason") == "planned"
    out = df.withColumn("reason", reason).withColumn("task_id", F.when(planned, F.concat(F.lit("fleet-"), F.substring(F.sha2(key, 256), 1, 20))))
    return out.withColumn("priority", F.when(planned, F.when(F.col("source_kind") == "official_public_record", 1100).otherwise(1000)))


def under_origin(url: Column, origin: Column) -> Column:
    """Same scheme, host and port, and a path at or below the origin's."""
    place = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*", 0))
    path = lambda u: F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    root = F.regexp_replace(path(origin), "/+$", "")
    return (place(url) == place(origin)) & ((path(url) == root) | path(url).startswith(F.concat(root, F.lit("/"))) | (root == ""))


def provider_decision(df: DataFrame) -> Column:
    """Ordered rules over (paused, enabled, health, capability, capabilities, url, base_urls)."""
    return rules.first_reason(
        (F.col("paused"), "domain_paused"),
        (~F.col("enabled"), "provider_disabled"),
        (F.col("health") == "schema_quarantined", "schema_quarantined"),
        (~F.col("health").eqNullSafe(F.lit("healthy")), "provider_disabled"),
        (~F.col("capability").isin(*CAPABILITIES) | ~F.array_contains("capabilities", F.col("capability")), "unsupported_capability"),
        (~F.col("url").rlike("^(?i:https?)://[^/?#@]+(?:[/?#]|$)") | _private(F.col("url")), "unsafe_target"),
        (~F.exists("base_urls", lambda b: under_origin(F.col("url"), b)), "origin_not_allowed"),
        otherwise="allowed",
    )


def _private(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)).rlike(PRIVATE_HOST)


def source_policy(url: Column, source_type: Column, public: Column, login: Column, payment: Column, bypass: Column, terms: Column) -> Column:
    """Why a public source may not be collected, else null; what is unknown denies."""
    no = lambda c: F.coalesce(~c, F.lit(True))
    reason = rules.first_reason(
        (no(url.rlike("^(?i:https?)://[^/?#@]+(?:[/?#]|$)")), "source URL must be a credential-free HTTP(S) URL"),
        (_private(url), "private or local source addresses are not public sources"),
        (no(F.lower(F.trim(source_type)).isin(*SOURCE_TYPES)), "source type is not approved for public-record adapters"),
        (no(public) | no(~login) | no(~payment) | no(~bypass) | no(terms), "source must be legally accessible without login, payment, or bypass"),
        otherwise="",
    )
    return F.nullif(reason, F.lit(""))


def provider_coverage(providers: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per capability: configured and available providers, and whether there is a gap."""
    caps = providers.select("provider_id", F.explode("capabilities").alias("capability"), (F.col("enabled") & (F.col("health") != "unhealthy")).alias("ok"))
    words = providers.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in vocabulary])).alias("capability"))
    out = words.join(caps, "capability", "left").groupBy("capability").agg(F.count("provider_id").alias("configured"), F.count_if("ok").alias("available"))
    return out.withColumn("gap", F.col("available") == 0)


def transitions(df: DataFrame, current: str = "status", wanted: str = "next_status", stop_reason: str = "stop_reason") -> DataFrame:
    """Adds ``legal``: the move is listed, and an end without a result names its reason."""
    listed = F.lit(False)
    for a, bs in TRANSITIONS.items():
        if bs:
            listed = listed | ((F.col(current) == a) & F.col(wanted).isin(*bs))
    reasoned = ~F.col(wanted).isin(*NEEDS_REASON) | (F.coalesce(F.trim(stop_reason), F.lit("")) != "")
    return df.withColumn("legal", F.coalesce(listed & reasoned, F.lit(False)))


def next_work(items: DataFrame, attempted: DataFrame) -> DataFrame:
    return items.join(attempted.select("item_id").distinct(), "item_id", "left_anti").orderBy(F.desc("priority"), "item_id").limit(1)
