"""Admission of the links of analysed pages to a run's frontier: routing by campaign mode, then one entry per canonical URL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import rules, urls
from evifuse.functions import text as tx
from evifuse.operators import discovery
from evifuse.session import shared_dir

# Fixed values.
FORMAT_EXTENSIONS = ("atom", "csv", "geojson", "json", "jsonl", "kml", "m3u8", "pdf", "rss", "txt", "xml", "yaml", "yml")
FORMAT_RELATIONS = ("feed", "api", "openapi", "sitemap", "download", "stream", "image")
PRIORITY = {"query_result": 85.0, "sitemap_expansion": 80.0, "format_targeted": 75.0, "neighborhood": 50.0}


@dataclass(frozen=True)
class Campaign:
    """What a campaign admits."""

    modes: tuple[str, ...] = ("seed_url", "neighborhood", "sitemap", "format_targeted")
    max_depth: int = 3
    format_targets: tuple[str, ...] = ()
    allow_cross_domain: bool = False
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    denied_paths: tuple[str, ...] = ()
    allowed_paths: tuple[str, ...] = ()


def extension(url: Column) -> Column:
    """Lower-case extension of the last path segment, empty without one."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))


def route(campaign: Campaign) -> tuple[Column, Column]:
    """(method, reason) of links with ``url, relation, link_source, link_format, same_domain, depth, search_page, parent_type``; the reason is null where the link is followed."""
    relation, ext = F.coalesce(F.col("relation"), F.lit("link")), extension(F.col("url"))
    sitemap = (relation == "sitemap") | ((F.coalesce(F.col("parent_type"), F.lit("")) == "sitemap") & (F.coalesce(F.col("link_source"), F.lit("")).isin("xml_loc") | relation.isin("loc", "sitemap")))
    method = rules.first_reason(
        (F.coalesce(F.col("search_page"), F.lit(False)), "query_result"), (sitemap, "sitemap_expansion"), (ext.isin(*FORMAT_EXTENSIONS) | relation.isin(*FORMAT_RELATIONS), "format_targeted"), otherwise="neighborhood")
    has = lambda *names: F.lit(bool(set(names) & set(campaign.modes)))
    wanted = F.lit(True)
    if campaign.format_targets:
        wanted = F.coalesce(F.lower("link_format"), F.lit("")).isin(*campaign.format_targets) | ext.isin(*campaign.format_targets) | F.lower(relation).isin(*campaign.format_targets)
    far = ~F.coalesce(F.col("same_domain"), F.lit(False)) & F.lit(not campaign.allow_cross_domain)
    reason = rules.first_reason(
        (F.col("depth") >= campaign.max_depth, "max_depth"),
        (F.coalesce(F.col("url"), F.lit("")) == "", "no_url"),
        ((method == "sitemap_expansion") & ~has("sitemap"), "mode_off"),
        ((method == "format_targeted") & ~has("format_targeted", "neighborhood"), "mode_off"),
        ((method == "format_targeted") & ~wanted, "format_not_targeted"),
        ((method == "neighborhood") & ~has("neighborhood", "seed_url"), "mode_off"),
        ((method != "query_result") & far, "cross_domain"),
        otherwise="",
    )
    return method, F.nullif(reason, F.lit(""))


def admit(links: DataFrame, frontier: DataFrame, campaign: Campaign, suppressions: DataFrame, as_of: Column) -> DataFrame:
    """(url_hash, canonical_url, domain, method, priority, depth, parent_url, state, reason, links): every link's outcome with the number of links it stands for: a row per canonical URL, one for its further links, and one per method and reason of links that are skipped.

    ``links`` also has ``parent_url`` and the order ``parent_id, position``; the first link of a URL makes its entry. States are
    queued, blocked (an entry, with its reason), known (in ``frontier(url_hash)`` already), repeated and skipped. Copies
    of a link fold into minima before they shuffle, so a URL that very many pages link to meets the frontier once.
    """
    method, reason = route(campaign)
    routed = links.select("*", method.alias("method"), reason.alias("reason"))
    named = routed.withColumn("canonical_url", F.when(F.col("reason").isNull(), urls.canonical_url(F.col("url"), F.col("parent_url"))))
    named = named.withColumn("reason", F.coalesce("reason", F.when(F.col("canonical_url").isNull(), "invalid_url"))).withColumn("url_hash", urls.url_hash(F.col("canonical_url")))
    rank = lambda: F.coalesce(*[F.when(F.col("method") == m, p) for m, p in PRIORITY.items()])
    entry = F.struct("parent_id", "position", "canonical_url", "method", (F.col("depth") + 1).alias("depth"), "parent_url")
    first = named.filter("reason is null").groupBy("url_hash").agg(F.min(entry).alias("e"), F.count("*").alias("n"))
    known = frontier.select("url_hash").distinct().withColumn("known", F.lit(True))
    first = first.join(known, "url_hash", "left").select("url_hash", "n", "known", "e.*")
    # read three times below
    shared_dir(links.sparkSession)
    first = first.checkpoint()
    first = first.withColumn("domain", tx.normalize_domain(F.col("canonical_url"))).withColumn("path", F.regexp_extract("canonical_url", r"://[^/?#]*([^?#]*)", 1))
    stopped = discovery.suppressed(first.filter("known is null").select(F.col("url_hash").alias("candidate_id"), "canonical_url", "domain"), suppressions, as_of).select(F.col("candidate_id").alias("url_hash"), F.lit(True).alias("stopped"))
    judged = first.join(stopped, "url_hash", "left")
    allowed = discovery.admission(judged, allow=list(campaign.allow), deny=list(campaign.deny), denied_paths=list(campaign.denied_paths), allowed_paths=list(campaign.allowed_paths))
    why = F.when(F.col("known"), F.lit("known")).when(F.col("stopped"), F.lit("active_suppression")).otherwise(F.nullif(allowed, F.lit("admitted")))
    state = F.when(F.col("known"), "known").when(why.isNotNull(), "blocked").otherwise("queued")
    out = ["url_hash", "canonical_url", "domain", "method", "priority", "depth", "parent_url", "state", "reason", "links"]
    judged = judged.select("*", why.alias("reason"), state.alias("state"))
    entries = judged.select("url_hash", "canonical_url", "domain", "method", rank().alias("priority"), "depth", "parent_url", "state", "reason", F.when(F.col("known"), F.col("n")).otherwise(F.lit(1).cast("long")).alias("links"))
    repeats = judged.filter("known is null and n > 1").select("url_hash", "canonical_url", "domain", F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("priority"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.lit("repeated").alias("state"), F.lit("repeated").alias("reason"), (F.col("n") - 1).alias("links"))
    skipped = named.filter("reason is not null").groupBy("method", "reason").agg(F.count("*").alias("links")).select(*[F.col(c) if c in ("method", "reason", "links") else F.lit("skipped").alias(c) if c == "state" else F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in out])
    return entries.select(*out).union(repeats.select(*out)).union(skipped)
