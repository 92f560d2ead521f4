"""Watches: rules, run fingerprints, outcomes, feed, report."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.functions import rules
from evifuse.functions import text as tx
from evifuse.operators.observations import rule_predicate
from evifuse.operators.windows import change_outcomes, latest

IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif")  # fixed values


def compile_instruction(instruction: str) -> dict:
    """Quoted phrases, subject and place of an instruction as a canonical rule with its hash."""
    phrases = re.findall(r'"([^"]+)"', instruction)
    place = re.search(r"\b(?:in|near|at)\s+([A-Z][\w.-]*(?:\s+[A-Z][\w.-]*)*)", instruction)
    rule = {"phrases": sorted(p.lower() for p in phrases), "location": place[1] if place else None}
    body = json.dumps(rule, sort_keys=True, separators=(",", ":"))
    gaps = [n for n, missing in (("no quoted phrase", not phrases), ("no location", not place)) if missing]
    return {"rule": rule, "rule_hash": hashlib.sha256(body.encode()).hexdigest(), "ambiguities": gaps}


def fingerprint(ids: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(ids), ","), 256)


def evaluate_rule(facts: DataFrame, rule: dict, group: str, id_column: str = "observation_id", most: int | None = None) -> DataFrame:
    """Matches of a rule in each run and their fingerprint."""
    hits = facts.filter(rule_predicate(rule)).groupBy(group).agg(F.collect_list(F.col(id_column).cast("string")).alias("ids"), F.count("*").alias("matches"))
    return hits.select(group, "matches", fingerprint(F.col("ids")).alias("fingerprint"))


def text_matches(text: Column, terms: list[str]) -> Column:
    """Any term is part of the text; no terms match all."""
    low = F.lower(text)
    return rules.first_reason(*[(F.contains(low, F.lit(t.lower())), "y") for t in terms], otherwise="n") == "y" if terms else F.lit(True)


def observation_watches(watches: DataFrame, observations: DataFrame, text: Column, deepest: int) -> DataFrame:
    """Watches on stored observations: (watch_id, ids, matches, confidence, fingerprint), watches without a match included.

    ``watches(watch_id, layer_key, source_domain, read_limit, min_confidence, terms, max_results)``: of the newest
    ``read_limit`` observations of its layer and domain (null: any), a watch keeps the newest ``max_results`` that are
    trusted enough and whose text holds a term; no terms match all. ``deepest`` is the largest ``read_limit``; up to
    1,000, Spark keeps that many rows of a scope a task before it shuffles. Every observation is ranked in its four scopes,
    and all watches meet the ranks by equality at once.
    """
    scopes = F.array_distinct(F.array(*[F.struct(layer.alias("layer"), domain.alias("domain")) for layer in (F.col("layer_key"), F.lit(None).cast("string")) for domain in (F.col("source_domain"), F.lit(None).cast("string"))]))
    keyed = observations.select("observation_id", "confidence_score", F.lower(text).alias("text"), F.explode(scopes).alias("s")).select("*", "s.*").drop("s")
    newest = Window.partitionBy("layer", "domain").orderBy(F.desc("observation_id"))
    ranked = keyed.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= deepest)
    wanted = F.coalesce(F.size("terms") == 0, F.lit(True)) | F.exists("terms", lambda t: F.contains(F.col("text"), F.lower(t)))
    met = watches.join(ranked, F.col("layer_key").eqNullSafe(F.col("layer")) & F.col("source_domain").eqNullSafe(F.col("domain"))).filter((F.col("rank") <= F.col("read_limit")) & (F.col("confidence_score") >= F.col("min_confidence")) & wanted)
    kept = met.withColumn("place", F.row_number().over(Window.partitionBy("watch_id").orderBy(F.desc("observation_id")))).filter(F.col("place") <= F.col("max_results"))
    found = kept.groupBy("watch_id").agg(F.reverse(F.array_sort(F.collect_list("observation_id"))).alias("ids"), F.min("confidence_score").alias("confidence"))
    ids = F.coalesce("ids", F.array().cast("array<long>"))
    out = watches.select("watch_id").join(found, "watch_id", "left")
    return out.select("watch_id", ids.alias("ids"), F.size(ids).cast("long").alias("matches"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("fingerprint"))


def source_watches(watches: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Watches on a source: (watch_id, source_run_id, fingerprint, error).

    ``source_delta`` and ``investigation_watch`` follow the payload of the latest run, ``source_health`` the state of the
    source. Watches that cannot be judged carry an error and no fingerprint.
    """
    last = latest(runs, ["source_id"], "source_run_id").select("source_id", "source_run_id", "status", "payload_sha256")
    df = watches.join(sources.select("source_id", "enabled"), "source_id", "left").join(last, "source_id", "left")
    kind, live = F.col("watch_type"), F.coalesce("enabled", F.lit(False))
    payload = F.coalesce("payload_sha256", F.col("source_run_id").cast("string"))
    error = rules.first_reason(
        (F.col("source_id").isNull(), "no source"),
        ((kind == "investigation_watch") & ~live, "source is missing or disabled"),
        ((kind != "source_health") & F.col("source_run_id").isNull(), "source has no run"),
        otherwise="",
    )
    state = F.when(~live, "disabled").when(F.col("source_run_id").isNull(), "never_run").otherwise(F.col("status"))
    df = df.withColumn("error", F.nullif(error, F.lit("")))
    return df.select("watch_id", "source_run_id", F.when(F.col("error").isNull(), F.when(kind == "source_health", state).otherwise(payload)).alias("fingerprint"), "error")


def image_watches(images: DataFrame, accepted: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """Watches on collected images ``(watch_id, media_type, content)``: the hash of the bytes, or an error for other media."""
    media = F.lower(F.trim(F.substring_index("media_type", ";", 1)))
    known = F.coalesce(media.isin(*accepted), F.lit(False))
    return images.select("watch_id", F.when(known, F.sha2("content", 256)).alias("fingerprint"), F.when(~known, "unsupported media type").alias("error"))


def outcomes(runs: DataFrame) -> DataFrame:
    return change_outcomes(runs, "watch_id", "watch_run_id", "fingerprint", F.col("status") == "completed")


def publishable(runs: DataFrame) -> Column:
    return (F.col("status") == "completed") & (F.col("outcome") == "change") & F.col("material") & (F.size("citation_ids") > 0)


def feed(runs: DataFrame, watches: DataFrame, cursor: int | None = None, page: int = 50, ceiling: str | None = "public") -> DataFrame:
    """A page of publishable runs, newest first, before a cursor."""
    out = runs.filter(publishable(runs)).join(watches, "watch_id").filter(rules.visible(F.col("redaction_level"), ceiling))
    if cursor is not None:
        out = out.filter(F.col("watch_run_id") < cursor)
    return out.orderBy(F.desc("watch_run_id")).limit(page).withColumn("cursor", tx.cursor_encode(F.col("watch_run_id")))


def feed_xml(items: DataFrame) -> DataFrame:
    """One RSS item per row."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return items.select(F.concat(F.lit("<item><title>"), esc(F.col("title")), F.lit("</title><guid>"), F.col("cursor"), F.lit("</guid></item>")).alias("value"))


def report(runs: DataFrame) -> DataFrame:
    """Run counts per watch and a digest of them."""
    out = runs.groupBy("watch_id").agg(F.count("*").alias("total"), F.count_if("material").alias("material"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("digest", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("watch_id", "total", "material", "failed")]), 256))
