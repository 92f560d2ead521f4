"""Longest-suffix lookups: trust profiles, domain policies, reliability overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import rules


def suffixes(domain: Column) -> Column:
    """``a.b.c`` gives a.b.c, b.c, c."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def longest_suffix(facts: DataFrame, profiles: DataFrame, domain: str = "source_domain", profile_domain: str = "domain", exact_only: Column | None = None) -> DataFrame:
    """Facts with the columns of the most specific profile of their domain, null where none fits.

    Distinct domains explode into suffixes and meet the profiles by equality; facts then join by domain, so the work per
    domain happens once, whatever its share of the rows.
    """
    names = facts.select(domain).distinct().filter(F.col(domain).isNotNull())
    tried = names.select(domain, F.explode(suffixes(F.col(domain))).alias("__s"))
    hit = tried.join(profiles, tried["__s"] == profiles[profile_domain])
    if exact_only is not None:
        hit = hit.filter((F.col("__s") == F.col(domain)) | ~exact_only)
    rest = profiles.columns
    best = hit.groupBy(domain).agg(F.max_by(F.struct(*[profiles[c].alias(f"matched_{c}") for c in rest]), F.length("__s")).alias("__p")).select(domain, "__p.*")
    return facts.join(best, domain, "left")


def annotate_trust(facts: DataFrame, profiles: DataFrame, domain: str = "source_domain") -> DataFrame:
    """Trust level, approval policy and confidence; a miss is neutral and reviewed by hand."""
    out = longest_suffix(facts.drop("trust_level", "confidence_score"), profiles, domain)
    level = F.coalesce("matched_trust_level", F.lit("neutral"))
    return (
        out.withColumn("trust_level", level)
        .withColumn("approval_policy", F.coalesce("matched_approval_policy", F.lit("manual_review")))
        .withColumn("confidence_score", rules.trust_score(level))
        .withColumn("trust_domain", F.col("matched_domain"))
        .drop(*[f"matched_{c}" for c in profiles.columns])
    )


def reliability(facts: DataFrame, overrides: DataFrame, base: Column, domain: str = "source_domain") -> DataFrame:
    out = longest_suffix(facts, overrides, domain)
    return out.withColumn("reliability", rules.clamp(F.coalesce("matched_score", base))).drop("matched_domain", "matched_score")


def missing_profiles(seed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Seed rows whose domain has no profile yet."""
    return seed.join(profiles.select("domain"), "domain", "left_anti")


def missing_layers(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Layers seen in facts and absent from the catalog, with a derived name."""
    seen = facts.select("layer_key").distinct().join(catalog.select("layer_key"), "layer_key", "left_anti")
    return seen.withColumn("name", F.initcap(F.regexp_replace("layer_key", "[-_]+", " ")))
