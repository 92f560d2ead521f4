"""Entity signals, resolution and pairwise merge decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import rules
from evifuse.functions import text as tx
from evifuse.operators.components import min_labels

# Fixed values.
SIGNALS = {
    "person": ("email", "phone", "handle", "username", "passport_number", "full_name", "person_name"),
    "organization": ("organization", "org_name", "company", "employer"),
    "vessel": ("vessel_name", "ship_name", "imo", "mmsi", "callsign"),
    "vehicle": ("tail_number", "registration"),
}
DISPLAY = ("vessel_name", "ship_name", "full_name", "person_name", "organization", "org_name", "company", "employer", "callsign", "registration", "tail_number", "handle", "username", "email", "phone", "mmsi", "imo", "passport_number")
PRIMARY = ("imo", "mmsi", "passport_number", "email", "phone", "callsign", "tail_number", "registration", "handle", "username", "vessel_name", "ship_name", "full_name", "person_name", "organization", "org_name", "company", "employer")
CONFIDENCE = {
    "imo": 0.9,
    "mmsi": 0.88,
    "passport_number": 0.88,
    "email": 0.84,
    "phone": 0.8,
    "callsign": 0.78,
    "tail_number": 0.78,
    "registration": 0.76,
    "handle": 0.74,
    "username": 0.72,
    "vessel_name": 0.62,
    "ship_name": 0.62,
    "full_name": 0.58,
    "person_name": 0.58,
    "organization": 0.58,
    "org_name": 0.58,
    "company": 0.58,
    "employer": 0.54,
}


def signals(observations: DataFrame, payload: str | None = "content_json", text: str | None = "content_text") -> DataFrame:
    """(observation_id, source_domain, layer_key, entity_type, signal_key, value, raw) from record fields and text."""
    found = []
    if payload:
        v = F.try_parse_json(payload)
        found += [F.array(F.struct(F.lit(t).alias("entity_type"), F.lit(k).alias("signal_key"), F.trim(F.try_variant_get(v, f"$.{k}", "string")).alias("raw"))) for t, keys in SIGNALS.items() for k in keys]
    if text:
        t = F.coalesce(F.col(text), F.lit(""))
        for k, hits in (("email", tx.emails(t)), ("phone", tx.phones(t))):
            found.append(F.transform(hits, _signal(k)))
    rows = observations.select("observation_id", "source_domain", "layer_key", F.explode(F.concat(*found)).alias("s"))
    out = rows.select("observation_id", "source_domain", "layer_key", "s.*").withColumn("value", tx.normalize_signal(F.col("signal_key"), F.col("raw")))
    return out.filter("value is not null").dropDuplicates(["observation_id", "entity_type", "signal_key", "value"])


def _signal(key: str):
    return lambda raw: F.struct(F.lit("person").alias("entity_type"), F.lit(key).alias("signal_key"), F.trim(raw).alias("raw"))


def resolve(found: DataFrame, min_observations: int = 2) -> DataFrame:
    """Entities: components of observations that share a signal of one type."""
    s = found.withColumn("obs", F.struct("entity_type", "observation_id")).withColumn("node", F.concat_ws(":", "entity_type", "signal_key", "value"))
    labels = min_labels(s, "obs", "node")
    rank = lambda names: rules.lookup(F.col("signal_key"), {k: i for i, k in enumerate(names)}, len(names))
    parts = s.join(labels, "obs").groupBy("label").agg(
        F.first("entity_type").alias("entity_type"),
        F.countDistinct("observation_id").alias("observation_count"),
        F.countDistinct("node").alias("signal_count"),
        F.countDistinct("source_domain").alias("domain_count"),
        F.countDistinct("layer_key").alias("layer_count"),
        F.max(rules.lookup(F.col("signal_key"), CONFIDENCE, 0.55)).alias("base"),
        F.min_by("raw", F.struct(rank(DISPLAY), "observation_id", "signal_key", "raw")).alias("canonical_name"),
        F.min_by(F.concat_ws(":", "entity_type", "signal_key", "value"), F.struct(rank(PRIMARY), "value")).alias("primary_signal"),
    )
    return (
        parts.filter(F.col("observation_count") >= min_observations)
        .withColumn("confidence", confidence(F.col("base"), F.col("observation_count"), F.col("domain_count"), F.col("layer_count")))
        .withColumn("slug", F.concat(F.lit("entity-"), F.substring(F.sha1("primary_signal"), 1, 12)))
        .select("slug", "entity_type", "canonical_name", "primary_signal", "observation_count", "signal_count", "domain_count", "layer_count", "confidence")
    )


def confidence(base: Column, observations: Column, domains: Column, layers: Column) -> Column:
    """Base of the best signal plus bounded gains, 0.99 at most."""
    gain = lambda n, step, most: F.least(F.lit(most), step * F.greatest(n - 1, F.lit(0)))
    return F.least(F.lit(0.99), base + gain(observations, 0.05, 0.15) + gain(domains, 0.05, 0.10) + gain(layers, 0.03, 0.06))


def new_links(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.dropDuplicates(keys).join(stored, keys, "left_anti")


def merge_decision(left: Column, right: Column) -> Column:
    """Decision for two candidate structs (entity_type, names, ids, context, domains, cited, reliability). Names alone never merge."""
    shared = F.filter(F.map_keys(left["ids"]), lambda k: F.coalesce(left["ids"][k] == right["ids"][k], F.lit(False)))
    conflict = F.filter(F.map_keys(left["ids"]), lambda k: F.coalesce(left["ids"][k] != right["ids"][k], F.lit(False)))
    context = F.filter(F.map_keys(left["context"]), lambda k: F.coalesce(left["context"][k] == right["context"][k], F.lit(False)))
    domains = F.size(F.array_distinct(F.concat(left["domains"], right["domains"])))
    cited = left["cited"] & right["cited"]
    return rules.first_reason(
        (left["entity_type"] != right["entity_type"], "do_not_merge"),
        (F.size(conflict) > 0, "do_not_merge"),
        ((F.size(shared) > 0) & ~cited, "ambiguous"),
        ((F.size(shared) > 0) & (F.least(left["reliability"], right["reliability"]) < 0.5), "ambiguous"),
        (F.size(shared) > 0, "merge"),
        (~F.arrays_overlap(left["names"], right["names"]), "do_not_merge"),
        ((F.size(context) >= 2) & (domains >= 2) & cited, "merge"),
        otherwise="ambiguous",
    )


def evidence_classes(candidates: DataFrame) -> DataFrame:
    """Each candidate with ``class_id``, the smallest candidate with the same evidence, the order of lists aside."""
    entries = lambda c: F.array_sort(F.map_entries(c))
    same = F.struct("entity_type", *[F.array_sort(F.array_distinct(c)).alias(c) for c in ("names", "domains")], *[entries(c).alias(c) for c in ("ids", "context")], "cited", "reliability")
    keyed = candidates.withColumn("__same", F.sha2(F.to_json(same), 256))
    return keyed.join(keyed.groupBy("__same").agg(F.min("candidate_id").alias("class_id")), "__same").drop("__same")


def merge_pairs(candidates: DataFrame) -> DataFrame:
    """(left_id, right_id, left_count, right_count, decision) for evidence classes that share an identifier or a name.

    A pair of classes decides for all pairs of their members, and ``left_id = right_id`` for the pairs within a class;
    ``evidence_classes`` holds the membership. Copies of a candidate therefore never meet each other, however many share
    a name. The work on one name grows with the square of its different evidence.
    """
    parts = ["entity_type", "names", "ids", "context", "domains", "cited", "reliability"]
    one = F.when(F.col("candidate_id") == F.col("class_id"), F.struct(*parts))
    reps = evidence_classes(candidates).groupBy("class_id").agg(F.first(one, ignorenulls=True).alias("c"), F.countDistinct("candidate_id").alias("n"))
    ids = F.transform(F.map_entries("c.ids"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    keys = F.array_distinct(F.concat(ids, F.transform("c.names", lambda v: F.concat(F.lit("name="), v))))
    side = lambda name: reps.select(F.explode(keys).alias("block"), F.struct("class_id", "n", "c").alias(name))
    met = side("x").join(side("y"), "block").filter((F.col("x.class_id") < F.col("y.class_id")) | ((F.col("x.class_id") == F.col("y.class_id")) & (F.col("x.n") > 1)))
    out = met.select(
        F.col("x.class_id").alias("left_id"), F.col("y.class_id").alias("right_id"), F.col("x.n").alias("left_count"), F.col("y.n").alias("right_count"), merge_decision(F.col("x.c"), F.col("y.c")).alias("decision")
    )
    return out.dropDuplicates(["left_id", "right_id"])
