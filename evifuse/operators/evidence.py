"""Claim assessment, materiality and visual change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.functions import rules
from evifuse.functions import text as tx
from evifuse.operators.nearhash import near_duplicate_hashes  # noqa: F401

CONSTRUCTION = "crane excavator construction building foundation steel scaffolding".split()  # fixed values

#: What the limitation list says.
LIMITATIONS = (
    "No supporting evidence was collected.",
    "Conflicting evidence remains visible and requires attribution.",
    "Some support is inferential rather than directly observed.",
    "Only one independent supporting origin was found.",
    "Evidence threshold was not met; no conclusion is emitted.",
)


def recency(age_days: Column) -> Column:
    return F.greatest(F.lit(0.25), 1 - F.least(F.greatest(age_days, F.lit(0.0)), F.lit(730.0)) / 1460.0)


def independence_key(*ids: Column) -> Column:
    return F.coalesce(*[tx.blank_to_null(i) for i in ids])


def assess_claims(evidence: DataFrame, minimum: float = 0.6) -> DataFrame:
    """Per claim: weights of independent support and conflict, confidence, status.

    ``evidence(claim_id, evidence_id, relation, independence_key, source_trust, age_days, fit, completeness)``, and
    ``statement_kind`` where known; ``limitations`` lists what weakens the result, in the order of ``LIMITATIONS``. The best
    trusted record of an independence key counts, the first seen on ties; both steps are plain aggregates.
    """
    weight = F.col("source_trust") * recency(F.col("age_days")) * F.col("fit") * F.col("completeness")
    sides = evidence.filter(F.col("relation").isin("supports", "contradicts"))
    best = sides.groupBy("claim_id", "relation", "independence_key").agg(F.max_by(weight, F.struct("source_trust", -F.col("evidence_id"))).alias("w"))
    per = lambda r: F.col("relation") == r
    side = lambda r: F.when(F.count_if(per(r)) > 0, F.least(F.lit(1.0), F.avg(F.when(per(r), F.col("w"))) + 0.12 * (F.count_if(per(r)) - 1))).otherwise(0.0)
    out = best.groupBy("claim_id").agg(
        side("supports").alias("support_weight"),
        side("contradicts").alias("conflict_weight"),
        F.count_if(per("supports")).alias("support_count"),
        F.count_if(per("contradicts")).alias("conflict_count"),
    )
    inferred = F.count_if((F.col("relation") == "supports") & (F.col("statement_kind") == "inferential")) if "statement_kind" in evidence.columns else F.lit(0).cast("long")
    every = evidence.groupBy("claim_id").agg(inferred.alias("inferential")).join(out, "claim_id", "left").fillna(0)
    confidence = rules.clamp(F.col("support_weight") * (1 - 0.55 * F.col("conflict_weight")))
    status = rules.first_reason(((F.col("support_count") == 0) | (F.round(confidence, 3) < minimum), "insufficient_evidence"), (F.col("conflict_count") > 0, "contested"), otherwise="supported")
    limits = F.array_compact(F.array(*[F.when(test, text) for text, test in zip(LIMITATIONS, (
        F.col("support_count") == 0,
        F.col("conflict_count") > 0,
        F.col("inferential") > 0,
        F.col("support_count") == 1,
        F.col("status") == "insufficient_evidence",
    ))]))
    return every.withColumn("confidence", confidence).withColumn("status", status).withColumn("limitations", limits).drop("inferential")


def materiality(stream: DataFrame, min_score: float = 0.45, min_alert_confidence: float = 0.7, require_citation: bool = True) -> DataFrame:
    """Classify every candidate in order of ``seq`` against what came before.

    The ledger only ever grows and is written whatever the decision, so "seen before" is a first occurrence per key:
    the smallest ``seq`` of each key, joined back. No key needs its rows sorted in one task.
    """
    claim = F.when(F.col("claim_id").isNotNull(), F.concat_ws(":", "claim_id", F.coalesce("claim_version", F.lit("current"))))
    df = stream.withColumn("__e", F.concat_ws(":", "evidence_id", "evidence_version")).withColumn("__c", claim).withColumn("__cs", F.concat_ws("|", "__c", "source_independence_key"))
    for name, key in (("__fe", "__e"), ("__fh", "content_hash"), ("__fc", "__c"), ("__fcs", "__cs"), ("__fs", "source_independence_key")):
        first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias(name))
        df = df.join(first, key, "left")
    seen = lambda n: F.coalesce(F.col(n) < F.col("seq"), F.lit(False))
    duplicate = seen("__fe") | seen("__fh")
    known_source = seen("__fs")
    independent = F.when(F.col("__c").isNull(), ~known_source).otherwise(~seen("__fcs"))
    update = rules.first_reason(
        (duplicate, "no_material_change"),
        (F.col("claim_relation") == "contradicts", "contradiction"),
        (F.col("visual_change"), "visual_change_candidate"),
        (F.col("previous_status").isNotNull() & F.col("status").isNotNull() & (F.col("previous_status") != F.col("status")), "status_change"),
        (F.col("__c").isNotNull() & ~seen("__fc"), "new_fact"),
        (F.col("__c").isNotNull() & independent, "corroboration"),
        (~known_source, "new_source"),
        otherwise="no_material_change",
    )
    change = F.coalesce(F.abs(F.col("confidence") - F.col("previous_confidence")), F.lit(0.0))
    score = (
        0.20 * (~duplicate).cast("double")
        + 0.20 * independent.cast("double")
        + 0.20 * rules.clamp(F.coalesce("claim_impact", F.lit(0.0)))
        + 0.10 * rules.clamp(F.coalesce("temporal_relevance", F.lit(0.0)))
        + 0.10 * rules.clamp(F.coalesce("geographic_relevance", F.lit(0.0)))
        + 0.10 * rules.clamp(change)
        + 0.10 * F.col("event_id").isNotNull().cast("double")
    )
    out = df.withColumn("update_type", update).withColumn("score", F.round(score, 6))
    loud = F.col("confidence") >= min_alert_confidence
    material = (~F.col("update_type").isin("no_material_change", "visual_change_candidate") & (F.col("score") >= min_score)) | ((F.col("update_type") == "contradiction") & loud)
    cited = (F.size("citation_ids") > 0) | F.lit(not require_citation)
    out = out.withColumn("material", material).withColumn("alert", material & cited & loud)
    return out.withColumn("reviewable", (F.col("update_type") != "no_material_change") & (~F.col("alert") | (F.col("update_type") == "visual_change_candidate"))).drop("__e", "__c", "__cs", "__fe", "__fh", "__fc", "__fcs", "__fs")


def materiality_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def cosine01(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]; null for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), rules.clamp((dot(a, b) / norm + 1) / 2))


def hex_hamming(a: Column, b: Column) -> Column:
    """Bits that differ between hex strings of up to 16 digits; null on other text."""
    ok = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    half = lambda h, n: F.conv(F.substring(F.lpad(h, 16, "0"), 8 * n + 1, 8), 16, 10).cast("long")
    return F.when(ok, F.bit_count(half(a, 0).bitwiseXOR(half(b, 0))) + F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[-\s]+", " ")), " "), lambda w: F.length(w) >= 3))


def visual_change(pairs: DataFrame, material: float = 0.70, possible: float = 0.45) -> DataFrame:
    """Triage of observations against baselines: columns ``o_*`` and ``b_*``; a null ``b_artifact_id`` means no baseline."""
    o, b = (lambda n: F.col(f"o_{n}")), (lambda n: F.col(f"b_{n}"))
    duplicate = (o("exact_hash") == b("exact_hash")) | (hex_hamming(o("perceptual_hash"), b("perceptual_hash")) <= 4)
    named, targets = tokens(F.array_join(o("named_locations"), " ")), tokens(F.array_join(o("target_location_names"), " "))
    assoc = F.when(o("site_id").isNotNull(), 1.0).when((F.size(named) > 0) & (F.size(targets) > 0), F.size(F.array_intersect(named, targets)) / F.size(targets)).otherwise(0.0)
    geo = rules.clamp(F.coalesce(o("geospatial_match"), F.lit(0.0)))
    scene = F.coalesce(1 - cosine01(o("scene_embedding"), b("scene_embedding")), F.lit(0.0))
    words = F.array(*[F.lit(w) for w in CONSTRUCTION])
    now, then = F.transform(o("object_labels"), F.lower), F.transform(b("object_labels"), F.lower)
    gained = F.size(F.array_intersect(F.array_except(now, then), words)) / F.greatest(F.lit(1), F.size(F.array_intersect(now, words)))
    semantic = rules.clamp(F.greatest(gained, scene))
    ocr = F.when((o("ocr_text") != "") & (F.array_sort(tokens(o("ocr_text"))) != F.array_sort(tokens(F.coalesce(b("ocr_text"), F.lit(""))))), 1.0).otherwise(0.0)
    score = o("source_credibility") * 0.16 + assoc * 0.24 + geo * 0.08 + scene * 0.28 + semantic * 0.18 + ocr * 0.06
    df = pairs.withColumn("__score", score)
    missing = b("artifact_id").isNull() | o("capture_time").isNull() | (F.trim(F.coalesce(o("source_excerpt"), F.lit(""))) == "")
    label = rules.first_reason(
        (duplicate, "duplicate"),
        ((assoc < 0.35) & (geo < 0.35), "irrelevant"),
        (missing, "insufficient_context"),
        (F.round("__score", 4) >= material, "material_change_candidate"),
        (F.round("__score", 4) >= possible, "possible_change"),
        otherwise="insufficient_context",
    )
    settled = F.coalesce(duplicate, F.lit(False)) | ((assoc < 0.35) & (geo < 0.35)) | missing
    return df.withColumn("classification", label).withColumn("score", F.when(settled, 0.0).otherwise(F.col("__score"))).drop("__score")


def seen_before(df: DataFrame, key: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1
