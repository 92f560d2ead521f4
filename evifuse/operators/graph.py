"""Cited relationship graph: eligible edges, network slice, prominence, regional clusters, timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.functions import rules
from evifuse.operators.components import reach


def eligible(assertions: DataFrame, citations: DataFrame, entities: DataFrame | None = None, *, jurisdiction: str | None = None, since=None, until=None, min_confidence: float = 0.0, reliability: list[str] | None = None, max_redaction: str | None = "public") -> DataFrame:
    """Assertions within confidence, place and validity that have a (reliable) citation and visible endpoints."""
    out = assertions.filter(F.col("confidence_score") >= min_confidence)
    if jurisdiction is not None:
        out = out.filter(F.col("jurisdiction") == jurisdiction)
    if since is not None:
        out = out.filter(F.col("valid_to").isNull() | (F.col("valid_to") >= since))
    if until is not None:
        out = out.filter(F.col("valid_from").isNull() | (F.col("valid_from") <= until))
    cited = citations if reliability is None else citations.filter(F.col("source_reliability").isin(*reliability))
    # a semi join needs no distinct keys, and a table of all of them would fill a task's memory
    out = out.join(cited.select("assertion_id"), "assertion_id", "left_semi")
    if entities is not None and max_redaction is not None:
        shown = entities.filter(rules.visible(F.col("redaction_level"), max_redaction)).select("entity_id")
        for side in ("subject_entity_id", "object_entity_id"):
            out = out.join(shown.withColumnRenamed("entity_id", side), side, "left_semi")
    return out


def network_slice(edges: DataFrame, citations: DataFrame, root, max_depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(entities with depth, relationships with evidence counts) around a root."""
    nodes, touched = reach(edges.select(F.col("assertion_id").alias("edge_id"), F.col("subject_entity_id").alias("a"), F.col("object_entity_id").alias("b")), root, max_depth)
    rows = edges.join(touched.withColumnRenamed("edge_id", "assertion_id"), "assertion_id", "left_semi")
    n = citations.groupBy("assertion_id").agg(F.count("*").alias("evidence_count"))
    return nodes, rows.join(n, "assertion_id", "left").fillna(0, ["evidence_count"])


def incident(edges: DataFrame) -> DataFrame:
    """One row per edge and endpoint."""
    return edges.withColumn("entity_id", F.explode(F.array("subject_entity_id", "object_entity_id")))


def prominence(edges: DataFrame, citations: DataFrame) -> DataFrame:
    """Confidence sum, 0.1 per distinct source, 0.05 per edge."""
    ends = incident(edges)
    base = ends.groupBy("entity_id").agg(F.sum("confidence_score").alias("confidence_sum"), F.count("*").alias("relationship_count"))
    # edges meet their citations in the order that they have, and only then give a row for each end
    cited = edges.select("assertion_id", "subject_entity_id", "object_entity_id").join(citations.filter("source_uri is not null").select("assertion_id", "source_uri"), "assertion_id")
    sources = incident(cited).groupBy("entity_id").agg(F.countDistinct("source_uri").alias("distinct_source_count"))
    out = base.join(sources, "entity_id", "left").fillna(0, ["distinct_source_count"])
    return out.withColumn("score", F.col("confidence_sum") + 0.1 * F.col("distinct_source_count") + 0.05 * F.col("relationship_count"))


def regional_clusters(edges: DataFrame) -> DataFrame:
    return incident(edges).groupBy(F.coalesce("jurisdiction", F.lit("unscoped")).alias("jurisdiction")).agg(F.countDistinct("entity_id").alias("entity_count"))


def timeline(edges: DataFrame) -> DataFrame:
    return edges.withColumn("at", F.coalesce("observed_from", "valid_from")).orderBy(F.asc_nulls_first("at"), "assertion_id")


def check_assertions(rows: DataFrame, types: DataFrame, citations: DataFrame) -> DataFrame:
    """Adds ``reject_reason``, null for valid assertions; ``types(relation_type, subject_types, object_types)``."""
    cited = citations.select("assertion_id").distinct().withColumn("__cited", F.lit(True))
    df = rows.join(types.dropDuplicates(["relation_type"]), "relation_type", "left").join(cited, "assertion_id", "left")
    reason = rules.first_reason(
        (F.col("subject_types").isNull(), "unregistered relation type"),
        (F.col("subject_entity_id") == F.col("object_entity_id"), "endpoints are the same"),
        (~F.array_contains("subject_types", F.col("subject_type")), "subject type not allowed"),
        (~F.array_contains("object_types", F.col("object_type")), "object type not allowed"),
        (F.col("__cited").isNull(), "no citation"),
        otherwise="",
    )
    return df.withColumn("reject_reason", F.nullif(reason, F.lit(""))).drop("subject_types", "object_types", "__cited")
