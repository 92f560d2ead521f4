"""Streaming queries, run over what is there: each equals its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evifuse.plans.facts import INSIDE_SQL, fences
from evifuse.plans.registry import query
from evifuse.plans.views import view
from evifuse.session import shared_dir
from evifuse.streaming import watch


def _stream(spark, d, name: str, root: str):
    view(spark, d, name).write.parquet(f"{root}/in")
    return watch.landing_zone(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)


@query("SELECT source_run_id AS watch_run_id, CASE WHEN b IS NULL THEN 'baseline' WHEN b <> payload_sha256 THEN 'change' ELSE 'no_change' END AS outcome FROM (SELECT *, lag(payload_sha256) OVER (PARTITION BY source_id ORDER BY source_run_id) AS b FROM runs WHERE status = 'completed')", ("runs",))
def stream_watch_outcomes(spark, d):
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    runs = _stream(spark, d, "runs", root).select(F.col("source_id").alias("watch_id"), F.col("source_run_id").alias("watch_run_id"), F.col("payload_sha256").alias("fingerprint"), "status")
    return watch.run_available(watch.watch_outcomes(runs), f"{root}/out", f"{root}/state").select("watch_run_id", "outcome")


@query(f"{INSIDE_SQL} SELECT concat('geofence:', fence, ':', observation_id) AS dedupe_key, fence::BIGINT AS geofence_id, observation_id FROM inside", ("obs",))
def stream_geofence_alerts(spark, d):
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    points = _stream(spark, d, "obs", root).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return watch.run_available(watch.geofence_alerts(points, fences(spark)), f"{root}/out", f"{root}/state").select("dedupe_key", "geofence_id", "observation_id")
