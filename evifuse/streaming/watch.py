"""Streaming forms: file ingestion, geofence alerts, watch outcomes with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evifuse.operators import geofence


def landing_zone(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def geofence_alerts(points: DataFrame, fences: DataFrame, time: str = "observed_at", late: str = "1 day") -> DataFrame:
    """Alerts of a stream of points, one per fence and observation within the watermark."""
    found = geofence.hits(points, fences)
    out = found.select(F.concat_ws(":", F.lit("geofence"), F.col("geofence_id").cast("string"), F.col("observation_id").cast("string")).alias("dedupe_key"), "geofence_id", "observation_id", F.col(time).alias("at"))
    return out.withWatermark("at", late).dropDuplicatesWithinWatermark(["dedupe_key"])


def _outcomes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("watch_run_id")
    out = []
    for run, fingerprint in zip(rows["watch_run_id"], rows["fingerprint"]):
        out.append((key[0], run, "baseline" if before is None else "change" if fingerprint != before else "no_change"))
        before = fingerprint
    state.update((before,))
    yield pd.DataFrame(out, columns=["watch_id", "watch_run_id", "outcome"])


def watch_outcomes(runs: DataFrame) -> DataFrame:
    """Outcome of each completed run against the last fingerprint of its watch, kept as state."""
    return runs.filter("status = 'completed'").groupBy("watch_id").applyInPandasWithState(_outcomes, "watch_id long, watch_run_id long, outcome string", "fingerprint string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per layer and window; late rows count until the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "layer_key").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "layer_key", "n")


def run_available(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Process what is there, then stop; returns the written table."""
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(target)
