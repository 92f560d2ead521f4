"""Camera inventory derived from observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import rules
from evifuse.functions import text as tx

TRACKED = ("name", "source_domain", "provider", "status", "image_url", "stream_url", "page_url")


def is_candidate(image: Column, stream: Column, camera_id: Column, *searched: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", *searched))
    return image.isNotNull() | stream.isNotNull() | camera_id.isNotNull() | hay.rlike("camera|webcam|cctv")


def camera_key(domain: Column, external_id: Column, name: Column, image: Column, stream: Column, lon: Column, lat: Column) -> Column:
    """Readable prefix and a digest of the identifying fields."""
    place = F.when(lon.isNotNull() & lat.isNotNull(), F.format_string("%.6f,%.6f", lon, lat))
    clean = F.lower(F.trim(name))
    digest = tx.slug_key(domain, external_id, image, stream, clean, place)
    prefix = F.coalesce(tx.blank_to_null(external_id), tx.blank_to_null(F.substring(F.regexp_replace(clean, " ", "-"), 1, 48)), F.lit("camera"))
    prefix = F.coalesce(tx.blank_to_null(F.regexp_replace(F.regexp_replace(prefix, r"[^\p{L}\p{N}_-]", ""), "^[-_]+|[-_]+$", "")), F.lit("camera"))
    return F.concat_ws("-", prefix, digest)


def inventory(observations: DataFrame, order: str = "observation_id") -> DataFrame:
    """Camera candidates of observations with the camera fields; the first of a key wins."""
    c = observations.filter(is_candidate(F.col("image_url"), F.col("stream_url"), F.col("camera_id"), F.col("layer_key"), F.col("name"), F.col("content_text")))
    c = c.withColumn("camera_key", camera_key(F.col("source_domain"), F.col("camera_id"), F.col("name"), F.col("image_url"), F.col("stream_url"), F.col("lon"), F.col("lat")))
    c = c.withColumn("status", F.lower(F.coalesce("status", F.lit("unknown"))))
    c = c.withColumn("active", F.col("status").isin("active", "online", "open", "ok") | (~F.col("status").isin("inactive", "offline", "closed", "disabled") & (F.col("image_url").isNotNull() | F.col("stream_url").isNotNull())))
    rest = [x for x in c.columns if x != "camera_key"]
    return c.groupBy("camera_key").agg(F.min_by(F.struct(*rest), order).alias("__r")).select("camera_key", "__r.*")


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "camera_key", tracked=TRACKED) -> DataFrame:
    """Merge by key: ``action`` is created, updated, unchanged or kept, with the names of changed columns."""
    s = stored.select(key, *[F.col(c).alias(f"__old_{c}") for c in tracked], F.lit(True).alias("__s"))
    f = fresh.select(key, *tracked, F.lit(True).alias("__f"))
    j = s.join(f, key, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__old_{c}")), F.lit(c)) for c in tracked]), lambda x: x.isNotNull())
    both = F.col("__s").isNotNull() & F.col("__f").isNotNull()
    action = F.when(F.col("__s").isNull(), "created").when(F.col("__f").isNull(), "kept").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    values = [F.when(F.col("__f").isNotNull(), F.col(c)).otherwise(F.col(f"__old_{c}")).alias(c) for c in tracked]
    return j.select(key, *values, action.alias("action"), F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def endpoints(cameras: DataFrame, as_of: Column) -> DataFrame:
    """Up to three endpoints for each camera, scored."""
    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_url").alias("url")) for k in ("image", "stream", "page")]), lambda s: s["url"].isNotNull() & (s["url"] != ""))
    e = cameras.withColumn("e", F.explode(kinds)).withColumn("endpoint_kind", F.col("e.kind")).withColumn("endpoint_url", F.col("e.url")).drop("e")
    yes = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    score = (
        F.lit(0.1)
        + rules.lookup(F.col("endpoint_kind"), {"stream": 0.25, "image": 0.2}, 0.1)
        + yes(F.col("active"), 0.15)
        + yes(F.col("status").isin("active", "online", "open", "ok"), 0.15)
        + yes(F.col("camera_id").isNotNull(), 0.1)
        + yes(F.col("source_domain").isNotNull(), 0.1)
        + yes(F.col("last_observed_at") >= as_of - F.expr("INTERVAL 2 DAYS"), 0.1)
        + rules.clamp(F.coalesce("confidence_score", F.lit(0.0))) * 0.1
        - yes((F.col("endpoint_kind") == "page") & (F.col("image_url").isNotNull() | F.col("stream_url").isNotNull()), 0.05)
    )
    e = e.withColumn("graduation_score", F.round(rules.clamp(score), 3))
    status = F.when(F.col("graduation_score") >= 0.85, "graduated").when(F.col("graduation_score") >= 0.7, "ready").when(F.col("graduation_score") >= 0.45, "review").otherwise("candidate")
    return e.withColumn("endpoint_status", status).withColumn("candidate_key", F.concat_ws("-", F.coalesce("camera_id", "camera_key"), "endpoint_kind", tx.slug_key(F.col("source_domain"), F.col("camera_id"), F.col("endpoint_kind"), F.trim("endpoint_url"), F.col("layer_key"))))


def merge_endpoint_status(old: Column, new: Column) -> Column:
    """Reviewed states are sticky."""
    return F.when(old.isin("graduated", "ignored", "retired"), old).otherwise(new)


def stale(last_observed_at: Column, as_of: Column, hours: int) -> Column:
    return last_observed_at.isNull() | (last_observed_at < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def task_scope(tasks: DataFrame, cameras: DataFrame) -> DataFrame:
    """Tasks that cover a camera: equal layer (or none) and domains that contain one another (or none)."""
    t = tasks.select("task_id", F.col("layer_key").alias("__tl"), F.col("source_domain").alias("__td"))
    same = F.coalesce(F.col("__tl") == F.col("layer_key"), F.lit(True)) & rules.same_scope(F.col("__td"), F.col("source_domain"))
    scopes = cameras.select("layer_key", "source_domain").distinct().join(t, same)
    return cameras.select("camera_key", "layer_key", "source_domain").join(scopes, [cameras["layer_key"].eqNullSafe(scopes["layer_key"]), cameras["source_domain"].eqNullSafe(scopes["source_domain"])]).select("camera_key", "task_id")
