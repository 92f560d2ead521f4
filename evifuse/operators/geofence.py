"""Geofence scan: grid equi-join, exact ray cast, open-alert anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import geo

#: Grids, and how much coarser each is than the one before.
LEVELS, STEP = 6, 4.0


def _cell(c: Column, size: float | Column) -> Column:
    return F.floor(c / size).cast("int")


def bounds(fences: DataFrame) -> DataFrame:
    """Adds the bounding box of every fence's outer rings."""
    xs = F.flatten(F.transform("polygons", lambda p: F.transform(F.get(p, F.lit(0)), lambda q: q[0])))
    ys = F.flatten(F.transform("polygons", lambda p: F.transform(F.get(p, F.lit(0)), lambda q: q[1])))
    return fences.withColumn("west", F.array_min(xs)).withColumn("east", F.array_max(xs)).withColumn("south", F.array_min(ys)).withColumn("north", F.array_max(ys))


def hits(points: DataFrame, fences: DataFrame, cell: float = 1.0, most_cells: int = 4096) -> DataFrame:
    """(point, fence) rows inside enabled fences ``(geofence_id, enabled, polygons)``.

    Fences cover grid cells and points fall in one, so the join is by equality. Every fence takes the finest grid on which it
    covers at most ``most_cells`` cells, of grids that coarsen by ``STEP``; points look into the grids in use.
    """
    f = bounds(fences.filter("enabled")).filter("west is not null")
    sizes = [cell * STEP**k for k in range(LEVELS)]
    span = lambda c: (_cell(F.col("east"), c) - _cell(F.col("west"), c) + 1).cast("long") * (_cell(F.col("north"), c) - _cell(F.col("south"), c) + 1)
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(span(sizes[k]) <= most_cells, k).otherwise(level)
    f = f.withColumn("__level", level)
    used = sorted(r[0] for r in f.select("__level").distinct().collect())  # LEVELS at most
    size = F.element_at(F.array(*[F.lit(x) for x in sizes]), F.col("__level") + 1)
    tiled = f.withColumn("__cx", F.explode(F.sequence(_cell(F.col("west"), size), _cell(F.col("east"), size)))).withColumn("__cy", F.explode(F.sequence(_cell(F.col("south"), size), _cell(F.col("north"), size))))
    p = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    p = p.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>")))
    near = p.withColumn("__cx", _cell(F.col("lon"), size)).withColumn("__cy", _cell(F.col("lat"), size)).join(tiled, ["__level", "__cx", "__cy"])
    inside = near.filter(geo.in_bbox(F.col("lon"), F.col("lat"), F.col("west"), F.col("south"), F.col("east"), F.col("north")))
    return inside.filter(geo.in_multipolygon(F.col("lon"), F.col("lat"), F.col("polygons"))).drop("__level", "__cx", "__cy", "west", "east", "south", "north")


def alerts(found: DataFrame, open_alerts: DataFrame | None = None) -> DataFrame:
    """New alerts: one per fence and observation without an open alert of the same key."""
    out = found.select(
        F.concat(F.lit("geofence:"), F.col("geofence_id").cast("string"), F.lit(":"), F.col("observation_id").cast("string")).alias("dedupe_key"),
        "geofence_id",
        "observation_id",
        F.when(F.col("trust_level") == "blocked", "warning").otherwise("info").alias("severity"),
    ).dropDuplicates(["dedupe_key"])
    return out if open_alerts is None else out.join(open_alerts.filter("status = 'open'").select("dedupe_key"), "dedupe_key", "left_anti")
