"""Cross-verification clustering and event fusion.

Clusters form in time order, first fit, with a moving centroid, so a session must be folded in sequence. Sessions are cut
where more than the window passes without a located observation: there every open cluster is closed, so sessions are
independent. They are found by islands of occupied time buckets, without a global sort of the observations.

Sessions with more than ``LARGE`` observations split by place as well. A member lies within the distance of the centroid
it joins, and moves the centroid towards itself; so consecutive members of a cluster are within twice the distance and
within the window of each other, and clusters never leave a connected group of neighbouring space-time cells of that
size. Only cells meet in the component search. Means of longitudes lose that property around the antimeridian and the
poles: sessions with a group that reaches there stay whole.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evifuse.operators.components import cut, min_labels

EARTH_KM = 6371.0
#: Time buckets that one task scans for session starts.
BLOCK = 4096
#: Observations of a session above which it is split by place.
LARGE = 200_000
#: Latitude and longitude beyond which a group of cells keeps its session whole.
POLAR, MERIDIAN = 80.0, 170.0


def sessions(located: DataFrame, window_us: int, time: str = "t_us") -> DataFrame:
    """Adds ``session``: an empty bucket between two occupied ones means a gap above the window."""
    b = F.floor(F.col(time) / window_us)
    buckets = located.select(b.alias("__b")).distinct()
    before = buckets.select((F.col("__b") + 1).alias("__b"), F.lit(True).alias("__joined"))
    starts = buckets.join(before, "__b", "left").withColumn("__start", F.when(F.col("__joined").isNull(), F.col("__b")))
    # the latest start so far: within blocks of buckets in parallel, then carried over one row per block
    blocks = starts.withColumn("__block", F.floor(F.col("__b") / BLOCK)).withColumn("__own", F.max("__start").over(Window.partitionBy("__block").orderBy("__b")))
    ends = blocks.groupBy("__block").agg(F.max("__start").alias("__last"))
    carried = ends.select("__block", F.max("__last").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    marked = blocks.join(carried, "__block").select("__b", F.coalesce("__own", "__carried").alias("session"))
    return located.withColumn("__b", b).join(marked, "__b").drop("__b")


def places(located: DataFrame, window_us: int, km: float) -> DataFrame:
    """Adds ``place`` to rows with a session: the connected group of space-time cells, or null where the session stays whole."""
    lon, lat, size = F.radians("lon"), F.radians("lat"), 2.2 * max(km, 0.001)
    axes = {"__x": F.cos(lat) * F.cos(lon), "__y": F.cos(lat) * F.sin(lon), "__z": F.sin(lat)}
    keyed = located.withColumns({k: F.floor(v * EARTH_KM / size) for k, v in axes.items()} | {"__t": F.floor(F.col("t_us") / window_us)})
    at = ["session", "__t", "__x", "__y", "__z"]
    edge = F.max((F.abs("lat") > POLAR) | (F.abs("lon") > MERIDIAN)).alias("edge")
    cells = cut(keyed.groupBy(*at).agg(edge).withColumn("cell", F.struct(*at)))
    # half of the neighbours: every pair of neighbouring cells is met once
    steps = [(t, x, y, z) for t in (-1, 0, 1) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (t, x, y, z) > (0, 0, 0, 0)]
    around = F.array(*[F.struct("session", *[(F.col(c) + d).alias(c) for c, d in zip(at[1:], step)]) for step in steps])
    met = cells.select("cell", F.explode(around).alias("other")).join(cells.select(F.col("cell").alias("other")), "other")
    pairs = met.withColumn("pair", F.struct("cell", "other"))
    sides = pairs.select("cell", "pair").union(pairs.select(F.col("other").alias("cell"), "pair"))
    own = cells.select("cell", F.struct("cell", F.col("cell").alias("other")).alias("pair"))
    named = cells.join(min_labels(sides.union(own), "cell", "pair"), "cell")
    whole = named.filter("edge").select("session").distinct()
    split = named.join(whole, "session", "left_anti").select(*at, F.col("label").alias("place"))
    return keyed.join(split, at, "left").drop(*at[1:])


def _km(lon1, lat1, lon2, lat2):
    lon1, lat1, lon2, lat2 = map(math.radians, (lon1, lat1, lon2, lat2))
    t = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return EARTH_KM * 2 * math.atan2(math.sqrt(t), math.sqrt(1 - t))


def _unit(lon: float, lat: float) -> tuple[float, float, float]:
    lon, lat = math.radians(lon), math.radians(lat)
    flat = math.cos(lat)
    return flat * math.cos(lon), flat * math.sin(lon), math.sin(lat)


class FirstFit:
    """First-fit clusters of observations that arrive in order of time and id. Only open clusters are held: those whose
    last member is older than the window can never match again.

    Most clusters are too far away, which the chord between unit vectors, or its height alone, shows for a fraction of what
    a distance costs. Within a margin that exceeds their rounding, the distance decides.
    """

    def __init__(self, window_us: int, km: float):
        self.window_us, self.km, self.open = window_us, km, []
        #: No open cluster ends before this time plus the window.
        self.oldest = -math.inf
        self.far = (2 * math.sin(min(km / (2 * EARTH_KM), math.pi / 2))) ** 2 * (1 + 1e-9) + 1e-12
        self.high = math.sqrt(self.far)

    def place(self, t: int, i: int, lon: float, lat: float) -> int:
        """The id of the first member of the observation's cluster."""
        if t - self.oldest > self.window_us:
            self.open = [c for c in self.open if t - c[1] <= self.window_us]
            self.oldest = min((c[1] for c in self.open), default=t)
        x, y, z = _unit(lon, lat)
        high, far = self.high, self.far
        for c in self.open:
            w = c[9] - z
            if -high <= w <= high:
                u, v = c[7] - x, c[8] - y
                if u * u + v * v + w * w <= far and _km(c[5], c[6], lon, lat) <= self.km:
                    c[1], c[2], c[3], c[4] = t, c[2] + lon, c[3] + lat, c[4] + 1
                    c[5], c[6] = c[2] / c[4], c[3] / c[4]
                    c[7], c[8], c[9] = _unit(c[5], c[6])
                    return c[0]
        self.open.append([i, t, lon, lat, 1, lon, lat, x, y, z])
        return i


def fold(rows, window_us: int, km: float):
    """Seeds of (time, id, lon, lat) rows in order."""
    clusters = FirstFit(window_us, km)
    return [clusters.place(*row) for row in rows]


def _fold_sorted(window_us: int, km: float):
    def run_task(batches):
        key, clusters = None, None
        for pdf in batches:
            seeds = []
            for session, place, t, i, lon, lat in zip(*(pdf[c].tolist() for c in ("session", "place", "t_us", "observation_id", "lon", "lat"))):
                if (session, place) != key:
                    key, clusters = (session, place), FirstFit(window_us, km)
                seeds.append(clusters.place(t, i, lon, lat))
            yield pd.DataFrame({"observation_id": pdf["observation_id"], "cluster_seed": pd.Series(seeds, dtype="int64")})

    return run_task


def assign_clusters(observations: DataFrame, window_minutes: int = 60, distance_km: float = 25.0) -> DataFrame:
    """(observation_id, cluster_seed): the seed is the cluster's first member.

    Spark sorts the observations of each session and place (and spills); the fold reads them batch by batch and holds the
    open clusters only, so its memory does not grow with a session.
    """
    window_us = window_minutes * 60_000_000
    located = observations.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("observation_id", "t_us", "lon", "lat")
    timed = sessions(located, window_us)
    large = timed.groupBy("session").count().filter(F.col("count") > LARGE).select("session")
    # a null place would not equal itself
    keyed = timed.withColumn("place", F.lit(""))
    if large.limit(1).count():
        large = cut(large)
        split = places(timed.join(large, "session", "left_semi"), window_us, distance_km).withColumn("place", F.coalesce(F.to_json("place"), F.lit("")))
        keyed = keyed.join(large, "session", "left_anti").unionByName(split)
    ordered = keyed.repartition("session", "place").sortWithinPartitions("session", "place", "t_us", "observation_id")
    return ordered.mapInPandas(_fold_sorted(window_us, distance_km), "observation_id long, cluster_seed long")


def summarize(members: DataFrame, cluster: str, min_signals: int = 2) -> DataFrame:
    """Cluster aggregate and verification score of observations that carry a cluster column."""
    agg = members.groupBy(cluster).agg(
        F.count("*").alias("observation_count"),
        F.countDistinct("source_domain").alias("source_domain_count"),
        F.countDistinct("layer_key").alias("layer_count"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.count_if(F.col("trust_level") == "trusted").alias("trusted_observation_count"),
        F.count_if(F.col("ground_truth")).alias("ground_truth_count"),
        F.min("t_us").alias("started_us"),
        F.max("t_us").alias("ended_us"),
        F.avg("lon").alias("centroid_lon"),
        F.avg("lat").alias("centroid_lat"),
    )
    score = F.least(F.lit(0.99), F.col("avg_confidence") + 0.15 * F.greatest(F.col("source_domain_count") - 1, F.lit(0)) + 0.10 * F.greatest(F.col("layer_count") - 1, F.lit(0)))
    signals = F.greatest("source_domain_count", "layer_count")
    return agg.withColumn("independent_signal_count", signals).filter(signals >= min_signals).withColumn("verification_score", score).withColumn("time_span_minutes", (F.col("ended_us") - F.col("started_us")) / 60_000_000)


def cross_verify(observations: DataFrame, window_minutes: int = 60, distance_km: float = 25.0, min_signals: int = 2) -> DataFrame:
    seeds = assign_clusters(observations, window_minutes, distance_km)
    return summarize(observations.join(seeds, "observation_id"), "cluster_seed", min_signals)


def integrity_counts(members: DataFrame, cluster: str, profiles: DataFrame) -> DataFrame:
    """Distinct integrity domains of each cluster."""
    trusted = profiles.filter("integrity_source").select(F.col("domain").alias("source_domain"))
    return members.select(cluster, "source_domain").distinct().join(trusted, "source_domain", "left_semi").groupBy(cluster).agg(F.count("*").alias("integrity_source_count"))


def fuse_events(observations: DataFrame, stored_events: DataFrame | None = None, stored_links: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, new links and products of the clusters; rerunning over stored ones adds nothing."""
    seeds = assign_clusters(observations, options.get("window_minutes", 60), options.get("distance_km", 25.0))
    members = observations.join(seeds, "observation_id")
    found = summarize(members, "cluster_seed", options.get("min_signals", 2))
    basis = F.concat_ws("|", F.col("cluster_seed").cast("string"), F.col("started_us").cast("string"), F.col("observation_count").cast("string"))
    events = found.withColumn("slug", F.concat(F.lit("event-"), F.substring(F.sha1(basis), 1, 12)))
    links = members.join(events.select("cluster_seed", "slug"), "cluster_seed").select("slug", "observation_id")
    if stored_links is not None:
        links = links.join(stored_links, ["slug", "observation_id"], "left_anti")
    if stored_events is not None:
        events = events.join(stored_events.select("slug"), "slug", "left_anti")
    return events, links, products(events)


def products(events: DataFrame) -> DataFrame:
    """A cited summary and a report for each event."""
    summary = F.format_string("%d observations from %d domains in %d layers", "observation_count", "source_domain_count", "layer_count")
    report = F.concat_ws("\n", summary, F.format_string("Verification score %.4f over %.3f minutes", "verification_score", "time_span_minutes"))
    both = F.array(F.struct(F.lit("cited_summary").alias("product_type"), summary.alias("body")), F.struct(F.lit("report").alias("product_type"), report.alias("body")))
    return events.select("slug", F.explode(both).alias("p")).select("slug", "p.product_type", "p.body")
