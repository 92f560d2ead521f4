"""Connected components and bounded graph search as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def min_labels(memberships: DataFrame, item: str, group: str, max_rounds: int = 100) -> DataFrame:
    """(item, label): the smallest item of the component in the bipartite graph item-group.

    Each round passes minima through the groups and jumps to the label of the label, which halves chains.
    """
    pairs = cut(memberships.select(F.col(item).alias("i"), F.col(group).alias("g")).distinct())
    labels, before = cut(pairs.select("i", F.col("i").alias("l")).distinct()), None
    for _ in range(max_rounds):
        of_group = pairs.join(labels, "i").groupBy("g").agg(F.min("l").alias("m"))
        passed = pairs.join(of_group, "g").groupBy("i").agg(F.min("m").alias("l"))
        jump = passed.select(F.col("i").alias("l"), F.col("l").alias("up"))
        labels = cut(passed.join(jump, "l", "left").select("i", F.coalesce("up", "l").alias("l")))
        now = labels.agg(F.sum(F.xxhash64("i", "l").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels.select(F.col("i").alias(item), F.col("l").alias("label"))
        before = now
    raise RuntimeError("labels did not settle")


def reach(edges: DataFrame, root, max_depth: int = 2, deepest: int = 6) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges touched) around ``root`` over undirected ``edges(edge_id, a, b)``.

    An edge counts if it touches a node at less than the maximum depth, also between two nodes of one level.
    """
    steps = max(0, min(max_depth, deepest))
    both = edges.select("edge_id", F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("edge_id", F.col("b").alias("u"), F.col("a").alias("v")))
    spark = edges.sparkSession
    visited = spark.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth"))
    frontier, touched = visited, None
    for depth in range(1, steps + 1):
        hop = both.join(frontier.select(F.col("node").alias("u")), "u")
        now = hop.select("edge_id").distinct()
        touched = now if touched is None else touched.union(now).distinct()
        frontier = cut(hop.select(F.col("v").alias("node")).distinct().join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        visited = cut(visited.union(frontier))
    return visited, touched if touched is not None else edges.select("edge_id").limit(0)
