"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT of all rows is hot: there are fewer than HOT of them, so their side of a join is broadcast.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one serves a local master; a cluster must name one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="evifuse-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(col: str, n: int):
    """crc32 of the id as text, mod n; null ids give -1."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n, F.lit(-1))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key``: the same rows on every run, with no sort."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * 1_000_000)
    return df.filter(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1_000_000)) < share)


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, and the named expressions beside it: no name that an operator adds can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unboxed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``boxed`` rows, some of them replaced."""
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def join_skewed(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` with ``right(key, n, ...)``, which has one row per key and n, the rows of that key among the ``total`` of ``left``.

    Hot keys meet a broadcast of fewer than ``HOT`` rows where they are; all others go by shuffle, so no task gathers a
    hot key. ``how`` is inner or left.
    """
    hot = F.broadcast(right.filter(F.col("n") * HOT > total))
    few = left.join(hot.drop("n"), key)
    rest = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col("n") * HOT <= total).drop("n"), key, how)
    return few.union(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds. Minima are combined before each shuffle, so a hub costs one row per
    task, and the joins back send the minima of hubs to the edges (``join_skewed``). Each round is checkpointed.
    """
    e = edges.select(F.least("a", "b").alias("y"), F.greatest("a", "b").alias("x")).filter("x <> y").distinct()
    e, before = cut(e), None
    now = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        both = e.select(F.col("x").alias("u"), F.col("y").alias("v")).union(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_skewed(both, low, "u", 2 * now[0]).filter("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        own = large.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n"))
        moved = join_skewed(large, own, "x", now[0]).filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        e = cut(moved.union(own.select("x", F.col("m").alias("y"))).distinct())
        before, now = now, e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("x").alias("node"), F.col("y").alias("component")).union(e.select("y", "y").distinct())
