"""Fact tables that replace by version: numbered batches, compacted into a base without repeated keys.

A batch counts once the job that wrote it has committed (Spark's ``_SUCCESS``); writing it again changes nothing. Compaction
``n`` folds the base before it and all batches up to ``n`` into a new base in monthly partitions, sorted by key. It counts
once committed, so that folder is the manifest: it says that batches up to ``n`` are in it. Reads rank the versions of later
batches only, and of the base drop what those replace; with none they are a pruned scan. Numbers must rise: a batch at or
below the base is a replay. The higher version wins, the later batch on ties; rows of one batch that tie fall by content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.operators.candidates import committed

OBSERVATIONS = ["layer_key", "observed_at", "observation_id"]
STORAGE = ["owner_type", "owner_id", "storage_object_id"]


def append(spark: SparkSession, root: str, batch: int, rows: DataFrame, key: list[str]) -> bool:
    """Writes a batch of rows with ``observed_at`` and ``updated_at``; false if it is there already."""
    if batch in committed(spark, f"{root}/new") or batch <= _base(spark, root):
        return False
    rows.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(f"{root}/new/batch={batch}")
    return True


def _base(spark: SparkSession, root: str) -> int:
    return max(committed(spark, f"{root}/base"), default=-1)


def _later(spark: SparkSession, root: str, key: list[str], upto: int | None = None) -> DataFrame | None:
    """The winning version of each key among the batches after the base."""
    base = _base(spark, root)
    numbers = [b for b in committed(spark, f"{root}/new") if b > base and (upto is None or b <= upto)]
    if not numbers:
        return None
    parts = [spark.read.parquet(f"{root}/new/batch={b}").withColumn("__batch", F.lit(b)) for b in numbers]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    names = [c for c in every.columns if c != "__batch"]
    won = every.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct("updated_at", "__batch", F.xxhash64(*names))).alias("__row"))
    return won.select("__row.*")


def current(spark: SparkSession, root: str, key: list[str], start: str | None = None, end: str | None = None, upto: int | None = None) -> DataFrame:
    """The winning version of each key, observed from ``start`` on and before ``end`` where given; months outside are not read from the base."""
    number, later = _base(spark, root), _later(spark, root, key, upto)
    month = lambda t: F.date_format(F.lit(t).cast("timestamp"), "yyyyMM").cast("int")
    out = None
    if number >= 0:
        out = spark.read.option("mergeSchema", "false").parquet(f"{root}/base/batch={number}")
        if start is not None:
            out = out.filter(F.col("yyyymm") >= month(start))
        if end is not None:
            out = out.filter(F.col("yyyymm") <= month(end))
        out = out.drop("yyyymm")
    if later is not None and out is not None:
        keyed = lambda df: df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("updated_at").alias("__u"))
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
        kept = out.join(keyed(later), [*same, F.col("updated_at") <= F.col("__u")], "left_anti")
        # a later batch may bring a version older than the base's, whose month may lie outside
        whole = keyed(spark.read.parquet(f"{root}/base/batch={number}"))
        out = kept.unionByName(later.join(whole, [*same, F.col("__u") > F.col("updated_at")], "left_anti"))
    elif later is not None:
        out = later
    elif out is None:
        raise ValueError(f"no batches under {root}")
    if start is not None:
        out = out.filter(F.col("observed_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("observed_at") < F.lit(end).cast("timestamp"))
    return out


def compact(spark: SparkSession, root: str, key: list[str]) -> int:
    """Folds all batches so far into a new base and returns its number; without new ones, that of the present base."""
    number = max(committed(spark, f"{root}/new"), default=-1)
    base = _base(spark, root)
    if number <= base:
        return base
    rows = current(spark, root, key, upto=number).withColumn("yyyymm", F.date_format("observed_at", "yyyyMM").cast("int"))
    rows.repartitionByRange("yyyymm", *key).sortWithinPartitions("yyyymm", *key).write.mode("overwrite").partitionBy("yyyymm").parquet(f"{root}/base/batch={number}")
    return number


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Removes batches that the base holds and bases before it, once no reader is left on them; returns the folders."""
    base, gone = _base(spark, root), []
    for name in ("new", "base"):
        for b in committed(spark, f"{root}/{name}"):
            if b < base or (b == base and name == "new"):
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/batch={b}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                gone.append(f"{name}/batch={b}")
    return gone
