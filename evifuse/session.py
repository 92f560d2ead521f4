"""Session defaults and table loading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "evifuse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; keyword names use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    base.update({k.replace("__", "."): v for k, v in conf.items()})
    return b.config(map=base).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, also set for checkpoints. Where it is unset, a temporary one serves a local master; a cluster must name one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="evifuse-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder
