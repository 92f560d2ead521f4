"""Corpus pipeline: each stage reads what the one before wrote and keeps the columns of ``documents`` until the last.

Defined results: rows with a null or letterless text go in the first stage; rows that repeat an id go in the second, but
for one; rows without an id stay until they are packed; columns of any name stay as they are; texts of any length are
read whole; ties keep the smallest id; with an empty ``documents`` the result is empty, and with an empty ``benchmark``
nothing is contaminated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evifuse.llm import decontaminate, langid, packing, pii, simhash
from evifuse.llm.common import remove, shared_dir

STAGES = [
    ("language_id", langid.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: Language models, component search, a tokenizer: not SQL. tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared folder and read again. What a stage has read is removed once its own result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    root = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
