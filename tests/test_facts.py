"""Compacted fact tables against a plain replay of the batches."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from evifuse.sources import facts

KEY = facts.STORAGE
SCHEMA = "owner_type string, owner_id long, storage_object_id long, updated_at long, observed_at timestamp, size long"


def batch(r: random.Random, k: int):
    """Keys repeat across batches, with nulls, equal versions and versions older than those before."""
    rows = {}
    for i in range(40):
        at = (r.choice(["a", None]), r.randint(1, 4), r.randint(1, 5))
        rows[at, r.randint(0, 6)] = (f"2024-0{r.randint(1, 4)}-15 00:00:00", 1000 * k + i)
    return [(*at, v, t, n) for (at, v), (t, n) in rows.items()]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("observed_at", F.to_timestamp("observed_at"))


def replay(batches, start="", end="9"):
    best = {}
    for rows in batches:
        for *at, v, t, n in sorted(rows, key=lambda x: x[3]):
            if tuple(at) not in best or v >= best[tuple(at)][0]:
                best[tuple(at)] = (v, t, n)
    return {at: x for at, x in best.items() if start <= x[1] < end}


def read(df):
    out = df.collect()
    assert len(out) == len({tuple(r[k] for k in KEY) for r in out})
    return {tuple(r[k] for k in KEY): (r.updated_at, f"{r.observed_at:%Y-%m-%d %H:%M:%S}", r["size"]) for r in out}


@pytest.mark.parametrize("compacted", [{1}, {0, 2}, {3}])
def test_equals_a_replay(spark, tmp_path, compacted):
    r, root, batches = random.Random(3), str(tmp_path), []
    for k in range(4):
        batches.append(batch(r, k))
        assert facts.append(spark, root, k, frame(spark, batches[-1]), KEY)
        if k in compacted:
            assert facts.compact(spark, root, KEY) == k
    assert read(facts.current(spark, root, KEY)) == replay(batches)
    month = facts.current(spark, root, KEY, "2024-02-01", "2024-03-20")
    assert read(month) == replay(batches, "2024-02-01", "2024-03-20")
    assert not facts.append(spark, root, 1, frame(spark, batches[0]), KEY)


def test_commits_replays_and_files(spark, tmp_path):
    r, root, batches = random.Random(4), str(tmp_path), []
    with pytest.raises(ValueError):
        facts.current(spark, root, KEY)
    for k in range(3):
        batches.append(batch(r, k))
        facts.append(spark, root, k, frame(spark, batches[-1]), KEY)
    want = replay(batches)
    # a compaction and a batch that died leave folders without a commit mark
    for name in ("base/batch=2", "new/batch=3"):
        os.makedirs(f"{root}/{name}")
        open(f"{root}/{name}/part-0.parquet", "w").write("torn")
    assert read(facts.current(spark, root, KEY)) == want
    assert facts.compact(spark, root, KEY) == 2 and facts.compact(spark, root, KEY) == 2
    assert set(facts.vacuum(spark, root)) == {"new/batch=0", "new/batch=1", "new/batch=2"}
    assert read(facts.current(spark, root, KEY)) == want
    assert not facts.append(spark, root, 2, frame(spark, batches[0]), KEY) and read(facts.current(spark, root, KEY)) == want
    plan = facts.current(spark, root, KEY, "2024-02-01", "2024-02-20")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yyyymm" in plan and "Exchange" not in plan and "Join" not in plan
