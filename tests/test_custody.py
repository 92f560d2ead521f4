"""Custody chain: replay, crash before the seal, and every kind of tampering found in its place."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from evifuse.operators import custody


@pytest.fixture
def chain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(custody, "BLOCK", 8)
    root, head = str(tmp_path / "log"), ""
    for k in range(3):
        head = custody.append(spark, root, k, log(spark, k))
    return root, head


def log(spark, k: int, n: int = 60):
    rows = [(100 * k + i, "source", str(i % 7), "created", None if i % 5 else "", "{}", 1_700_000_000 + i // 2, "x") for i in range(n)]
    return spark.createDataFrame(rows, "custody_log_id long, object_type string, object_id string, action string, actor string, details string, s long, extra string").withColumn("created_at", F.timestamp_seconds("s"))


def rewrite(spark, root: str, name: str, change, tmp_path) -> None:
    """A copy of batch 1 of a folder, changed, in its place."""
    at = f"{root}/{name}/batch=1"
    change(spark.read.parquet(at)).write.parquet(str(tmp_path / "new"))
    shutil.move(at, str(tmp_path / "old"))
    shutil.move(str(tmp_path / "new"), at)


def found(spark, root, head=None):
    return {(r.level, r.batch, r.reason) for r in custody.verify(spark, root, head).collect()}


def test_sound_and_replayed(spark, chain):
    root, head = chain
    assert found(spark, root, head) == set()
    assert custody.append(spark, root, 1, log(spark, 1)) == head and custody.entries(spark, root).count() == 180
    with pytest.raises(ValueError):
        custody.append(spark, root, -1, log(spark, 0))
    newest = custody.listing(spark, root, object_id="3", limit=2).collect()
    assert [r.custody_log_id for r in newest] == [259, 159]
    assert {r.object_id for r in custody.listing(spark, root, object_id="3", limit=9999).collect()} == {"3"}
    assert custody.append(spark, root, 5, log(spark, 5, 0)) != head and found(spark, root) == set()


def test_a_crash_before_the_seal_leaves_nothing(spark, chain, tmp_path):
    root, head = chain
    shutil.move(f"{root}/seals/batch=2", str(tmp_path / "seal"))
    assert custody.entries(spark, root).count() == 120 and found(spark, root) == set()
    assert custody.append(spark, root, 2, log(spark, 2)) == head and custody.entries(spark, root).count() == 180


def test_an_altered_entry_is_located(spark, chain, tmp_path):
    root, head = chain
    one = custody.entries(spark, root).filter("custody_log_id = 133").first()
    rewrite(spark, root, "entries", lambda df: df.withColumn("actor", F.when(F.col("custody_log_id") == 133, "someone").otherwise(F.col("actor"))), tmp_path)
    got = {(r.level, r.batch, r.part, r.position, r.reason) for r in custody.verify(spark, root, head).collect()}
    assert got == {("entry", 1, one.part, one["at"], "altered"), ("block", 1, one.part, one["at"] // 8, "altered")}


@pytest.mark.parametrize("name", ["matching hash", "removed", "null to empty"])
def test_other_changes_are_found_in_their_block(spark, chain, tmp_path, name):
    root, head = chain
    one = custody.entries(spark, root).filter("custody_log_id = 133").first()
    is_one = F.col("custody_log_id") == 133
    change = {
        "matching hash": lambda df: df.withColumn("action", F.when(is_one, "deleted").otherwise(F.col("action"))).withColumn("entry_hash", custody.entry_hash()),
        "removed": lambda df: df.filter(~is_one),
        "null to empty": lambda df: df.withColumn("actor", F.when(is_one, "").otherwise(F.col("actor"))).withColumn("entry_hash", custody.entry_hash()),
    }[name]
    rewrite(spark, root, "entries", change, tmp_path)
    got = {(r.level, r.batch, r.part, r.position, r.reason) for r in custody.verify(spark, root, head).collect()}
    assert got == {("block", 1, one.part, one["at"] // 8, "missing" if name == "removed" else "altered")}


def test_rewritten_digests_and_seals(spark, chain, tmp_path):
    root, head = chain
    rewrite(spark, root, "seals", lambda df: df.withColumn("seal", F.sha2("seal", 256)), tmp_path)
    assert found(spark, root) == {("chain", 1, "seal"), ("chain", 2, "seal")}


def test_a_chain_cut_short_misses_the_kept_seal(spark, chain, tmp_path):
    root, head = chain
    shutil.move(f"{root}/seals/batch=2", str(tmp_path / "seal"))
    assert found(spark, root) == set() and found(spark, root, head) == {("head", 1, "seal")}
