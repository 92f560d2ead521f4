"""Candidates with revisions: observations merge into one state per URL hash, and each leaves a numbered revision.

A batch is one folder that one Spark job writes: the new states of the candidates that it touches and their revisions. It
counts once the job has committed (Spark's ``_SUCCESS``), so state and log cannot part: a job that died leaves a folder
that is not read and that the next try replaces, and a batch that is applied again changes nothing. The state of any
batch can be read back.

The fold depends on order (a campaign may lower its own score, another takes over only with as good a one), so a task
reads a candidate's observations sorted and holds one state. A single URL with very many observations is bounded in
memory, not in time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.operators import discovery

STATE = "url_hash string, canonical_url string, score double, score_bucket string, status string, owner_campaign_id long, content_hash string, schema_hash string, first_run_id long, last_run_id long, last_seen_at timestamp, last_changed_at timestamp, revisions long"
REVISION = "revision_number long, revision_kind string, changed boolean, campaign_id long, run_id long, observed_at timestamp, observed_score double, observed_bucket string"
_STATE = [c.split()[0] for c in STATE.split(", ")]
_REVISION = [c.split()[0] for c in REVISION.split(", ")]
_OUT = ["kind", *_STATE, *_REVISION]
#: Rows that the fold holds as Python objects at a time.
PART = 1_000
OBSERVATION = ["url_hash", "canonical_url", "campaign_id", "run_id", "observed_at", "score", "trust_level", "content_hash", "schema_hash"]


def _status(bucket: str, trust: str | None, existing: str | None) -> str:
    """Promoted and suppressed stay."""
    if existing in ("promoted", "suppressed"):
        return existing
    if trust == "blocked" or bucket == "quarantine":
        return "quarantined"
    return {"ignore": "ignored", "revisit_later": "deferred"}.get(bucket, "candidate")


def _none(value):
    return None if pd.isna(value) else value


def _fold(batches):
    """States and revisions of rows sorted by candidate, with the state so far first."""
    state: dict | None = None
    key, known = None, True
    out: list[dict] = []
    for rows in (b.iloc[i : i + PART] for b in batches for i in range(0, len(b), PART)):
        for r in rows.to_dict("records"):
            if r["url_hash"] != key:
                if state and not known:
                    out.append(state | {"kind": "state"})
                key, state, known = r["url_hash"], None, True
            r = {k: _none(v) for k, v in r.items()}
            if r["from_state"]:
                state = {k: r[k] for k in _STATE}
                continue
            if state and state["canonical_url"] != r["canonical_url"]:
                out.append({"kind": "collision", "url_hash": key, "canonical_url": r["canonical_url"], "campaign_id": r["campaign_id"], "run_id": r["run_id"], "observed_at": r["observed_at"]})
                continue
            created, known = state is None, False
            state = dict(state or {"url_hash": key, "canonical_url": r["canonical_url"], "score": None, "status": None, "owner_campaign_id": r["campaign_id"], "first_run_id": r["run_id"], "revisions": 0, "last_changed_at": None})
            changed = created or (state["content_hash"], state["schema_hash"]) != (r["content_hash"], r["schema_hash"])
            if created or state["owner_campaign_id"] == r["campaign_id"] or r["observed_score"] >= state["score"]:
                state |= {"score": r["observed_score"], "score_bucket": r["observed_bucket"], "owner_campaign_id": r["campaign_id"]}
            state |= {
                "status": _status(state["score_bucket"], r["trust_level"], state["status"]),
                "content_hash": r["content_hash"], "schema_hash": r["schema_hash"], "last_run_id": r["run_id"], "last_seen_at": r["observed_at"],
                "last_changed_at": r["observed_at"] if changed else state["last_changed_at"], "revisions": state["revisions"] + 1,
            }
            out.append({"kind": "revision", "revision_number": state["revisions"], "revision_kind": "discovered" if created else "rediscovered", "changed": changed}
                | {k: r[k] for k in ("url_hash", "canonical_url", "campaign_id", "run_id", "observed_at", "observed_score", "observed_bucket", "content_hash", "schema_hash")})
        if len(out) >= PART:
            yield _frame(out)
            out = []
    if state and not known:
        out.append(state | {"kind": "state"})
    yield _frame(out)


def _frame(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame([{k: r.get(k) for k in _OUT} for r in rows], columns=_OUT, dtype=object)
    for c in ("observed_at", "last_seen_at", "last_changed_at"):
        df[c] = pd.to_datetime(df[c])
    return df


def merge(state: DataFrame, observations: DataFrame) -> DataFrame:
    """Rows of kind state (of touched candidates), revision and collision, from ``state`` and the observations in order of time, run and campaign.

    Observations without a URL hash or a score are left out; a hash that comes with another URL is a collision and does not merge.
    """
    seen = observations.filter("url_hash is not null and score is not null").select(*OBSERVATION)
    touched = state.join(seen.select("url_hash").distinct(), "url_hash", "left_semi").withColumn("from_state", F.lit(True))
    own = seen.withColumnRenamed("score", "observed_score").withColumn("observed_bucket", discovery.bucket(F.col("observed_score"), F.lit(False), F.lit(False))).withColumn("from_state", F.lit(False))
    rows = touched.unionByName(own, allowMissingColumns=True).repartition("url_hash")
    order = ["url_hash", F.col("from_state").desc(), "observed_at", "run_id", "campaign_id", "content_hash", "observed_score"]
    return rows.sortWithinPartitions(*order).mapInPandas(_fold, f"kind string, {STATE}, {REVISION}")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches that count."""
    p, fs = _files(spark, root)
    if not fs.exists(p):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(p)]
    return sorted(int(n[6:]) for n, at in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")))


def _read(spark: SparkSession, root: str, kind: str, columns: str, as_of: int | None = None) -> DataFrame:
    batches = [b for b in committed(spark, root) if as_of is None or b <= as_of]
    schema = f"{columns}, kind string, batch long"
    if not batches:
        return spark.createDataFrame([], schema).drop("kind")
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/batch={b}" for b in batches]).filter(F.col("kind") == kind).drop("kind")


def states(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame:
    """Each candidate as the last batch that touched it left it; ``as_of`` goes back to that batch."""
    rows = _read(spark, root, "state", STATE, as_of)
    return rows.groupBy("url_hash").agg(F.max_by(F.struct(*_STATE), "batch").alias("s")).select("s.*")


def revisions(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame:
    """The log, one row per merged observation; its numbers run from 1 for each candidate without a gap."""
    own = "url_hash string, canonical_url string, content_hash string, schema_hash string"
    return _read(spark, root, "revision", f"{own}, {REVISION}", as_of)


def collisions(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "collision", "url_hash string, canonical_url string, campaign_id long, run_id long, observed_at timestamp")


def apply_batch(spark: SparkSession, root: str, batch: int, observations: DataFrame) -> bool:
    """Merge a batch; False if it counts already. Batches come in order of their numbers."""
    done = committed(spark, root)
    if batch in done:
        return False
    if done and batch < done[-1]:
        raise ValueError(f"batch {batch} comes after batch {done[-1]}")
    merge(states(spark, root), observations).write.mode("overwrite").partitionBy("kind").parquet(f"{root}/batch={batch}")
    return True
