"""Domain relations derived from the driver's tables by integer arithmetic: one select list for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from evifuse.session import table

#: name -> (table, select list). US(x) is microseconds since 1970, SHA(x) the SHA-256 in hex.
VIEWS = {
    "obs": (
        "events",
        """event_id AS observation_id, event_type AS layer_key, concat('s', CAST(user_id % 20 AS STRING), '.example.com') AS source_domain,
        ts AS observed_at, US(ts) AS t_us, user_id,
        CAST(-96.0 AS DOUBLE) + CAST(user_id % 40 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS lon,
        CAST(29.0 AS DOUBLE) + CAST(event_id % 40 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS lat,
        CASE WHEN user_id % 10 = 0 THEN 'blocked' WHEN user_id % 10 <= 3 THEN 'trusted' ELSE 'neutral' END AS trust_level,
        CASE WHEN user_id % 10 = 0 THEN CAST(0.05 AS DOUBLE) WHEN user_id % 10 <= 3 THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence_score,
        event_id % 7 = 0 AS ground_truth, props AS content_json, SHA(props) AS raw_hash""",
    ),
    "runs": (
        "events",
        """user_id AS source_id, event_id AS source_run_id, ts AS started_at, US(ts) AS started_us,
        CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'skipped' ELSE 'completed' END AS status,
        SHA(props) AS payload_sha256, CASE WHEN user_id % 3 = 0 THEN 'http_json' WHEN user_id % 3 = 1 THEN 'rss' ELSE 'http_text' END AS source_kind,
        event_type AS layer_key""",
    ),
    "storage": (
        "orders",
        """o_orderkey AS storage_object_id, US(o_orderdate) AS observed_us,
        CASE WHEN o_orderkey % 4 = 0 THEN 'ephemeral' WHEN o_orderkey % 4 = 1 THEN 'operational' WHEN o_orderkey % 4 = 2 THEN 'investigative' ELSE 'permanent' END AS retention_class,
        CASE WHEN o_orderstatus = 'F' THEN 'cold' WHEN o_orderstatus = 'O' THEN 'hot' ELSE 'warm' END AS storage_tier,
        CASE WHEN o_custkey % 9 = 0 THEN 'expired' ELSE 'active' END AS lifecycle_status, o_orderdate AS observed_at""",
    ),
    "evidence": (
        "lineitem",
        """l_partkey AS claim_id, l_orderkey * 10 + l_linenumber AS evidence_id, l_suppkey AS independence_key,
        CASE WHEN l_returnflag = 'N' THEN 'supports' WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'context' END AS relation,
        CAST(1.0 AS DOUBLE) - CAST(5.0 AS DOUBLE) * l_discount AS source_trust,
        CAST(US(l_shipdate) AS DOUBLE) / CAST(86400000000.0 AS DOUBLE) AS ship_day""",
    ),
    "assertions": (
        "lineitem",
        """l_orderkey * 10 + l_linenumber AS assertion_id, l_suppkey AS subject_entity_id, 1000000 + l_partkey AS object_entity_id,
        CAST(1.0 AS DOUBLE) - l_discount AS confidence_score, l_linestatus AS jurisdiction, US(l_shipdate) AS valid_us""",
    ),
    "citations": (
        "lineitem",
        """l_orderkey * 10 + l_linenumber AS assertion_id, concat('https://c', CAST(l_orderkey % 50 AS STRING), '.example.org') AS source_uri,
        CASE WHEN l_linenumber = 1 THEN 'high' ELSE 'low' END AS source_reliability""",
    ),
    "revisions": (
        "orders",
        """year(o_orderdate) AS run_id, o_custkey AS candidate_id, o_orderkey AS revision_id, o_totalprice AS score, o_orderpriority AS score_bucket,
        CASE WHEN o_orderkey % 11 = 0 THEN 'promoted' WHEN o_orderkey % 13 = 0 THEN 'suppressed' ELSE 'candidate' END AS status,
        o_orderstatus AS content_hash, o_orderstatus AS schema_hash""",
    ),
}


def _for_spark(text: str) -> str:
    text = re.sub(r"US\((\w+)\)", r"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', \1)", text)
    text = re.sub(r"SHA\((\w+)\)", r"sha2(\1, 256)", text)
    return re.sub(r"year\((\w+)\)", r"CAST(year(\1) AS BIGINT)", text)


def _for_oracle(text: str) -> str:
    text = re.sub(r"US\((\w+)\)", r"epoch_us(\1)", text)
    return re.sub(r"SHA\((\w+)\)", r"sha256(\1)", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, select = VIEWS[name]
    parts, depth, now = [], 0, ""
    for c in _for_spark(select):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(now.strip())
            now = ""
        else:
            now += c
    return table(spark, sf_dir, source).selectExpr(*parts, now.strip())


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL behind the named views; the SQL may start with further ``name AS (...),`` parts of the same WITH."""
    ctes = ", ".join(f"{n} AS (SELECT {_for_oracle(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names)
    recursive = "RECURSIVE " if sql.lstrip().startswith("RECURSIVE") else ""
    sql = sql.lstrip().removeprefix("RECURSIVE").lstrip()
    if re.match(r"\w+(?:\s*\([\w, ]+\))? AS \(", sql):
        return f"WITH {recursive}{ctes}, {sql}"
    return f"WITH {ctes} {sql}"
