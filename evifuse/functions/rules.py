"""Small rule tables as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRUST_SCORES = {"trusted": 0.85, "neutral": 0.5, "blocked": 0.05}
REDACTION = {"public": 0, "restricted": 1, "confidential": 2, "secret": 3}
RETENTION_HOURS = {"ephemeral": 24, "operational": 24 * 7, "investigative": 24 * 30}


def lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null: least and greatest would skip it."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def trust_score(level: Column) -> Column:
    return lookup(level, TRUST_SCORES, TRUST_SCORES["neutral"])


def redaction_rank(level: Column) -> Column:
    """Null and blank are public; an unknown level ranks as confidential."""
    v = F.lower(F.trim(F.coalesce(level, F.lit("public"))))
    return F.when(v == "", 0).otherwise(lookup(v, REDACTION, REDACTION["confidential"]))


def visible(level: Column, ceiling: str | None) -> Column:
    return F.lit(True) if ceiling is None else redaction_rank(level) <= redaction_rank(F.lit(ceiling))


def expires_at(retention: Column, observed_at: Column, explicit: Column | None = None) -> Column:
    """Explicit time, else the base plus the window of the class; permanent has none."""
    hours = lookup(retention, RETENTION_HOURS, None).cast("int")
    computed = F.when(hours.isNotNull(), observed_at + F.make_dt_interval(F.lit(0), hours))
    return computed if explicit is None else F.coalesce(explicit, computed)


def parse_time(value: Column) -> Column:
    """Epoch seconds or milliseconds, or ISO text; null otherwise. Zero and negative epochs are null."""
    v = F.trim(value)
    n = v.try_cast("double")
    seconds = F.when(n > 10_000_000_000, n / 1000).when(n > 0, n)
    return F.when(v.rlike(r"^[0-9]+$"), F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(v))


def is_true(value: Column) -> Column:
    """Ground-truth flags of any JSON type, read as text."""
    v = F.lower(F.trim(value))
    return F.coalesce(v.isin("1", "true", "yes", "verified", "confirmed", "direct") | (v.try_cast("double") != 0), F.lit(False))


def domain_within(domain: Column, parent: Column) -> Column:
    return (domain == parent) | domain.endswith(F.concat(F.lit("."), parent))


def same_scope(a: Column, b: Column) -> Column:
    """Either is a suffix of the other; a missing side matches."""
    return F.coalesce(domain_within(a, b) | domain_within(b, a), F.lit(True))


def glob(value: Column, pattern: str) -> Column:
    """``*`` and ``?`` patterns, full match."""
    return value.rlike("^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in pattern) + "$")


def first_reason(*cases: tuple[Column, str], otherwise: str) -> Column:
    """Ordered rules: the first that holds names the outcome."""
    out = F.when(F.coalesce(cases[0][0], F.lit(False)), cases[0][1])
    for test, reason in cases[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), reason)
    return out.otherwise(otherwise)


def revisit_seconds(candidate_type: Column, fmt: Column, cadence: Column, backfill: Column) -> Column:
    return (
        F.when(backfill | candidate_type.isin("historical_archive", "archive_dataset"), 7 * 24 * 3600)
        .when(cadence.isin("live", "realtime", "continuous"), 300)
        .when(cadence.isin("hourly", "frequent") | fmt.isin("rss", "atom", "jsonl"), 1800)
        .when(cadence == "daily", 6 * 3600)
        .when(candidate_type.isin("api", "open_data_dataset", "incident_status"), 3600)
        .otherwise(24 * 3600)
    )
