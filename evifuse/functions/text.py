"""Text and identifier normalisation as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
URL_KEYS = ("url", "link", "page_url", "image_url", "stream_url", "domain", "source_url")
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"\+?[0-9][0-9\-\s().]{6,}[0-9]"
CODE_KEYS = ("imo", "mmsi", "callsign", "tail_number", "registration", "passport_number")


def blank_to_null(c: Column) -> Column:
    """The falsy text of the record model: empty counts as missing."""
    return F.nullif(c, F.lit(""))


def normalize_domain(value: Column) -> Column:
    """Host of a URL or bare domain: lower case, without user info, brackets, port, path and ``www.``; empty is null."""
    v = F.lower(F.trim(value))
    v = F.when(v.contains("://"), F.regexp_extract(v, r"://([^/?#]*)", 1)).otherwise(v)
    v = F.regexp_replace(v, r"^.*@", "")
    v = F.when(v.startswith("[") & v.contains("]"), F.regexp_extract(v, r"^\[([^\]]*)\]", 1)).when(v.rlike(r"^[^:]*:[^:]*$"), F.regexp_extract(v, r"^([^:]*):", 1)).otherwise(v)
    v = F.regexp_extract(v, r"^([^/]*)", 1)
    return blank_to_null(F.regexp_replace(v, r"^www\.", ""))


def first_present(*columns: Column) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def extract_domain(*columns: Column) -> Column:
    """Domain of the first non-blank url-like value (see ``URL_KEYS``)."""
    return normalize_domain(first_present(*columns))


def content_text(text: Column, title: Column, payload: Column) -> Column:
    return F.coalesce(blank_to_null(text), blank_to_null(title), payload)


def canonical_json(payload: Column) -> Column:
    """JSON text with sorted keys; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(payload))


def record_hash(payload: Column) -> Column:
    return F.sha2(F.coalesce(canonical_json(payload), payload), 256)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def normalize_signal(key: Column, value: Column) -> Column:
    """Comparable form of an identity signal."""
    v = F.trim(value)
    code = F.regexp_replace(F.upper(v), "[^A-Z0-9]", "")
    words = F.trim(F.regexp_replace(F.lower(v), r"\s+", " "))
    out = (
        F.when(key == "email", F.lower(v))
        .when(key == "phone", F.when(F.length(digits(v)) >= 7, digits(v)))
        .when(key.isin("handle", "username"), F.lower(F.trim(F.regexp_replace(v, "^@+", ""))))
        .when(key.isin(*CODE_KEYS), code)
        .otherwise(words)
    )
    return blank_to_null(out)


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def sanitize_public(text: Column, most: int = 4000) -> Column:
    """Masks file URIs and drive paths, then clips."""
    t = F.regexp_replace(text, r"(?i)file://[^ \t\r\n]+", "[local path]")
    return F.substring(F.regexp_replace(t, r"(?i)\b[a-z]:\\[^ \t\r\n]+", "[local path]"), 1, most)


def normalize_query(parts: Column) -> Column:
    """Ordered distinct parts, each in lower case with single blanks."""
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s+", " ")))
    return F.array_join(F.array_distinct(F.filter(clean, lambda p: p != "")), " ")


def research_leads(question: Column) -> Column:
    """Distinct (kind, normalised) leads of a question: dates, places, capitalised phrases, long words."""
    q = F.trim(F.regexp_replace(question, r"\s+", " "))
    found = lambda kind, regex, group=0: F.transform(F.regexp_extract_all(q, F.lit(regex), F.lit(group)), lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("normalized")))
    dates = found("time_range", r"\b(?:19|20)[0-9]{2}(?:-[0-9]{2}(?:-[0-9]{2})?)?\b")
    places = found("location", r"\b(?:in|near|at|from) ([A-Z][A-Za-z.-]*(?: [A-Z][A-Za-z.-]*){0,3})", 1)
    names = F.filter(found("entity", r"\b[A-Z][A-Za-z0-9_.-]*(?: [A-Z][A-Za-z0-9_.-]*){0,3}\b"), lambda s: ~s["normalized"].isin("what", "when", "where", "which", "who", "why", "how"))
    words = F.filter(found("keyword", r"[A-Za-z0-9_'-]+"), lambda s: (F.length(s["normalized"]) >= 5) & ~s["normalized"].isin("about", "would", "could", "there", "their", "which"))
    return F.array_sort(F.array_distinct(F.concat(dates, places, names, words)))


@F.pandas_udf(StringType())
def canonical_name(values: pd.Series) -> pd.Series:
    """Transliterated, case-folded words: Unicode decomposition has no built-in counterpart."""

    def one(v):
        if v is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", v.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L")) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in t.casefold()).split())

    return values.map(one)


def normalize_identifier(key: Column, value: Column) -> Column:
    """IMO numbers keep 7 digits, MMSI 9; registrations keep letters and digits; null where the form is wrong."""
    code = F.regexp_replace(F.upper(F.trim(value)), "[^A-Z0-9]", "")
    imo = F.regexp_replace(code, r"^IMO(?=.{7}$)", "")
    return (
        F.when(key == "imo", F.when(imo.rlike("^[0-9]{7}$"), imo))
        .when(key == "mmsi", F.when(code.rlike("^[0-9]{9}$"), code))
        .otherwise(blank_to_null(code))
    )


def extract_identifiers(text: Column) -> Column:
    """Labelled identifiers only: map of key to normalised value."""
    found = [F.struct(F.lit(k).alias("k"), normalize_identifier(F.lit(k), blank_to_null(F.regexp_extract(text, p, 1))).alias("v")) for k, p in (("imo", r"(?i)\bIMO[ :#-]*([0-9]{7})\b"), ("mmsi", r"(?i)\bMMSI[ :#-]*([0-9]{9})\b"), ("case_id", r"(?i)\bcase(?: no\.?| number| id)?[ :#-]+([A-Z0-9-]{4,})"))]
    return F.map_from_entries(F.filter(F.array(*found), lambda s: s["v"].isNotNull()))


def slug_key(*parts: Column, sep: str = "|", n: int = 16) -> Column:
    """First ``n`` hex digits of the SHA-256 of the joined parts; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, n)


def cursor_encode(run_id: Column) -> Column:
    """URL-safe feed cursor."""
    return F.translate(F.base64(F.concat(F.lit('{"v":1,"watch_run_id":'), run_id.cast("string"), F.lit("}")).cast("binary")), "+/", "-_")


def cursor_decode(cursor: Column) -> Column:
    return F.get_json_object(F.unbase64(F.translate(cursor, "-_", "+/")).cast("string"), "$.watch_run_id").cast("long")
