"""Media intake over pictures written out of the events: one 8 x 8 grey picture an event, with spoofed and broken ones."""

from __future__ import annotations

import struct
import uuid
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.operators import media
from evifuse.plans.registry import query
from evifuse.session import shared_dir, table


def png(width: int, height: int, rows: list[bytes], color_type: int = 0) -> bytes:
    """A PNG of filtered scanlines, each with its filter byte."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, color_type, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def _picture(pixels: pd.Series, spot: pd.Series) -> pd.Series:
    """64 grey values, that of one place inverted."""
    out = []
    for p, at in zip(pixels, spot):
        grey = bytearray(p)
        if at < 64:
            grey[at] ^= 255
        out.append(png(8, 8, [b"\0" + bytes(grey[i : i + 8]) for i in range(0, 64, 8)]))
    return pd.Series(out)


def pictures(spark, d):
    """(seq, content, claimed_type): the picture of a user with the place k inverted; errors claim to be audio, cut ones miss a byte, cheap ones are text."""
    e = table(spark, d, "events")
    half = lambda s: F.unhex(F.sha2(F.concat(F.lit(s), F.coalesce(F.col("user_id").cast("string"), F.lit(""))), 256))
    spot = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("props", r'"k": (\d+)', 1), F.lit("")), F.lit("999")).cast("int"), F.lit(64))
    whole = _picture(F.concat(half("a"), half("b")), spot)
    e = e.withColumn("p", whole)
    text = F.encode(F.coalesce("props", F.lit("")), "utf-8")
    content = F.when(F.col("value") < 3, text).when(F.col("event_type") == "signup", F.substring("p", F.lit(1), F.octet_length("p") - 1)).otherwise(F.col("p"))
    return e.select(F.col("event_id").alias("seq"), content.alias("content"), F.when(F.col("event_type") == "error", "audio/mpeg").when(F.col("event_type") == "click", " IMAGE/PNG; q=1").alias("claimed_type"))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN value < 3 THEN 'unrecognized_signature' WHEN event_type = 'error' THEN 'mime_signature_mismatch' WHEN event_type = 'signup' THEN 'malformed_png' END AS bad,
event_id >= (SELECT (max(event_id) + 1) // 2 FROM events) AS late, coalesce(try_cast(nullif(regexp_extract(props, '"k": (\\d+)', 1), '') AS INT), 64) AS k, concat(sha256(concat('a', coalesce(user_id::VARCHAR, ''))), sha256(concat('b', coalesce(user_id::VARCHAR, '')))) AS h FROM events),
g AS (SELECT *, list_transform(range(64), lambda i: CASE WHEN i = k THEN 255 - ('0x' || substr(h, 2 * i::INT + 1, 2))::INT ELSE ('0x' || substr(h, 2 * i::INT + 1, 2))::INT END) AS p FROM e),
b AS (SELECT *, list_sum(p) AS s FROM g), bits AS (SELECT *, array_to_string(list_transform(p, lambda v: CASE WHEN v * 64 >= s THEN '1' ELSE '0' END), '') AS a FROM b),
ok AS (SELECT event_id, p, a, row_number() OVER (PARTITION BY p ORDER BY event_id) = 1 AS is_first FROM bits WHERE bad IS NULL), one AS (SELECT event_id, a FROM ok WHERE is_first),
near AS (SELECT x.event_id, min(hamming(x.a, y.a)) AS distance FROM one x JOIN one y ON y.event_id < x.event_id AND hamming(x.a, y.a) <= 8 GROUP BY 1)
SELECT event_id AS seq, CASE WHEN bad IS NULL THEN 'accepted' ELSE 'quarantined' END AS status, CASE WHEN bad IS NOT NULL THEN bad WHEN NOT is_first THEN 'exact_duplicate' WHEN distance IS NOT NULL THEN 'near_duplicate' END AS reason, CASE WHEN bad IS NULL THEN ok.a END AS perceptual_hash, distance FROM bits LEFT JOIN ok USING (event_id) LEFT JOIN near USING (event_id)"""
)
def media_intake(spark, d):
    """Two batches, so that the second meets what the first accepted."""
    root = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    every = pictures(spark, d)
    middle = ((every.agg(F.max("seq")).first()[0] or 0) + 1) // 2
    for batch, half in enumerate((F.col("seq") < middle, F.col("seq") >= middle)):
        media.ingest(spark, root, batch, every.filter(half))
    return media.items(spark, root).select("seq", "status", "reason", "perceptual_hash", "distance")
