"""Media intake: signatures, headers and limits, average hashes, content-addressed batches with a quarantine.

Sizes, hashes, signatures and the reasons that follow from them are Columns, so bytes that are too many or of unknown kind
never leave the JVM. One Arrow UDF reads the headers of the rest and, for PNG, the 8 x 8 samples of the average hash; a
batch is decoded once.

A batch is one committed Parquet folder: it holds a row for every item received and the bytes once per content, either
accepted or in quarantine. Writing a batch again changes nothing, and a batch that died before its commit is not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evifuse.functions import rules
from evifuse.operators.candidates import committed
from evifuse.operators.nearhash import Bands
from evifuse.session import shared_dir

# Media types with their signatures (first twelve bytes in hex) and accepted names, in the order they are tried.
SIGNATURES = (
    ("image/jpeg", "^FFD8FF", ("image/jpeg", "image/jpg", "image/pjpeg")),
    ("image/png", "^89504E470D0A1A0A", ("image/png",)),
    ("image/gif", "^474946383[79]61", ("image/gif",)),
    ("image/webp", "^52494646.{8}57454250", ("image/webp",)),
    ("video/mp4", "^.{8}66747970.{8}", ("video/mp4", "video/quicktime")),
    ("audio/wav", "^52494646.{8}57415645", ("audio/wav", "audio/x-wav", "audio/wave")),
    ("audio/flac", "^664C6143", ("audio/flac", "audio/x-flac")),
    ("audio/mpeg", "^494433|^FF[EF][2-7A-F].{4}", ("audio/mpeg", "audio/mp3")),
)
# kbit/s of MPEG audio layer III, version 1 and the others.
RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
#: Pixels a side of the average hash.
GRID = 8
#: Ranges of the order over which the records of one hash are dealt when their smallest name is followed.
RANGES = 256
#: Place in the order of what earlier batches accepted.
KNOWN = -(1 << 62)


@dataclass(frozen=True)
class Limits:
    """What an item may have at most; all are tested before anything is stored."""

    max_bytes: int = 80 * 1024 * 1024
    max_image_width: int = 12_000
    max_image_height: int = 12_000
    max_image_pixels: int = 48_000_000
    max_duration_seconds: float = 4 * 60 * 60
    max_decoded_image_bytes: int = 256 * 1024 * 1024
    near_distance: int = 8


class Rejected(ValueError):
    """The reason for which an item goes to quarantine."""


def _need(ok, reason: str) -> None:
    if not ok:
        raise Rejected(reason)


def _png_parts(data: bytes):
    """(type, body) of the chunks up to the end mark; every checksum must agree and nothing may follow."""
    at, kind = 8, b""
    while kind != b"IEND":
        _need(at + 12 <= len(data), "malformed_png")
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        _need(end <= len(data) and zlib.crc32(data[at + 4 : end - 4]) == int.from_bytes(data[end - 4 : end], "big"), "malformed_png")
        yield kind, data[at + 8 : end - 4]
        at = end
    _need(at == len(data) and not size, "malformed_png")


def _png(data: bytes) -> dict:
    parts = list(_png_parts(data))
    kind, head = parts[0]
    _need(kind == b"IHDR" and len(head) == 13 and any(k == b"IDAT" for k, _ in parts), "malformed_png")
    found = dict(zip(("width", "height", "bit_depth", "color_type", "compression", "filtering", "interlace"), struct.unpack(">IIBBBBB", head)))
    known = found["bit_depth"] in (1, 2, 4, 8, 16) and found["color_type"] in (0, 2, 3, 4, 6) and found["interlace"] in (0, 1)
    _need(known and found["width"] and found["height"] and not found.pop("compression") and not found.pop("filtering"), "malformed_png")
    return found


def _gif(data: bytes) -> dict:
    _need(len(data) >= 10 and data.endswith(b";"), "malformed_gif")
    return _sized(*struct.unpack_from("<HH", data, 6), "malformed_gif")


def _sized(width: int, height: int, reason: str) -> dict:
    _need(width and height, reason)
    return {"width": width, "height": height}


_MARK = re.compile(rb"\xff+([^\xff])", re.DOTALL)


def _jpeg(data: bytes) -> dict:
    _need(data.endswith(b"\xff\xd9"), "malformed_jpeg")
    at = 2
    while at + 4 <= len(data):
        mark = _MARK.match(data, at)
        _need(mark, "malformed_jpeg")
        kind, at = mark[1][0], mark.end()
        if 0xD0 <= kind <= 0xD9:
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        _need(size >= 2 and at + size <= len(data), "malformed_jpeg")
        # frame headers; C4, C8 and CC are other tables
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            _need(size >= 8, "malformed_jpeg")
            precision, height, width = struct.unpack_from(">BHH", data, at + 2)
            return _sized(width, height, "malformed_jpeg") | {"precision": precision}
        at += size
    raise Rejected("jpeg_dimensions_missing")


def _webp(data: bytes) -> dict:
    _need(len(data) >= 30, "malformed_webp")
    little = lambda a, b: int.from_bytes(data[a:b], "little")
    form = data[12:16]
    if form == b"VP8X":
        return {"width": little(24, 27) + 1, "height": little(27, 30) + 1}
    if form == b"VP8L" and data[20] == 0x2F:
        return {"width": (little(21, 25) & 0x3FFF) + 1, "height": (little(21, 25) >> 14 & 0x3FFF) + 1}
    _need(form == b"VP8 " and data[23:26] == b"\x9d\x01\x2a", "malformed_webp")
    return {"width": little(26, 28) & 0x3FFF, "height": little(28, 30) & 0x3FFF}


def _wav(data: bytes) -> dict:
    at, found, size_of_data = 12, {}, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        _need(at + 8 + size <= len(data), "malformed_wav")
        if name == b"fmt " and size >= 16:
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            found = {"sample_rate": rate, "channels": channels, "bits_per_sample": bits}
        elif name == b"data":
            size_of_data = size
        at += 8 + size + size % 2
    _need(found and all(found.values()) and size_of_data is not None, "wav_metadata_missing")
    return found | {"duration_seconds": round(size_of_data * 8 / (found["channels"] * found["sample_rate"] * found["bits_per_sample"]), 6)}


def _flac(data: bytes) -> dict:
    _need(len(data) >= 42 and not data[4] & 0x7F and int.from_bytes(data[5:8], "big") == 34, "malformed_flac")
    packed = int.from_bytes(data[18:26], "big")
    rate, samples = packed >> 44, packed % (1 << 36)
    _need(rate and samples, "flac_duration_missing")
    return {"sample_rate": rate, "channels": (packed >> 41) % 8 + 1, "duration_seconds": round(samples / rate, 6)}


def _mp3(data: bytes) -> dict:
    tag = data[6:10]
    at = 10 + (tag[0] % 128 << 21 | tag[1] % 128 << 14 | tag[2] % 128 << 7 | tag[3] % 128) if data.startswith(b"ID3") and len(tag) == 4 else 0
    head = data[at : at + 4]
    _need(len(head) == 4 and head[0] == 0xFF and head[1] >= 0xE0 and head[1] & 6, "malformed_mp3")
    rate = head[2] >> 4
    _need((head[1] >> 1) % 4 == 1 and 0 < rate < 15 and (head[2] >> 2) % 4 != 3, "mp3_metadata_missing")
    bitrate = (RATES_1 if (head[1] >> 3) % 4 == 3 else RATES_2)[rate] * 1000
    return {"bitrate": bitrate, "duration_seconds": round((len(data) - at) * 8 / bitrate, 6)}


def _mp4(data: bytes) -> dict:
    """Duration of the first movie header, whatever boxes hold it; boxes are read from a stack, so nesting has no bound."""
    spans = [(0, len(data))]
    while spans:
        at, end = spans.pop()
        if at + 8 > end:
            continue
        size, name = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            _need(at + 16 <= end, "malformed_mp4")
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        _need(head <= size <= end - at, "malformed_mp4")
        spans.append((at + size, end))
        if name == b"mvhd":
            body = data[at + head : at + size]
            long = len(body) >= 20 and body[0] == 1
            _need(len(body) >= (32 if long else 20) and body[0] in (0, 1), "malformed_mp4")
            scale, duration = struct.unpack_from(">IQ", body, 20) if long else struct.unpack_from(">II", body, 12)
            _need(scale and duration != (1 << 64) - 1, "mp4_duration_missing")
            return {"duration_seconds": round(duration / scale, 6)}
        if name in (b"moov", b"trak", b"mdia", b"udta"):
            spans.append((at + head, at + size))
    raise Rejected("mp4_duration_missing")


HEADERS = {"image/jpeg": _jpeg, "image/png": _png, "image/gif": _gif, "image/webp": _webp, "video/mp4": _mp4, "audio/wav": _wav, "audio/flac": _flac, "audio/mpeg": _mp3}


def header(data: bytes, media_type: str, limits: Limits) -> dict:
    """What the header says; ``Rejected`` for broken bytes and for what exceeds the limits."""
    found = HEADERS[media_type](data)
    if media_type.startswith("image/"):
        w, h = found["width"], found["height"]
        _need(w <= limits.max_image_width and h <= limits.max_image_height and w * h <= limits.max_image_pixels, "image_dimension_limit_exceeded")
    else:
        _need(found["duration_seconds"] <= limits.max_duration_seconds, "duration_limit_exceeded")
    return found


def _unfiltered(rows: np.ndarray, last: int, step: int):
    """Rows 0 to ``last`` of filtered scanlines, one after the other; ``step`` bytes a pixel."""
    above = np.zeros(rows.shape[1] - 1, np.uint8)
    for kind, raw in zip(rows[: last + 1, 0], rows[: last + 1, 1:]):
        if kind == 1:
            now = raw.reshape(-1, step).cumsum(0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = raw + above
        elif kind in (3, 4):
            up, out = above.tolist(), [0] * step + raw.tolist()
            corner = [0] * step + up
            for i, u in enumerate(up):
                a = out[i]
                if kind == 3:
                    guess = (a + u) // 2
                else:
                    # the neighbour nearest to left + above - corner, in the order left, above, corner
                    c = corner[i]
                    guess = min((abs(u - c), 0, a), (abs(a - c), 1, u), (abs(a + u - 2 * c), 2, c))[2]
                out[i + step] = out[i + step] + guess & 255
            now = np.array(out[step:], np.uint8)
        else:
            now = raw
        above = now
        yield now


def average_hash(data: bytes, found: dict, limits: Limits) -> str | None:
    """64 bits of an 8-bit PNG without interlace or palette: whether each sample reaches the mean of all. None for others."""
    step = {0: 1, 2: 3, 4: 2, 6: 4}.get(found["color_type"])
    w, h = found["width"], found["height"]
    size = h * (w * (step or 0) + 1)
    if step is None or found["bit_depth"] != 8 or found["interlace"] or size > limits.max_decoded_image_bytes:
        return None
    inflate = zlib.decompressobj()
    try:
        pixels = inflate.decompress(b"".join(body for kind, body in _png_parts(data) if kind == b"IDAT"), size + 1)
    except zlib.error:
        return None
    if len(pixels) != size or not inflate.eof:
        return None
    rows = np.frombuffer(pixels, np.uint8).reshape(h, -1)
    if rows[:, 0].max() > 4:
        return None
    ys, xs = [y * h // GRID for y in range(GRID)], [x * w // GRID for x in range(GRID)]
    kept = {y: row for y, row in enumerate(_unfiltered(rows, ys[-1], step)) if y in ys}
    at = np.array([kept[y].reshape(w, step)[xs] for y in ys]).reshape(-1, step).astype(np.int64)
    luma = at[:, 0] if step < 3 else at[:, :3] @ np.array([299, 587, 114]) // 1000
    return "".join("1" if v else "0" for v in luma * len(luma) >= luma.sum())


def media_type(content: Column) -> Column:
    """Type by signature, null for unknown bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.coalesce(*[F.when(head.rlike(s), t) for t, s, _ in SIGNATURES])


def inspect(media: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``media(seq, content, claimed_type)`` with byte_size, sha256, media_type, reason, metadata and perceptual_hash.

    ``reason`` is null for what may be stored. A null content counts as empty bytes; a claimed type that is null or blank
    is not compared. Other columns stay.
    """
    claim = F.nullif(F.lower(F.trim(F.substring_index("claimed_type", ";", 1))), F.lit(""))
    df = media.withColumn("content", F.coalesce("content", F.lit(b""))).withColumns({"byte_size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256), "media_type": media_type(F.col("content"))})
    fits = reduce(lambda a, b: a | b, [(F.col("media_type") == t) & claim.isin(*names) for t, _, names in SIGNATURES])
    early = rules.first_reason(
        (F.col("byte_size") > limits.max_bytes, "byte_limit_exceeded"),
        (F.col("media_type").isNull(), "unrecognized_signature"),
        (claim.isNotNull() & ~fits, "mime_signature_mismatch"),
        otherwise="",
    )

    @F.pandas_udf("reason string, metadata map<string,double>, perceptual_hash string")
    def read(contents: pd.Series, types: pd.Series) -> pd.DataFrame:
        out = []
        for data, kind in zip(contents, types):
            reason, found, bits = None, {}, None
            if data is not None:
                try:
                    found = header(data, kind, limits)
                    bits = average_hash(data, found, limits) if kind == "image/png" else None
                except Rejected as e:
                    reason = str(e)
            out.append((reason, {k: float(v) for k, v in found.items()}, bits))
        return pd.DataFrame(out, columns=["reason", "metadata", "perceptual_hash"])

    df = df.withColumn("__early", F.nullif(early, F.lit(""))).withColumn("media_type", F.when(F.col("byte_size") <= limits.max_bytes, F.col("media_type")))
    df = df.withColumn("__h", read(F.when(F.col("__early").isNull(), F.col("content")), F.col("media_type")))
    return df.withColumns({"reason": F.coalesce("__early", "__h.reason"), "metadata": F.col("__h.metadata"), "perceptual_hash": F.col("__h.perceptual_hash")}).drop("__early", "__h")


def earlier_smallest(records: DataFrame) -> DataFrame:
    """``records(bits, seq, sha256)`` with ``before``: the smallest name among the records of the same bits with a smaller ``seq``.

    The order is cut into ``RANGES`` ranges, in which windows run; the smallest names of earlier ranges come from one row a
    hash and range. So one hash may hold any share of the rows.
    """
    cuts = records.agg(F.percentile_approx("seq", [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts"))
    dealt = records.crossJoin(F.broadcast(cuts)).withColumn("__r", F.size(F.filter(F.coalesce("cuts", F.array().cast("array<long>")), lambda c: c < F.col("seq")))).drop("cuts")
    least = dealt.groupBy("bits", "__r").agg(F.min("sha256").alias("__m"))
    before = least.withColumn("__b", F.min("__m").over(Window.partitionBy("bits").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))).drop("__m")
    inside = F.min("sha256").over(Window.partitionBy("bits", "__r").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("__i", inside).join(before, ["bits", "__r"]).withColumn("before", F.least("__i", "__b")).select("bits", "seq", "sha256", "before")


def near_earlier(records: DataFrame, limit: int, most: int | None = None) -> DataFrame:
    """(sha256, near_duplicate_of, distance): for ``records(bits, seq, sha256)`` the nearest earlier record within ``limit`` bits, the smallest name of equally near ones.

    A record with an equal hash before it has its answer at distance 0. So only the first record of each hash looks at
    others, and of those only records that were the smallest name of their hash when they came can be an answer. First it
    looks at close ones; most of a crowd of like pictures end there, and only the rest look at the whole limit.
    """
    b = Bands(GRID * GRID, limit)
    shared_dir(records.sparkSession)
    followed = earlier_smallest(records.filter(F.col("bits").rlike(f"^[01]{{{b.bits}}}$"))).checkpoint()
    same = followed.filter("before is not null").select("sha256", F.col("before").alias("near_duplicate_of"), F.lit(0).alias("distance"))
    known = followed.filter("before is null or sha256 < before").select("seq", "sha256", *b.parse(F.col("bits")))
    asked = followed.filter(F.col("before").isNull() & (F.col("seq") > KNOWN)).select("seq", "sha256", *b.parse(F.col("bits")))
    best = lambda met: met.groupBy("sha256").agg(F.min(F.struct("distance", "name")).alias("m")).select("sha256", F.col("m.name").alias("near_duplicate_of"), "m.distance")
    if limit < 4:
        return same.union(best(_banded_earlier(b, asked, known, most)))
    # whoever has a record within a quarter or half of the limit needs no look at farther ones
    found = best(_banded_earlier(Bands(b.bits, limit // 4), asked, known, most)).checkpoint()
    for within in (limit // 2, limit):
        rest = asked.join(found.select("sha256"), "sha256", "left_anti")
        found = found.union(best(_far_earlier(Bands(b.bits, within), limit // 3 + 1, rest, known, most))).checkpoint()
    return same.union(found)


def _banded_earlier(b: Bands, asked: DataFrame, known: DataFrame, most: int | None) -> DataFrame:
    """(sha256, distance, name) of what lies before within the limit of ``b``: pairs of a band value, neighbours where it is crowded. ``known`` holds ``asked``."""
    asked, steps = b.spread(asked), b.spread(known)
    crowd = b.crowded(steps, most).checkpoint()
    (few, many), (few_known, many_known) = b.split(asked, crowd, "sha256"), b.split(steps, crowd, "sha256")
    pairs = _pairs(b, few, few_known, b.limit)
    return pairs if crowd.isEmpty() else pairs.union(_crowded_earlier(b, many, many_known, b.limit))


def _pairs(b: Bands, asked: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    theirs = known.select(*b.place, F.col("seq").alias("o_seq"), F.col("sha256").alias("name"), *[F.col(w).alias(f"o_{w}") for w in b.words])
    return asked.join(theirs, b.place).filter("o_seq < seq").withColumn("distance", b.distance()).filter(F.col("distance") <= limit).select("sha256", "distance", "name")


def _far_earlier(b: Bands, count: int, asked: DataFrame, known: DataFrame, most: int | None) -> DataFrame:
    """(sha256, distance, name) within the limit of ``b`` for few ``asked`` among many ``known``.

    The limit is shared out over ``count`` wide bands: two hashes within it differ by at most the share of a band in one of
    them. Each asked hash lists the values within that share, so that known ones meet it at 21 positions (limit 8), not at 7.
    """
    wide, (each, over) = Bands(b.bits, count - 1), divmod(b.limit + 1, count)
    flips = [(i, *wide.mask(at)) for i, band in enumerate(wide.bands) for k in range(each + (i < over)) for at in combinations(band, k)]
    table = F.broadcast(asked.sparkSession.createDataFrame(flips, ", ".join(["band int", *[f"m{i} long" for i in range(len(wide.words))]])))
    listed = wide.spread(asked).join(table, "band").withColumns({f"p{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"m{i}")) for i in range(len(wide.words))})
    steps = wide.spread(known)
    crowd = wide.crowded(steps, b.listed if most is None else most).checkpoint()
    few, many = wide.split(steps, crowd, "sha256")
    pairs = _pairs(wide, listed, few, b.limit)
    if crowd.isEmpty():
        return pairs
    # what shares a crowded value is looked at by the narrow bands
    return pairs.union(_banded_earlier(b, asked, many.select(*known.columns).union(asked.select(*known.columns)).distinct(), most))


def _crowded_earlier(b: Bands, asked: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """(sha256, distance, name) in crowded band values: at each neighbour and number of flips, the smallest name of what came before."""
    listed = b.neighbours(known.select("seq", "sha256", "band", *b.words)).select("seq", "sha256", "flips", *b.at)
    there = Window.partitionBy(*b.at).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    seen = listed.withColumns({f"__l{k}": F.min(F.when(F.col("flips") == k, F.col("sha256"))).over(there) for k in range(b.reach + 1)})
    found = F.array(*[F.struct((F.col("flips") + k).cast("int").alias("distance"), F.col(f"__l{k}").alias("name")) for k in range(b.reach + 1)])
    out = seen.join(asked.select("sha256").distinct(), "sha256", "left_semi").select("sha256", F.explode(found).alias("f")).select("sha256", "f.*")
    return out.filter(F.col("name").isNotNull() & (F.col("distance") <= limit))


def decide(inspected: DataFrame, known: DataFrame | None = None, limits: Limits = Limits(), most: int | None = None) -> DataFrame:
    """Intake decisions in order of ``seq``: adds status, reason, duplicate_of, near_duplicate_of, distance and ``first``.

    ``known(sha256, perceptual_hash)`` was accepted before. The first item of a content is stored; later ones and those of
    known contents are exact duplicates. Contents that were rejected are never known. ``reason`` is the first reason code.
    """
    ok = inspected.filter("reason is null")
    new = ok.groupBy("sha256").agg(F.min("seq").alias("seq"), F.first("perceptual_hash").alias("bits"))
    old = known.select("sha256", F.lit(None).cast("long").alias("seq"), F.col("perceptual_hash").alias("bits")) if known is not None else None
    if old is not None:
        new = new.join(old.select("sha256"), "sha256", "left_anti")
    records = new.select("bits", "seq", "sha256")
    if old is not None:
        records = records.unionByName(old.select("bits", F.lit(KNOWN).alias("seq"), "sha256"))
    near = near_earlier(records, limits.near_distance, most).join(new.select("sha256"), "sha256", "left_semi")
    stored = new.select("sha256", F.col("seq").alias("__first")).join(near, "sha256", "left")
    bad = inspected.filter("reason is not null").groupBy("sha256").agg(F.min("seq").alias("__bad"))
    df = inspected.join(stored, "sha256", "left").join(bad, "sha256", "left")
    accepted, is_first = F.col("reason").isNull(), F.col("seq").eqNullSafe(F.col("__first"))
    code = F.when(~accepted, F.col("reason")).when(~is_first, "exact_duplicate").when(F.col("near_duplicate_of").isNotNull(), "near_duplicate")
    return df.withColumns({
        "status": F.when(accepted, "accepted").otherwise("quarantined"),
        "first": F.when(accepted, is_first).otherwise(F.col("seq") == F.col("__bad")),
        "duplicate_of": F.when(accepted & ~is_first, F.col("sha256")),
        "near_duplicate_of": F.when(accepted & is_first, F.col("near_duplicate_of")),
        "distance": F.when(accepted & is_first, F.col("distance")),
        "reason": code,
    }).drop("__first", "__bad")


def ingest(spark: SparkSession, root: str, batch: int, media: DataFrame, limits: Limits = Limits()) -> bool:
    """Writes the decisions on a batch, with the bytes of each new content once; false if the batch is there already."""
    if batch in committed(spark, root):
        return False
    shared_dir(spark)
    # decoded once: decisions read the rows several times
    seen = inspect(media, limits).checkpoint()
    out = decide(seen, objects(spark, root), limits)
    out.withColumn("content", F.when(F.col("first"), F.col("content"))).write.mode("overwrite").partitionBy("status").parquet(f"{root}/batch={batch}")
    return True


def items(spark: SparkSession, root: str) -> DataFrame | None:
    """Every item of every committed batch; null before the first."""
    parts = [spark.read.parquet(f"{root}/batch={b}").withColumn("batch", F.lit(b)) for b in committed(spark, root)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def objects(spark: SparkSession, root: str) -> DataFrame | None:
    """The accepted contents, one row each."""
    every = items(spark, root)
    return None if every is None else every.filter("status = 'accepted' and first")
