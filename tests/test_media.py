"""Media intake: headers, limits, average hashes against a plain decoder, decisions against a plain fold, batches."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from evifuse.operators import media
from evifuse.plans.media import png

GREY = png(2, 2, [b"\0\0\0", b"\0\0\0"])


def wav(seconds: int) -> bytes:
    data = bytes(16_000 * seconds)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8_000, 16_000, 2, 16) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + name + body


def flac(rate: int, samples: int) -> bytes:
    return b"fLaC\0\0\0\x22" + bytes(10) + (rate << 44 | 1 << 41 | 15 << 36 | samples).to_bytes(8, "big") + bytes(16)


JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xff\xc0\0\x0b\x08\0\x05\0\x07\1\1\x11\0\xff\xd9"
MOVIE = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"udta", b"") + box(b"mvhd", bytes(12) + struct.pack(">II", 600, 1500) + bytes(80)))
CASES = [
    # content, claimed type, small limits, reason, some metadata
    (b"not actually an image", "image/png", "unrecognized_signature", {}),
    (None, None, "unrecognized_signature", {}),
    (GREY, "audio/mpeg", "mime_signature_mismatch", {}),
    (GREY, " Image/PNG ; x=1", None, {"width": 2, "height": 2, "interlace": 0}),
    (GREY[:-1], None, "malformed_png", {}),
    (GREY + b"x", None, "malformed_png", {}),
    (GREY[:40] + b"x" + GREY[41:], None, "malformed_png", {}),
    (png(0, 2, []), "", "malformed_png", {}),
    (png(5, 5, [bytes(6)] * 5), None, "image_dimension_limit_exceeded", {}),
    (b"x" * 40_001, None, "byte_limit_exceeded", {}),
    (wav(1), "audio/wave", None, {"duration_seconds": 1.0, "channels": 1}),
    (wav(2), None, "duration_limit_exceeded", {}),
    (wav(1)[:60], None, "malformed_wav", {}),
    (b"RIFF\0\0\0\0WAVE", None, "wav_metadata_missing", {}),
    (b"GIF89a" + struct.pack("<HH", 3, 4) + b";", "image/gif", None, {"width": 3, "height": 4}),
    (b"GIF87a" + struct.pack("<HH", 3, 4), None, "malformed_gif", {}),
    (JPEG, "image/jpg", "image_dimension_limit_exceeded", {}),
    (JPEG[:-1], None, "malformed_jpeg", {}),
    (b"\xff\xd8\xff\xe0\0\4ab\xff\xd9", None, "jpeg_dimensions_missing", {}),
    (MOVIE, "video/quicktime", "duration_limit_exceeded", {}),
    (MOVIE.replace(struct.pack(">II", 600, 1500), struct.pack(">II", 1000, 1500)), None, None, {"duration_seconds": 1.5}),
    (box(b"ftyp", b"isom\0\0\0\0"), None, "mp4_duration_missing", {}),
    (MOVIE[:-1], None, "malformed_mp4", {}),
    (flac(8000, 12000), "audio/flac", None, {"duration_seconds": 1.5, "sample_rate": 8000, "channels": 2}),
    (flac(8000, 0), None, "flac_duration_missing", {}),
    (b"\xff\xfb\x90\0" + bytes(12_000), "audio/mp3", None, {"bitrate": 128_000, "duration_seconds": 0.75025}),
    (b"ID3\4\0\0\0\0\0\4abcd\xff\xfb\x90\0", None, None, {"bitrate": 128_000}),
    (b"ID3\4", None, "malformed_mp3", {}),
    (b"\xff\xfb\xf0\0", None, "mp3_metadata_missing", {}),
    (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + b"\2\0\0\3\0\0", "image/webp", None, {"width": 3, "height": 4}),
    (b"RIFF\0\0\0\0WEBPVP8?" + bytes(14), None, "malformed_webp", {}),
]
SMALL = media.Limits(max_bytes=40_000, max_image_pixels=16, max_duration_seconds=1.5)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, content binary, claimed_type string")


def test_headers_and_limits(spark):
    got = media.inspect(frame(spark, [(c, t) for c, t, *_ in CASES]), SMALL).orderBy("seq").collect()
    for r, (_, _, reason, found) in zip(got, CASES):
        assert r.reason == reason, (r.seq, r.reason, reason)
        assert {k: (r.metadata or {}).get(k) for k in found} == found, r.seq
    assert media.inspect(frame(spark, []).limit(0)).count() == 0


def plain_hash(pixels: np.ndarray) -> str:
    h, w = pixels.shape[:2]
    luma = [int(p[0]) if len(p) < 3 else (299 * int(p[0]) + 587 * int(p[1]) + 114 * int(p[2])) // 1000 for y in range(8) for x in range(8) for p in [pixels[y * h // 8, x * w // 8]]]
    return "".join("1" if v >= sum(luma) / 64 else "0" for v in luma)


def filtered(pixels: np.ndarray, kinds: list[int]) -> list[bytes]:
    h, w, c = pixels.shape
    at = lambda y, x, k: int(pixels[y, x, k]) if y >= 0 and x >= 0 else 0
    out = []
    for y in range(h):
        row = [kinds[y]]
        for x in range(w):
            for k in range(c):
                a, u, q = at(y, x - 1, k), at(y - 1, x, k), at(y - 1, x - 1, k)
                g = a + u - q
                paeth = a if abs(g - a) <= abs(g - u) and abs(g - a) <= abs(g - q) else u if abs(g - u) <= abs(g - q) else q
                row.append((at(y, x, k) - [0, a, u, (a + u) // 2, paeth][kinds[y]]) % 256)
        out.append(bytes(row))
    return out


@pytest.mark.parametrize("color_type, channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_average_hash_undoes_every_filter(color_type, channels):
    r = np.random.RandomState(color_type)
    for w, h in ((1, 1), (3, 20), (17, 9), (8, 8)):
        pixels = r.randint(0, 256, (h, w, channels)).astype(np.uint8)
        data = png(w, h, filtered(pixels, list(r.randint(0, 5, h))), color_type)
        assert media.average_hash(data, media.header(data, "image/png", media.Limits()), media.Limits()) == plain_hash(pixels)
    wrong = png(2, 2, [b"\0\0\0", b"\7\0\0"])
    short = png(2, 2, [b"\0\0\0"])
    bomb = png(2, 2, [bytes(10_000_000)])
    for data in (wrong, short, bomb):
        assert media.average_hash(data, media.header(data, "image/png", media.Limits()), media.Limits()) is None
    assert media.average_hash(GREY, media.header(GREY, "image/png", media.Limits()), media.Limits(max_decoded_image_bytes=5)) is None


def fold(rows: list[tuple[int, str, str | None]], limit: int, stored: dict[str, str | None]) -> dict[int, tuple]:
    out = {}
    for seq, name, bits in sorted(rows):
        if name in stored:
            out[seq] = ("exact_duplicate", name, None)
            continue
        near = [(sum(a != b for a, b in zip(bits, o)), n) for n, o in stored.items() if bits and o]
        near = min([x for x in near if x[0] <= limit], default=None)
        stored[name] = bits
        out[seq] = ("near_duplicate" if near else None, None, near and near[1])
    return out


@pytest.mark.parametrize("most", [None, 2])
def test_decisions_equal_a_fold(spark, most):
    r, limits = random.Random(most), media.Limits(near_distance=3)
    bases = ["".join(r.choice("01") for _ in range(64)) for _ in range(6)]
    rows = []
    for seq in range(220):
        bits = list(r.choice(bases))
        for i in r.sample(range(64), r.choice([0, 0, 1, 2, 5])):
            bits[i] = "10"[int(bits[i])]
        name = f"{r.randrange(10**6):06d}"
        rows.append((seq, name, "".join(bits) if r.random() < 0.95 else None))
    rows += [(300 + i, n, b) for i, (_, n, b) in enumerate(r.sample(rows, 40))]
    known = {n + "k": b for _, n, b in r.sample(rows, 30)} | {rows[7][1]: rows[7][2]}
    seen = spark.createDataFrame([(s, n, b, None) for s, n, b in rows] + [(500, "bad", None, "malformed_png"), (501, "bad", None, "malformed_png")], "seq long, sha256 string, perceptual_hash string, reason string")
    old = spark.createDataFrame(list(known.items()), "sha256 string, perceptual_hash string")
    for before, start in ((None, {}), (old, dict(known))):
        got = {x.seq: x for x in media.decide(seen, before, limits, most).collect()}
        assert len(got) == len(rows) + 2
        want = fold(rows, 3, start)
        assert {s: (x.reason, x.duplicate_of, x.near_duplicate_of) for s, x in got.items() if s < 500} == want
        assert [(got[s].status, got[s].reason, got[s].first) for s in (500, 501)] == [("quarantined", "malformed_png", True), ("quarantined", "malformed_png", False)]


@pytest.mark.parametrize("limit, most", [(8, None), (4, 3)])
def test_far_searches_equal_a_fold(spark, limit, most):
    """Close, far and too far pictures, with known ones, in sparse and in crowded values."""
    r, limits = random.Random(8), media.Limits(near_distance=limit)
    bases = ["".join(r.choice("01") for _ in range(64)) for _ in range(12)]
    rows = []
    for seq in range(160):
        bits = list(r.choice(bases))
        for i in r.sample(range(64), r.choice([0, 1, 2, 3, 4, 5, 6, 8, 9, 14])):
            bits[i] = "10"[int(bits[i])]
        rows.append((seq, f"{r.randrange(10**6):06d}", "".join(bits)))
    known = {n + "k": b for _, n, b in r.sample(rows, 15)}
    seen = spark.createDataFrame([(*x, None) for x in rows], "seq long, sha256 string, perceptual_hash string, reason string")
    old = spark.createDataFrame(list(known.items()), "sha256 string, perceptual_hash string")
    got = {x.seq: (x.reason, x.duplicate_of, x.near_duplicate_of) for x in media.decide(seen, old, limits, most).collect()}
    assert got == fold(rows, limit, dict(known))


def test_the_far_search_meets_few(spark, monkeypatch):
    """3,000 unlike pictures: a pair of 7-bit bands each would meet 316,000 times; the far search lists values of 21 bits."""
    r, met = random.Random(9), []
    whole = media._pairs
    monkeypatch.setattr(media, "_pairs", lambda b, asked, known, limit: met.append(asked.select(*b.place).join(known.select(*b.place), b.place).count()) or whole(b, asked, known, limit))
    rows = [(i, f"{i:05d}", f"{r.getrandbits(64):064b}") for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, sha256 string, bits string")
    assert media.near_earlier(df, 8).count() == 0 and sum(met) < 50_000


def test_batches_store_each_content_once(spark, tmp_path):
    root, at = str(tmp_path / "media"), lambda v: png(8, 8, [b"\0" + bytes([v + (y > 3) * 200] * 8) for y in range(8)])
    first = frame(spark, [(at(0), "image/png"), (at(0), None), (b"x", None), (at(1), "audio/wav")])
    assert media.ingest(spark, root, 0, first) and not media.ingest(spark, root, 0, first.limit(0))
    second = frame(spark, [(at(1), None), (at(0), None)])
    # a folder without a commit is not read and is written anew
    (tmp_path / "media" / "batch=1").mkdir()
    assert media.ingest(spark, root, 1, second)
    got = [(x.batch, x.seq, x.status, x.reason, x.content is not None) for x in media.items(spark, root).orderBy("batch", "seq").collect()]
    assert got == [
        (0, 0, "accepted", None, True), (0, 1, "accepted", "exact_duplicate", False), (0, 2, "quarantined", "unrecognized_signature", True), (0, 3, "quarantined", "mime_signature_mismatch", True),
        (1, 0, "accepted", "near_duplicate", True), (1, 1, "accepted", "exact_duplicate", False),
    ]
    kept = media.objects(spark, root).filter("batch = 1").first()
    assert bytes(kept.content) == at(1) and kept.near_duplicate_of == media.objects(spark, root).filter("batch = 0").first().sha256
    assert media.objects(spark, root).filter(F.sha2("content", 256) != F.col("sha256")).count() == 0
