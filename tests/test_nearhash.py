"""Near hashes against all pairs, in sparse and in crowded bands."""

from __future__ import annotations

import random

import pytest

from evifuse.operators import nearhash


def apart(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b))


def crowd(r: random.Random, n: int, bits: int, band: int) -> list[str]:
    """A third of the strings share their first ``band`` positions; some repeat, some lie a few flips from another."""
    some = lambda k: "".join(r.choice("01") for _ in range(k))
    head = some(band)
    out = [head + some(bits - band) if i % 3 == 0 else some(bits) for i in range(n)]
    for i in range(n // 2):
        s = list(r.choice(out))
        for j in r.sample(range(bits), r.randint(0, 5)):
            s[j] = "10"[int(s[j])]
        out.append("".join(s))
    return out


@pytest.mark.parametrize("bits, limit, most", [(64, 4, 20), (64, 4, 0), (64, 4, None), (40, 3, 5), (24, 6, 3), (8, 0, 0), (70, 1, 3)])
def test_nearest_in_crowded_bands(spark, bits, limit, most):
    r = random.Random(bits + limit)
    rows = list(enumerate(crowd(r, 120, bits, round(bits / (limit + 1)))))
    r.shuffle(rows)
    want = {}
    for i, a in rows:
        near = min((apart(a, b), j) for j, b in rows if j != i)
        if near[0] <= limit:
            want[i] = near
    got = nearhash.near_duplicate_hashes(spark.createDataFrame(rows, "id long, bits string"), limit, bits, most).collect()
    assert len(got) == len(want) and {x.id: (x.distance, x.nearest) for x in got} == want


def test_positions_that_never_differ_belong_to_no_band(spark):
    """24 of 64 bits differ: five bands of them while few hashes come, none once they crowd every band."""
    r = random.Random(9)
    codes = [r.getrandbits(24) for _ in range(60)] + [0, 0xFFFFFF]
    words = spark.createDataFrame([(0, c) for c in codes], "w0 long, w1 long")
    few, many = nearhash.Bands.of(64, 4, words), nearhash.Bands.of(64, 4, words, most=1)
    assert [p for b in few.bands for p in b] == few.vary == list(range(40, 64)) and few.listed == 211
    assert many.bands == [[]] and many.listed == 301 and nearhash.Bands(64, 4).listed == 1379
    rows = [(i, f"{c:016x}") for i, c in enumerate(codes)]
    want = {i: min(j for j, b in enumerate(codes) if (a ^ b).bit_count() <= 4) for i, a in enumerate(codes)}
    seen = spark.createDataFrame(rows, "observation_id long, perceptual_hash string").selectExpr("observation_id", "'' AS exact_hash", "perceptual_hash")
    for most in (None, 1):
        got = nearhash.first_duplicates(seen, seen.withColumnRenamed("observation_id", "ordinal"), most=most).collect()
        assert {x.observation_id: x.ordinal for x in got} == want
    assert nearhash.Bands.of(64, 4, words.limit(0)).vary == [] and nearhash.Bands.of(64, 4, words.limit(1)).vary == []


def test_odd_hashes(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "01"), (6, "0" * 64), (7, "0" * 63 + "x")]
    got = nearhash.near_duplicate_hashes(spark.createDataFrame(rows, "id long, bits string"))
    assert {x.id: (x.nearest, x.distance) for x in got.collect()} == {3: (4, 0), 4: (3, 0)}
    assert nearhash.near_duplicate_hashes(spark.createDataFrame([], "id long, bits string")).count() == 0


@pytest.mark.parametrize("most", [0, 10, None])
def test_first_duplicates(spark, most):
    r = random.Random(5)
    codes = [f"{int(s, 2):016x}" for s in crowd(r, 90, 64, 13)] + ["ff00", "FF01", "", None, "not hex"]
    row = lambda i: (i, r.choice(["a", "b", "", None, f"h{i % 40}"]) if i % 5 == 0 else f"x{i}", r.choice(codes))
    seen, known = [row(i) for i in range(100)], [row(1000 + i) for i in range(120)]
    r.shuffle(known)

    def bits(h):
        return f"{int(h, 16):064b}" if h and len(h) <= 16 and all(c in "0123456789abcdefABCDEF" for c in h) else None

    want = {}
    for i, e, p in seen:
        for o, f, q in sorted(known, key=lambda k: k[0]):
            d = apart(bits(p), bits(q)) if bits(p) and bits(q) else None
            if (e and e == f) or (d is not None and d <= 4):
                want[i] = (o, d)
                break
    got = nearhash.first_duplicates(spark.createDataFrame(seen, "observation_id long, exact_hash string, perceptual_hash string"), spark.createDataFrame(known, "ordinal long, exact_hash string, perceptual_hash string"), most=most).collect()
    assert want and len(got) == len(want) and {x.observation_id: (x.ordinal, x.distance) for x in got} == want
