"""Exact substring dedup: common-prefix interval trees over a sparse, enhanced suffix array.

Every byte covered by a 100-byte string that also starts earlier goes. Sorting all suffixes of a corpus would move many
times its size, so the suffix array holds *anchors* only: each 100-byte window picks, among the 32-byte grams in it, the
one with the smallest hash (the right-most of equal ones). Equal windows pick equal anchors, so comparing the
surroundings of equal anchors finds every repeat of 100 bytes. An anchor stands for a run of windows.

1. Scan: anchors of whole documents in numpy. Occurrences whose whole surroundings agree (64-bit gram hash and an
   independent 64-bit hash of the run) collapse per task; all but the first are covered at once.
2. By gram: the same across tasks. Grams left with several different surroundings ask for their bytes.
3. The bytes of those surroundings, cut from the documents, form the suffix array of each gram: suffixes sorted, common
   prefixes of neighbours, a stack scan over them for the interval tree. In every interval the left contexts are sorted
   and scanned the same way, and a group is kept where it is diverse on both sides (a maximal repeat, with all its
   occurrences). All but the earliest occurrence are covered.
4. Covered ranges meet their documents.

A gram that a bounded sample of documents shows in many of them (a common line) would gather many different surroundings
in one group; its windows are keyed one by one by their own 100 bytes instead, which pre-aggregates and spreads. Step 2
knows the exact number of surroundings: grams that the sample missed and that have more than ``MANY`` take the same way,
so no group of step 3 is larger. Both ways are exact.

Defined results: null text is empty; texts under 100 bytes lose nothing; rows that repeat a document get its result each;
rows without an id lose nothing and remove nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import bounded_sample, table

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Windows handled at a time, and anchors that a task gathers before it collapses them.
CHUNK, FLUSH = 1 << 20, 400_000
#: Documents in the sample for common grams, and how many of them a common gram shows in.
SAMPLE_DOCS, COMMON = 5_000, 5
#: Different surroundings of one gram that are compared as a suffix array; grams with more go by single windows.
MANY = 1_000
_LOW = np.uint64((1 << 21) - 1)
_U = np.uint64


class RollingHash:
    """Polynomial hash of any substring in constant time: prefix sums with powers of an odd base modulo 2^64."""

    def __init__(self, seed: int):
        r = np.random.RandomState(seed)
        self.table = r.randint(0, 1 << 62, 256, dtype=np.uint64) * _U(4) + r.randint(0, 4, 256).astype(np.uint64)
        self.base = int(r.randint(1 << 40, 1 << 61)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.power = self.back = np.ones(1, np.uint64)

    def prefix(self, b: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(b):
            n = 1 << int(len(b) + 1).bit_length()
            self.power = np.cumprod(np.concatenate([[_U(1)], np.full(n, self.base % (1 << 64), np.uint64)]))
            self.back = np.cumprod(np.concatenate([[_U(1)], np.full(n, self.inverse, np.uint64)]))
        out = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.power[: len(b)], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, start, end) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.back[start])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


_GRAMS, _RUNS = RollingHash(1), RollingHash(2)


def anchors(text: bytes):
    """Arrays per anchor of a document: gram hash, run hash, gram start, first and last window start."""
    out = []
    whole = np.frombuffer(text, np.uint8)
    for c in range(0, len(whole) - LENGTH + 1, CHUNK):
        b = whole[c : c + CHUNK + LENGTH - 1]
        p1, p2 = _GRAMS.prefix(b), _RUNS.prefix(b)
        n = len(b) - GRAM + 1
        g = mix((p1[GRAM:] - p1[:n]) * _GRAMS.back[:n])
        m = (g & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
        width = 1
        while width * 2 <= SPAN:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: len(m) - (SPAN - width)], m[SPAN - width :])
        at = (_LOW - (m & _LOW)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        q = at[first]
        run = _RUNS.at(p2, first, last + LENGTH) ^ mix(((q - first) * 128 + (last - first)).astype(np.uint64) + _U(1))
        out.append((g[q], run, q + c, first + c, last + c, p1, p2, c))
    return out


def _windows(part, common: np.ndarray):
    """Anchors with common grams replaced by their single windows."""
    key, run, q, lo, hi, p1, p2, c = part
    if not len(common):
        return key, run, q, lo, hi
    hot = np.isin(key, common)
    if not hot.any():
        return key, run, q, lo, hi
    n = hi[hot] - lo[hot] + 1
    s = np.repeat(lo[hot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    k2 = _GRAMS.at(p1, s - c, s - c + LENGTH) ^ _U(0x5851F42D4C957F2D)
    r2 = _RUNS.at(p2, s - c, s - c + LENGTH)
    cold = ~hot
    return tuple(np.concatenate([a, b]) for a, b in zip((key[cold], run[cold], q[cold], lo[cold], hi[cold]), (k2, r2, s, s, s)))


def merge(ranges: np.ndarray) -> np.ndarray:
    """Union of [start, end) rows."""
    if len(ranges) < 2:
        return ranges
    r = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    end = np.maximum.accumulate(r[:, 1])
    new = np.concatenate([[True], r[1:, 0] > end[:-1]])
    return np.c_[r[new, 0], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(r) - 1]])]]


def _pack(arrays) -> bytes:
    key, run, doc, q, lo, hi = arrays
    ids, at = np.unique(doc, return_inverse=True)
    head = np.array([len(key), len(ids)], np.int64).tobytes()
    body = [key.astype("<u8"), run.astype("<u8"), ids.astype("<i8"), np.diff(at, prepend=0).astype("<i4"), q.astype("<i4"), (q - lo).astype("<i2"), (hi - lo).astype("<i2")]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in body))


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for kind, size in (("<u8", n), ("<u8", n), ("<i8", m), ("<i4", n), ("<i4", n), ("<i2", n), ("<i2", n)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    key, run, ids, step, q, back, width = out
    lo = q.astype(np.int64) - back
    return key, run, ids[np.cumsum(step)], q.astype(np.int64), lo, lo + width


def _collapse(key, run, doc, q):
    """Order by class, marks of the first of each (gram, run) class, and of those that another document position precedes."""
    order = np.lexsort((q, doc, run, key))
    k, r, d, p = key[order], run[order], doc[order], q[order]
    first = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    later = (d != d[head]) | (p != p[head])
    return order, first, later


def _gathered(parts, buckets: int) -> list[tuple]:
    """What a task has gathered, as (bucket, id, covered ranges) of repeats within it and (bucket, null, packed first occurrences)."""
    key, run, doc, q, lo, hi = (np.concatenate(x) for x in zip(*parts))
    order, first, later = _collapse(key, run, doc, q)
    rest = order[later]
    rows = []
    if len(rest):
        rest = rest[np.argsort(doc[rest], kind="stable")]
        ids, at = np.unique(doc[rest], return_index=True)
        for i, own in zip(ids.tolist(), np.split(rest, at[1:])):
            rows.append((i % buckets, i, merge(np.c_[lo[own], hi[own] + LENGTH]).astype("<i8").tobytes()))
    keep = order[first]
    home = (key[keep] % _U(buckets)).astype(np.int64)
    keep = keep[np.lexsort((q[keep], doc[keep], home))]
    home = (key[keep] % _U(buckets)).astype(np.int64)
    at = np.flatnonzero(np.diff(home, prepend=-1))
    for own, b in zip(np.split(keep, at[1:]), home[at].tolist()):
        rows.append((b, None, _pack((key[own], run[own], doc[own], q[own], lo[own], hi[own]))))
    return rows


def _scan(buckets: int, common):
    def run_task(batches):
        hot, parts, held = common.value, [], 0

        def flush():
            return pd.DataFrame(_gathered(parts, buckets), columns=["bucket", "doc_id", "data"]).astype({"doc_id": "Int64"})

        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                if text is None or pd.isna(i) or len(text) * 4 < LENGTH:
                    continue
                for part in anchors(text.encode("utf-8", "surrogatepass")):
                    key, run, q, lo, hi = _windows(part, hot)
                    parts.append((key, run, np.full(len(key), int(i), np.int64), q, lo, hi))
                    held += len(key)
                if held >= FLUSH:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return run_task


#: What a row asks of its document: nothing (a covered range), its bytes, or its single windows.
_DONE, _BYTES, _WINDOWS = 0, 1, 2


def _resolve(many: int):
    def run_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        """One bucket of grams: classes across tasks; covered ranges and occurrences that ask for their bytes or windows."""
        done = pdf["doc_id"].notna()
        out = []
        for i, blob in zip(pdf["doc_id"][done], pdf["data"][done]):
            r = np.frombuffer(blob, "<i8").reshape(-1, 2)
            out.append(pd.DataFrame({"doc_id": np.int64(i), "asks": _DONE, "key": 0, "q": 0, "a": r[:, 0], "b": r[:, 1]}))
        blobs = pdf["data"][~done]
        if len(blobs):
            key, run, doc, q, lo, hi = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
            order, first, later = _collapse(key, run, doc, q)
            rest = order[later]
            out.append(pd.DataFrame({"doc_id": doc[rest], "asks": _DONE, "key": 0, "q": 0, "a": lo[rest], "b": hi[rest] + LENGTH}))
            reps = order[first]
            _, inverse, n = np.unique(key[reps], return_inverse=True, return_counts=True)
            n = n[inverse]
            ask, n = reps[n > 1], n[n > 1]
            out.append(pd.DataFrame({"doc_id": doc[ask], "asks": np.where(n > many, _WINDOWS, _BYTES), "key": key[ask].view(np.int64), "q": q[ask], "a": lo[ask], "b": hi[ask] + LENGTH}))
        return pd.concat(out, ignore_index=True)

    return run_bucket


def _single_windows(raw: bytes, doc: int, a: int, b: int):
    """Every window of raw[a:b] under a key of its own bytes."""
    part = np.frombuffer(raw[a:b], np.uint8)
    s = np.arange(len(part) - LENGTH + 1)
    key = _GRAMS.at(_GRAMS.prefix(part), s, s + LENGTH)
    run = _RUNS.at(_RUNS.prefix(part), s, s + LENGTH)
    return key, run, np.full(len(s), doc, np.int64), s + a, s + a, s + a


#: Marks in column ``back`` of rows that are no surroundings.
_RANGES, _PACKED = -1, -2


def _surroundings(buckets: int):
    columns = ["bucket", "doc_id", "key", "q", "back", "data"]

    def marked(parts):
        return [(bucket, i, 0, 0, _PACKED if i is None else _RANGES, data) for bucket, i, data in _gathered(parts, buckets)]

    def run_task(batches):
        parts, held = [], 0
        for pdf in batches:
            rows = []
            for i, text, asked in zip(pdf["doc_id"], pdf["text"], pdf["asked"]):
                # nothing is asked of rows without an id
                if asked is None or not len(asked):
                    continue
                raw, covered = (text or "").encode("utf-8", "surrogatepass"), []
                for r in asked:
                    key, a, b = r["key"], r["a"], r["b"]
                    if r["asks"] == _DONE:
                        covered.append((a, b))
                    elif r["asks"] == _BYTES:
                        rows.append((key % buckets, i, key, r["q"], r["q"] - a, raw[a:b]))
                    else:
                        parts.append(_single_windows(raw, int(i), a, b))
                        held += len(parts[-1][0])
                if covered:
                    rows.append((i % buckets, i, 0, 0, _RANGES, merge(np.array(covered, np.int64)).tobytes()))
            if held >= FLUSH:
                rows += marked(parts)
                parts, held = [], 0
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
        if parts:
            yield pd.DataFrame(marked(parts), columns=columns).astype({"doc_id": "Int64"})

    return run_task


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int = 0):
    """Stack scan: (length, first, last) of every common-prefix interval over neighbours' common prefixes."""
    stack: list[tuple[int, int]] = []
    for i, h in enumerate([*lcp, -1], 1):
        left = i - 1
        while stack and stack[-1][0] > h:
            top, left = stack.pop()
            if top >= least:
                yield top, left, i - 1
        if h >= 0 and (not stack or stack[-1][0] < h):
            stack.append((h, left))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int):
    """(left extent, right extent, members) of every group of occurrences that agree on at least ``length`` bytes around
    their anchor and differ, or end, on both sides. ``lefts`` are reversed."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    for right, lo, hi in intervals(lcp, length - max(map(len, lefts))):
        # children: stretches whose neighbours share more than the interval does
        child, n = {order[lo]: 0}, 0
        for k in range(lo, hi):
            n += lcp[k] <= right
            child[order[k + 1]] = n
        by_left = sorted(order[lo : hi + 1], key=lefts.__getitem__)
        lcs = [common_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])]
        for left, first, last in intervals(lcs, length - right):
            members = by_left[first : last + 1]
            if len({child[m] for m in members}) > 1:
                yield left, right, members


def _repeat_ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ranges that an earlier occurrence covers, per document."""
    done, packed = pdf["back"] == _RANGES, pdf["back"] == _PACKED
    rows = [(int(i), bytes(d)) for i, d in zip(pdf["doc_id"][done], pdf["data"][done])]
    covered: dict[int, list[tuple[int, int]]] = {}
    if packed.any():
        key, run, doc, q, lo, hi = (np.concatenate(x) for x in zip(*map(_unpack, pdf["data"][packed])))
        order, _, later = _collapse(key, run, doc, q)
        for k in order[later].tolist():
            covered.setdefault(int(doc[k]), []).append((int(lo[k]), int(hi[k]) + LENGTH))
    for _, own in pdf[~done & ~packed].groupby("key", sort=False):
        if len(own) < 2:
            continue
        own = own.sort_values(["doc_id", "q"])
        docs, at = own["doc_id"].tolist(), own["q"].tolist()
        lefts = [d[:n][::-1] for d, n in zip(own["data"], own["back"])]
        rights = [d[n:] for d, n in zip(own["data"], own["back"])]
        for left, right, members in maximal_repeats(lefts, rights, LENGTH):
            earliest = min(members)
            for m in members:
                if m != earliest:
                    covered.setdefault(docs[m], []).append((at[m] - left, at[m] + right))
    rows += [(i, merge(np.array(r, np.int64)).tobytes()) for i, r in covered.items()]
    return pd.DataFrame(rows, columns=["doc_id", "data"])


def _finish(batches):
    for pdf in batches:
        out = []
        for i, text, found in zip(pdf["doc_id"], pdf["text"], pdf["found"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            r = np.empty((0, 2), np.int64)
            if found is not None and len(found):
                r = merge(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in found]))
                r = np.minimum(r, len(raw))
                r = r[r[:, 1] > r[:, 0]]
            sha, at, removed = hashlib.sha256(), 0, 0
            for a, b in r.tolist():
                sha.update(raw[at:a])
                at, removed = b, removed + b - a
            sha.update(raw[at:])
            out.append((i, len(raw), removed, len(r), sha.hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def common_grams(docs: DataFrame, sample: int = SAMPLE_DOCS, least: int = COMMON) -> np.ndarray:
    """Hashes of anchors that a bounded sample of documents shows in at least ``least`` different surroundings."""

    def keys(batches):
        for pdf in batches:
            got = [np.c_[p[0].view(np.int64), p[1].view(np.int64)] for t in pdf["text"] if t and len(t) * 4 >= LENGTH for p in anchors(t.encode("utf-8", "surrogatepass"))]
            yield pd.DataFrame(np.unique(np.concatenate(got), axis=0) if got else np.empty((0, 2), np.int64), columns=["key", "run"])

    found = bounded_sample(docs, "doc_id", sample).select("text").mapInPandas(keys, "key long, run long").distinct()
    return np.array([r["key"] for r in found.groupBy("key").count().filter(F.col("count") >= least).collect()], np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(64, 4 * docs.rdd.getNumPartitions())
    common = spark.sparkContext.broadcast(common_grams(docs))
    scanned = docs.mapInPandas(_scan(buckets, common), "bucket int, doc_id long, data binary")
    resolved = scanned.groupBy("bucket").applyInPandas(_resolve(many), "doc_id long, asks int, key long, q long, a long, b long")
    asked = resolved.groupBy("doc_id").agg(F.collect_list(F.struct("asks", "key", "q", "a", "b")).alias("asked"))
    cut_out = docs.join(asked, "doc_id", "left").mapInPandas(_surroundings(buckets), "bucket int, doc_id long, key long, q long, back int, data binary")
    ranges = cut_out.groupBy("bucket").applyInPandas(_repeat_ranges, "doc_id long, data binary")
    found = ranges.groupBy("doc_id").agg(F.collect_list("data").alias("found"))
    return docs.join(found, "doc_id", "left").mapInPandas(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
