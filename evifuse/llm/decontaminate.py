"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and white space collapses to one blank. An item of m characters gets a budget of
e = m * ERROR_RATE edits and is split into e + 1 pieces: a passage within the budget keeps at least one piece exactly.
An Aho-Corasick automaton finds the pieces in whole documents. The same argument holds for any run of p pieces with
p - 1 edits, so a hit is verified upwards, over runs of pieces that double, each by Myers' bit-parallel distance; the
whole item decides.

The test set is broadcast in blocks of ``BLOCK_CHARS`` characters, one automaton each. A single block is matched in
place; with more, every block is a branch of its own over the documents, so a task holds one automaton at a time, and
what is found meets the documents by the hash of their texts.

Defined results: null or empty documents match nothing; items that are null or without a character after normalising
are not searched; an item too short for any edit (under 1 / ERROR_RATE characters) must stand between characters that
are no letters or digits; repeated items match each; rows without an id and repeated rows match like others; columns of
any name stay; an empty table gives no rows. The best match of a document and item is the smallest distance, then the first end,
then the last start, in normalised characters.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import boxed, cut, join_skewed, table, unboxed

ERROR_RATE = 0.1
#: Characters of test items in one broadcast.
BLOCK_CHARS = 1_000_000
MATCH = "array<struct<item_id:long,distance:int,start:int>>"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


@lru_cache(4096)
def _masks(item: str) -> dict[str, int]:
    """For every character the places it has in the item, as bits."""
    eq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        eq[c] |= 1 << i
    return dict(eq)


def myers(item: str, window: str, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """(smallest distance of the item to any substring, its first end) if that is at most ``most``; ``anchored`` substrings start where the window does."""
    m = len(item)
    full, top, first = (1 << m) - 1, 1 << (m - 1), int(anchored)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = _masks(item).get
    for j, c in enumerate(window, 1):
        e = get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 | first
        mh = mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j
    return (best, end) if best <= most else None


class Matcher:
    """Piece automaton over a block of items (item_id, normalised text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        self.cuts = [[len(t) * n // (e + 1) for n in range(e + 2)] for _, t, e in self.items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t, e) in enumerate(self.items):
            for n in range(e + 1):
                pieces[t[self.cuts[k][n] : self.cuts[k][n + 1]]].append((k, n))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def _runs(self, piece: int, count: int):
        """Runs of pieces that hold the piece, from two or three up to all but the whole."""
        lo, hi, out = 0, count, []
        while hi - lo > 1:
            out.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        return out[:0:-1]

    def _passes(self, t: str, k: int, piece: int, at: int) -> bool:
        """Whether every run around a piece found at ``at`` stays within its budget, one edit less than it has pieces."""
        _, item, e = self.items[k]
        cuts = self.cuts[k]
        for lo, hi in self._runs(piece, e + 1):
            most, start = hi - lo - 1, at - cuts[piece]
            if not myers(item[cuts[lo] : cuts[hi]], t[max(0, start + cuts[lo] - most) : start + cuts[hi] + most], most):
                return False
        return True

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """Best (item_id, distance, start) for each item found; start counts normalised characters."""
        if not text or not self.any:
            return []
        t = normalise(text)
        best: dict[int, tuple[int, int]] = {}
        tried = set()
        for last, (size, where) in self.automaton.iter(t):
            for k, n in where:
                _, item, e = self.items[k]
                at = last + 1 - size
                s = at - self.cuts[k][n]
                if k in best and best[k][0] == 0 or (k, s) in tried:
                    continue
                if s >= 0 and t.startswith(item, s):
                    end = s + len(item)
                    if e or not (t[s - 1 : s].isalnum() and s or t[end : end + 1].isalnum()):
                        best[k] = (0, end)
                    continue
                if not e or not self._passes(t, k, n, at):
                    continue
                tried.add((k, s))
                a = max(0, s - e)
                hit = myers(item, t[a : s + len(item) + e], e)
                if hit:
                    best[k] = min(best.get(k, (e + 1, 0)), (hit[0], a + hit[1]))
        out = []
        for k, (d, end) in sorted(best.items()):
            i, item, e = self.items[k]
            # the last start that gives this distance: the first end in the reversed text
            size = myers(item[::-1], t[max(0, end - len(item) - e) : end][::-1], e, anchored=True)[1]
            out.append((i, d, end - size))
        return out


def blocks(spark: SparkSession, items: DataFrame, block_chars: int = BLOCK_CHARS):
    """Broadcasts of the test set, read in order of id by a local iterator: one block in the driver at a time."""
    now, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().orderBy("item_id", "text").toLocalIterator():
        t = normalise(r[1])
        if not t:
            continue
        now.append((r[0], t))
        size += len(t)
        if size >= block_chars:
            yield spark.sparkContext.broadcast(now)
            now, size = [], 0
    if now:
        yield spark.sparkContext.broadcast(now)


def matches_column(block, rate: float = ERROR_RATE):
    """Column function: text -> matches with one block of items."""
    kept: dict = {}

    @F.pandas_udf(MATCH)
    def find(texts: pd.Series) -> pd.Series:
        if "m" not in kept:
            kept["m"] = Matcher(block.value, rate)
        return pd.Series([[{"item_id": i, "distance": d, "start": s} for i, d, s in kept["m"].find(t)] for t in texts], dtype=object)

    return find


def with_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, matches): every row of ``docs`` as a struct, with an array of matches by item_id."""
    rows = boxed(docs, text=F.col(text).cast("string"))
    parts = list(blocks(spark, items, block_chars))
    if len(parts) < 2:
        return rows.select("row", (matches_column(parts[0])("text") if parts else F.array().cast(MATCH)).alias("matches"))
    rows = rows.withColumn("key", F.sha2("text", 256))
    texts = docs.select(F.col(text).cast("string").alias("text"))
    found = None
    for b in parts:
        own = texts.select(F.sha2("text", 256).alias("key"), matches_column(b)("text").alias("m")).filter(F.size("m") > 0)
        own = own.groupBy("key").agg(F.first("m").alias("m"), F.count("*").alias("n"))
        found = own if found is None else found.union(own)
    found = cut(found.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("m"))).alias("m"), F.max("n").alias("n")))
    return join_skewed(rows, found, "key", rows.count(), "left").select("row", F.coalesce("m", F.array().cast(MATCH)).alias("matches"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_matches(spark, docs, table(spark, sf_dir, "benchmark")).select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.start")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return unboxed(with_matches(spark, docs, table(spark, sf_dir, "benchmark")).filter(F.size("matches") == 0), docs.columns)
