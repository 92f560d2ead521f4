"""SimHash near-dedup with pigeonring candidate filtering.

A fingerprint has 64 bits; bit b is set if it is set in over half of the XXH64 values (seed 42) of the word shingles.
Equal fingerprints collapse first, so copies never meet in pairs. With m = 5 segments in a ring and a budget of t = 2
bits, two fingerprints within the budget have a start i such that every chain of l segments from i differs in at most
l*t/m bits: chains of 1 and 2 segments differ in none. So the candidates share two neighbouring segments (26 bits), and
must keep chains of 3 and 4 segments within 1 bit before the full distance is taken.

Buckets of a key with more than ``BUCKET`` fingerprints take an exact way without pairs: two fingerprints are within 2
bits just if some value lies within 1 bit of both, so each member lists itself and its one-bit neighbours outside the
key, and members that list the same value (65 at most) are linked to the smallest of them.

Defined results: null or wordless text has fingerprint 0 and links like any other; texts with fewer words than a shingle
hash their whole word sequence; a text of any length is hashed whole, in pieces; repeated rows share a component; an
empty table gives no rows; rows without an id keep their fingerprint and get their group's component (null if no member
has an id); other columns of any name play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import boxed, connected_components, cut, join_skewed, table, unboxed

SEGMENTS = 5
BUDGET = 2
#: Larger buckets use the neighbour listing instead of pairs.
BUCKET = 64
_EDGES = [round(64 * i / SEGMENTS) for i in range(SEGMENTS + 1)]
_MASKS = [((1 << _EDGES[i + 1]) - 1) ^ ((1 << _EDGES[i]) - 1) for i in range(SEGMENTS)]
#: The longest chain whose share of the budget is under one bit.
KEY_CHAIN = max(n for n in range(1, SEGMENTS) if n * BUDGET // SEGMENTS == 0)
_STEP = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return h(joined, 42)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(parts) - words + 1], end[words - 1 :]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), _STEP):
        values = np.array([h(joined[a:b], 42) for a, b in zip(first[i : i + _STEP].tolist(), last[i : i + _STEP].tolist())], dtype="<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprint_column(words: int = 3):
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return fp


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain_masks() -> list[list[int]]:
    """For each start, the masks of chains that are longer than the key."""
    out = []
    for i in range(SEGMENTS):
        masks, m = [], 0
        for n in range(1, SEGMENTS):
            m |= _MASKS[(i + n - 1) % SEGMENTS]
            if n > KEY_CHAIN:
                masks.append((n * BUDGET // SEGMENTS, m))
        out.append(masks)
    return out


def _key_mask(i: int) -> int:
    return sum(_MASKS[(i + n) % SEGMENTS] for n in range(KEY_CHAIN))


def _count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _links(batches):
    """Candidates of each small bucket: chain checks, then the full distance; a star for each group found in the bucket."""
    chains = [[(most, np.uint64(m)) for most, m in row] for row in _chain_masks()]
    for pdf in batches:
        a_out, b_out = [], []
        for i, members in zip(pdf["i"], pdf["members"]):
            x = np.sort(np.asarray(members, dtype=np.int64)).view(np.uint64)
            diff = x[:, None] ^ x[None, :]
            ok = np.triu(np.ones(diff.shape, bool), 1)
            for most, m in chains[int(i)]:
                ok &= _count_bits(diff & m) <= most
            ok &= _count_bits(diff) <= BUDGET
            p, q = np.nonzero(ok)
            root = list(range(len(x)))
            for u, v in zip(p.tolist(), q.tolist()):
                while root[u] != u:
                    u = root[u]
                while root[v] != v:
                    v = root[v]
                root[max(u, v)] = min(u, v)
            s = x.view(np.int64)
            for u in range(len(x)):
                if root[u] != u:
                    a_out.append(s[u])
                    b_out.append(s[root[u]])
        yield pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join exactly the groups of the relation "within 2 bits"."""
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(_key_mask(i)))).alias("k")) for i in range(SEGMENTS)])
    keyed = distinct.select("fp", F.explode(keys).alias("s")).select("fp", "s.i", "s.k")
    sizes = keyed.groupBy("i", "k").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["i", "k"]))
    small = shared.filter(F.col("n") <= BUCKET).groupBy("i", "k").agg(F.collect_list("fp").alias("members"))
    found = small.select("i", "members").mapInPandas(_links, "a long, b long")
    large = shared.filter(F.col("n") > BUCKET).select("fp", "i")
    free = F.array(*[F.struct(F.lit(i).alias("i"), F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64) if not _key_mask(i) >> b & 1]).alias("flips")) for i in range(SEGMENTS)])
    near = large.select("fp", F.explode(F.element_at(free, F.col("i") + 1)["flips"]).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    met = near.groupBy("z").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    stars = met.select(F.array_min("members").alias("b"), F.explode("members").alias("a")).filter("a <> b").select("a", "b")
    return found.union(stars).distinct()


def components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    fps = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(words)(F.col("text").cast("string")).alias("fp")))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    joined = connected_components(links(groups.select("fp")))
    low = groups.join(joined, groups["fp"] == joined["node"]).groupBy("component").agg(F.min("first").alias("low"), F.count("*").alias("n"))
    of = join_skewed(joined, low, "component", joined.count()).select(F.col("node").alias("fp"), "low")
    named = cut(groups.join(of, "fp", "left").select("fp", "n", F.coalesce("low", "first").alias("component_id")))
    return join_skewed(fps, named, "fp", fps.count()).select("doc_id", "fp", "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Rows that repeat an id count once, with the least of their texts; rows without an id stay. Fingerprints and groups
    carry ids only; the last join moves each text once.
    """
    once = docs
    if docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").limit(1).count():
        first = boxed(docs.filter("doc_id is not null"), doc_id=F.col("doc_id"), order=F.struct(F.col("text"), F.to_json(F.struct("*"))))
        first = first.groupBy("doc_id").agg(F.min_by("row", "order").alias("row"))
        once = unboxed(first, docs.columns).union(docs.filter("doc_id is null"))
    drop = components(once).filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return once.join(drop, "doc_id", "left_anti").select(*docs.columns)
