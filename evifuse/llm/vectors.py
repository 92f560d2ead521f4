"""Embedding near-dedup with a random-projection tree forest.

Equal vectors of a label collapse first. Each tree splits a node with more vectors than a leaf holds at random: the vectors
are projected on a random direction of that tree and depth, and those within ``MARGIN`` of the cut go to both children
(spill). The margin is a distance, set from how far the projections of two vectors at the threshold lie apart, so a node
of near copies does not lose its pairs as it grows: where the margin would hold too large a share of the vectors, the
node stays whole. Counts and quantiles are aggregates, so no node is gathered before it is small; a whole node with more
than ``CELL`` vectors is compared exactly in cells of two blocks each, spread over tasks. Deeper trees come in larger
numbers. A pair counts in the first leaf that it shares, so leaves emit one row per vector and cell, never pairs.

Defined results: vectors that are null, zero, of another width than most, or hold null or non-finite components, and
vectors without a label, link with nothing; copies link with each other; rows without an id get null components; an
empty table gives no rows; repeated rows count as copies; other columns of any name play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import connected_components, cut, table

THRESHOLD = 0.93
TREES = 6
#: A leaf holds at most ``LEAF`` vectors, and in a smaller label at most 1/``SPLITS`` of them but ``LEAST`` anyway, so the
#: forest works alike in small labels and large ones.
LEAF, SPLITS, LEAST = 4096, 16, 48
#: Half the width of the spill as a share of the distance between unit vectors at the threshold, which is also the
#: standard deviation of the difference of their projections.
MARGIN = 0.535
#: Largest share of a node in its spill: nodes up to ``EXACT`` vectors that would exceed the first stay whole, larger ones
#: those that would exceed the second.
SPREAD, WIDEST, EXACT = 0.2, 0.4, 32_768
#: Vectors in a block of the exact comparison of a node.
CELL = 16_384
#: Share of pairs at the threshold that a level may part, and that all trees together may miss; sets the number of trees.
PARTED, MISSED = 0.03, 1e-3
#: Most splits from root to leaf; what is larger then stays whole.
DEEPEST = 40
_BLOCK = 1 << 20


def _directions(tree: int, depth: int, width: int) -> np.ndarray:
    return np.random.RandomState(1_000 * tree + depth + 1).normal(size=(width, 1))


def _project(trees: int, depth: int):
    def run_task(batches):
        made: dict[int, np.ndarray] = {}
        for pdf in batches:
            out = np.zeros((len(pdf), trees * depth), np.float32)
            widths = pdf["v"].map(len).to_numpy()
            for w in np.unique(widths):
                if w not in made:
                    made[w] = np.concatenate([_directions(t, d, w) for t in range(trees) for d in range(depth)], axis=1)
                own = widths == w
                x = np.array(pdf["v"][own].tolist(), float)
                out[own] = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ made[w]
            yield pd.DataFrame({"rep": pdf["rep"], "label": pdf["label"], "p": list(out.reshape(len(pdf), trees, depth).tolist())})

    return run_task


def leaves(points: DataFrame, leaf: int = LEAF, trees: int = TREES, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(rep, leaves): for every vector the sorted leaves (code, blocks): codes hold the tree in the high bits."""
    sizes = cut(points.groupBy("label").agg(F.count("*").alias("n")).withColumn("leaf", F.least(F.lit(leaf), F.greatest(F.lit(min(LEAST, leaf)), F.ceil(F.col("n") / SPLITS)))))
    most = sizes.agg(F.max(F.col("n") / F.col("leaf"))).first()[0] or 0
    depth = min(DEEPEST, math.ceil(math.log(most) / -math.log(0.5 + SPREAD / 2)) + 2) if most > 1 else 0
    if not depth:
        return points.select("rep", F.array(F.struct(F.lit(1).cast("long").alias("code"), F.lit(1).alias("blocks"))).alias("leaves"))
    trees = max(trees, math.ceil(math.log(MISSED) / math.log(1 - (1 - PARTED) ** depth)))
    margin = MARGIN * math.sqrt(2 - 2 * threshold)
    state = points.mapInPandas(_project(trees, depth), "rep long, label string, p array<array<float>>")
    state = cut(state.select("rep", "label", F.posexplode("p").alias("tree", "p")).withColumn("node", F.lit(1).cast("long")).withColumn("blocks", F.lit(0)))
    at = ["label", "tree", "node"]
    shares = [0.5 - WIDEST / 2, 0.5 - SPREAD / 2, 0.5 + SPREAD / 2, 0.5 + WIDEST / 2]
    blocks = F.ceil(F.col("n") / cell).cast("int")
    for d in range(depth + 1):
        growing = state.filter("blocks = 0")
        # after the last level nothing is split
        q = F.percentile_approx(F.col("p")[d], shares, 2000) if d < depth else F.array(*[F.lit(0.0)] * 4)
        nodes = growing.groupBy(*at).agg(F.count("*").alias("n"), q.alias("q")).join(sizes.select("label", "leaf"), "label").filter(F.col("n") > F.col("leaf"))
        wide = F.when(F.col("n") <= EXACT, F.col("q")[2] - F.col("q")[1]).otherwise(F.col("q")[3] - F.col("q")[0]) >= 2 * margin
        middle = F.when(F.col("n") <= EXACT, F.col("q")[2] + F.col("q")[1]).otherwise(F.col("q")[3] + F.col("q")[0]) / 2
        nodes = cut(nodes.select(*at, F.when(wide, middle).alias("c"), blocks.alias("exact")))
        if not nodes.limit(1).count():
            break
        joined = state.join(nodes.withColumn("__large", F.lit(True)), at, "left")
        here, split = F.col("p")[d if d < depth else 0], F.col("c").isNotNull()
        sides = F.when(~split, F.array("node")).otherwise(
            F.filter(F.array(F.when(here <= F.col("c") + margin, F.col("node") * 2), F.when(here >= F.col("c") - margin, F.col("node") * 2 + 1)), lambda x: x.isNotNull())
        )
        done = F.when(F.col("blocks") > 0, F.col("blocks")).when(F.col("__large").isNull(), 1).when(split, 0).otherwise(F.col("exact"))
        state = cut(joined.select("rep", "label", "tree", "p", F.explode(sides).alias("node"), done.alias("blocks")))
        # a label that stays whole is compared in its first tree only
        whole = state.filter("node = 1 and blocks > 0").groupBy("label").agg(F.min("tree").alias("only")) if d == 0 else None
        if whole is not None and whole.limit(1).count():
            state = cut(state.join(whole, "label", "left").filter("only is null or tree = only").drop("only"))
    found = F.struct((F.shiftleft(F.col("tree").cast("long"), 48) + F.col("node")).alias("code"), F.greatest("blocks", F.lit(1)).alias("blocks"))
    return state.groupBy("rep").agg(F.sort_array(F.collect_list(found)).alias("leaves"))


def _join(labels: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Union of pairs by hooking on the smaller root."""
    while len(p):
        a, b = labels[p], labels[q]
        apart = a != b
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        if not len(p):
            return
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _compare(threshold: float):
    def run_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        code = int(pdf["leaf"].iloc[0])
        x = np.array(pdf["v"].tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        n, side, codes = pdf["n"].to_numpy(np.int64), pdf["side"].to_numpy(), pdf["codes"].tolist()
        crossed = bool(side.any())
        # rows that share an earlier leaf have met there; rows with the same earlier leaves go together
        earlier: dict[int, list[int]] = {}
        for i, own in enumerate(codes):
            for c in own:
                if c < code:
                    earlier.setdefault(int(c), []).append(i)
        shared = [rows for rows in earlier.values() if len(rows) > 1]
        member = np.zeros((len(x), max(1, len(shared))), bool)
        for k, rows in enumerate(shared):
            member[rows, k] = True
        bits = np.packbits(member, axis=1)
        del member
        kinds, kind = np.unique(bits, axis=0, return_inverse=True)
        kind, few = kind.ravel(), len(kinds) <= 64
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        left = np.flatnonzero(side == 0)
        groups = [(left[kind[left] == k], k) for k in range(len(kinds))] if few else [(left, None)]
        for rows, k in groups:
            cols = np.flatnonzero(side == 1) if crossed else np.arange(len(x))
            if k is not None:
                cols = cols[~((kinds & kinds[k]).any(axis=1))[kind[cols]]]
            if not len(rows) or not len(cols):
                continue
            y, extra = x[cols], np.flatnonzero(n[cols] > 1)
            step = max(1, _BLOCK // len(cols))
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                near = x[own] @ y.T >= threshold
                if not crossed:
                    at = np.searchsorted(cols, own)
                    hit = (at < len(cols)) & (cols[np.minimum(at, len(cols) - 1)] == own)
                    near[np.flatnonzero(hit), at[hit]] = False
                if k is None:
                    p, q = np.nonzero(near)
                    for j in range(0, len(p), 1 << 16):
                        a, b = p[j : j + (1 << 16)], q[j : j + (1 << 16)]
                        met = (bits[own[a]] & bits[cols[b]]).any(axis=1)
                        near[a[met], b[met]] = False
                links[own] += np.count_nonzero(near, axis=1)
                if len(extra):
                    links[own] += near[:, extra] @ (n[cols[extra]] - 1)
                if crossed:
                    links[cols] += np.count_nonzero(near, axis=0)
                    copies = np.flatnonzero(n[own] > 1)
                    if len(copies):
                        links[cols] += (n[own[copies]] - 1) @ near[copies]
                p, q = np.nonzero(near & (root[own][:, None] != root[cols][None, :]))
                _join(root, own[p], cols[q])
        rep = pdf["rep"].to_numpy()
        keep = links > 0
        return pd.DataFrame({"rep": rep[keep], "links": links[keep], "root": rep[root[keep]]})

    return run_leaf


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, trees: int = TREES, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept for ``vectors(vec_id, embedding, label)``."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    zero = F.forall("v", lambda c: c == 0.0)
    sound = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad & ~zero)
    groups = cut(sound.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    # vectors of different width never meet
    points = groups.select("rep", "n", "v", F.concat_ws("/", "label", F.size("v").cast("string")).alias("label"))
    at = leaves(points.select("rep", "v", "label"), leaf, trees, threshold, cell)
    met = points.join(at, "rep").withColumn("codes", F.col("leaves.code")).withColumn("leaf", F.explode("leaves")).drop("leaves")
    block = F.pmod(F.xxhash64("rep"), F.col("leaf.blocks")).cast("int")
    met = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("leaf.blocks") - 1)))
    met = met.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).withColumn("side", (F.col("block") > F.col("other")).cast("int"))
    met = met.select("label", F.col("leaf.code").alias("leaf"), "first", "second", "side", "rep", "n", "v", "codes")
    found = cut(met.groupBy("label", "leaf", "first", "second").applyInPandas(_compare(threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = groups.join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("c"))
    out = v.join(named, ["label", "v"], "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))
