"""Product quantisation of vectors in whole numbers: codebooks by k-means over the parts of integer vectors.

Every component x becomes floor(4096 x); the vector is cut into equal parts, and each part position has a codebook that
is broadcast (``parts`` x ``entries`` x part width, fixed by parameters). Arrow batches take all squared distances at
once as |x|^2 - 2 x.y + |y|^2 with int64 matrix products and the first argmin. A task sends one row of sums per used
entry and component; a grouped shuffle adds them, and the driver gets one row per entry and component. Vectors are read
again in each round, so nothing has to be kept and a lost executor costs its own tasks only.

Defined results: vectors that are null or hold null or non-finite components are dropped; the width is that of the kept
vector with the smallest id whose width is a positive multiple of ``parts``, and vectors of any other width are dropped
too; with fewer vectors than entries a codebook has as many entries as there are vectors; the first entries come by
vec_id, equal ids by their vectors, rows without an id last; rows that repeat are encoded each; ties of distance go to
the lower index; null labels count as one label; other columns of any name play no part; an empty table gives no rows.
Integers must stay below 2^27 (components below 2^15, at most 64 a part); beyond, int64 products could wrap, so the job
ends with an ArithmeticError, as Spark's own arithmetic does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import join_skewed, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers below this and parts no wider than 64 keep every sum of squares inside int64.
LARGEST, WIDEST = 1 << 27, 64


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds finite numbers only."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True)))


def integers(column: pa.Array, scale: int = SCALE) -> np.ndarray:
    """An Arrow list column of equal widths as a matrix of floor(scale x)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * scale)
    if x.size and np.abs(x).max() >= LARGEST:
        raise ArithmeticError(f"a component times {scale} leaves the range of {LARGEST}")
    return x.astype(np.int64).reshape(len(column), -1)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance per row and part, for ``x`` (rows x width) and ``books`` (parts x entries x part width)."""
    parts, entries, _ = books.shape
    cut = x.reshape(len(x), parts, -1)
    index, distance = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p in range(parts):
        own, book = cut[:, p], books[p]
        d = (own * own).sum(1)[:, None] - 2 * (own @ book.T) + (book * book).sum(1)
        index[:, p] = d.argmin(1)
        distance[:, p] = d[np.arange(len(x)), index[:, p]]
    return index, distance


def _columns(batches):
    for b in batches:
        if b.num_rows:
            yield b


def _sums(books, scale: int):
    def run_task(batches):
        """Sums and counts of the parts that each entry got, over all batches of the task."""
        now = books.value
        parts, entries, width = now.shape
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in _columns(batches):
            x = integers(b.column(0), scale)
            index, _ = assign(x, now)
            at = (index + np.arange(parts) * entries).ravel()
            np.add.at(sums, at, x.reshape(-1, width))
            counts += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "entry": np.repeat(used, width),
            "pos": np.tile(np.arange(width), len(used)),
            "s": sums[used].ravel(),
            "n": np.repeat(counts[used], width),
        })

    return run_task


def _encode(books, scale: int):
    def run_task(batches):
        for b in _columns(batches):
            index, distance = assign(integers(b.column("v"), scale), books.value)
            codes = [r.tobytes().hex() for r in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("vec_id", "label")), pa.array(codes, pa.string()), pa.array(distance.sum(1))], names=["vec_id", "label", "code", "error"])

    return run_task


def first_books(kept: DataFrame, parts: int, entries: int, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts x entries x part width) from the vectors with the smallest ids; no entries for an empty table."""
    rows = kept.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = rows.limit(1).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(first[0].v)
    if width > WIDEST * parts:
        raise ArithmeticError(f"parts are wider than {WIDEST}")
    got = rows.filter(F.size("v") == width).limit(entries).collect()
    x = integers(pa.array([r.v for r in got], pa.list_(pa.float64())), scale)
    return x.reshape(len(got), parts, width // parts).swapaxes(0, 1)


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over ``kept(vec_id, v)``; entries that nothing chose stay as they are."""
    books = first_books(kept, parts, entries, scale)
    if not books.size:
        return books
    sc = kept.sparkSession.sparkContext
    own = kept.filter(F.size("v") == books.shape[0] * books.shape[2]).select("v")
    for _ in range(rounds):
        sent = sc.broadcast(books)
        sums = own.mapInArrow(_sums(sent, scale), "entry long, pos long, s long, n long")
        got = sums.groupBy("entry", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()
        books = books.copy()
        books.reshape(-1, books.shape[2])[got["entry"], got["pos"]] = got["s"].to_numpy() // got["n"].to_numpy()
        sent.destroy()
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) for every usable vector of ``vectors(vec_id, embedding, label)``."""
    kept = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    books = fit(kept, parts, entries, rounds, scale)
    own = kept.filter(F.size("v") == (books.shape[0] * books.shape[2] or -1))
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    return own.mapInArrow(_encode(sent, scale), "vec_id long, label string, code string, error long").withColumn("codebooks_sha256", F.lit(digest(books)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "embeddings")).withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    total = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    return join_skewed(coded, sums, "label", total).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _rounds_sql() -> str:
    """DuckDB SQL: rounds unrolled, floors of negative sums by the positive remainder."""
    assigned = "select t.vec_id, t.part, min(t.d * 16 + t.entry) as best from (select p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::bigint as d from parts p join {b} b on p.part = b.part and p.pos = b.pos group by all) t group by all"
    steps = []
    for k in range(ROUNDS):
        steps.append(f"a{k} as materialized ({assigned.format(b=f'b{k}')})")
        steps.append(f"s{k} as (select p.part, p.pos, a.best % 16 as entry, sum(p.x)::bigint as s, count(*)::bigint as n from parts p join a{k} a on a.vec_id = p.vec_id and a.part = p.part group by all)")
        steps.append(f"b{k + 1} as materialized (select b.part, b.entry, b.pos, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, b.x) as x from b{k} b left join s{k} s on s.part = b.part and s.entry = b.entry and s.pos = b.pos)")
    last = f"b{ROUNDS}"
    return f"""
with kept as (select vec_id, label, embedding as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
flat as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) - 1 as i, len(v) // {PARTS} as w from kept),
parts as materialized (select vec_id, i // w as part, i % w as pos, floor({SCALE} * x::double)::bigint as x from flat),
firsts as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {ENTRIES}),
b0 as materialized (select p.part, f.entry, p.pos, p.x from parts p join firsts f using (vec_id)),
{", ".join(steps)},
a as materialized ({assigned.format(b=last)}),
coded as (select vec_id, string_agg(format('{{:02x}}', best % 16), '' order by part) as code, sum(best // 16)::bigint as error from a group by vec_id),
books as (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from {last})
select c.vec_id, c.code, c.error, (sum(c.error) over (partition by k.label))::bigint as label_error, codebooks_sha256
from coded c join kept k using (vec_id), books"""


ORACLE = _rounds_sql()
