"""Custody log as a hash chain: appended in batches, sealed, checked in parallel.

A batch lies sorted by time and id in parts that one task each wrote; ``part`` and ``at`` (the place in the part) order its
entries. Every entry holds the hash of its content, every ``BLOCK`` entries of a part the digest of their hashes, every
part the digest of its blocks, and the batch a root over its parts. Only the seals form a chain, one row a batch: each hashes
the seal before it with its own root and count. So nothing but the seals is read in order, and an altered, removed or
inserted entry is found in its block whatever else was rewritten to match, as long as the last seal is known.

A batch counts once its seal is written, which happens last. One that died before is not read and is replaced by the next
try; one that is applied again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries of a part under one digest.
BLOCK = 4096
FIELDS = ["custody_log_id", "object_type", "object_id", "action", "actor", "details", "created_at"]
_ENTRY = "custody_log_id long, object_type string, object_id string, action string, actor string, details string, created_at timestamp, entry_hash string, part int, at long, batch int"
_BLOCK = "part int, block long, entries long, digest string, batch int"
_SEAL = "entries long, root string, before string, seal string, batch int"


def entry_hash() -> Column:
    """SHA-256 over the fields with their lengths in characters, nulls apart from empty texts."""
    text = lambda c: F.unix_micros(c).cast("string") if c == "created_at" else F.col(c).cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in FIELDS]), 256)


def mutation(rows: DataFrame, object_type: str, object_id: str, action: str | Column, actor: str, at: Column, details: Column | None = None) -> DataFrame:
    """Log rows of a step, one for each row it changed; ``custody_log_id`` is left to the caller."""
    action = F.lit(action) if isinstance(action, str) else action
    return rows.select(F.lit(object_type).alias("object_type"), F.col(object_id).cast("string").alias("object_id"), action.alias("action"), F.lit(actor).alias("actor"), (F.lit("{}") if details is None else details).alias("details"), at.alias("created_at"))


def _folder(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def seals(spark: SparkSession, root: str) -> DataFrame:
    return _folder(spark, root, "seals", _SEAL)


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the sealed batches."""
    return _folder(spark, root, "entries", _ENTRY).join(F.broadcast(seals(spark, root).select("batch")), "batch", "left_semi")


def listing(spark: SparkSession, root: str, since=None, until=None, limit: int = 200, **equal: str) -> DataFrame:
    """The newest entries, filtered by type, id, action, actor and time; at most 5,000."""
    out = entries(spark, root)
    for name, value in equal.items():
        out = out.filter(F.col(name) == value)
    if since is not None:
        out = out.filter(F.col("created_at") >= F.lit(since))
    if until is not None:
        out = out.filter(F.col("created_at") <= F.lit(until))
    return out.select("batch", *FIELDS).orderBy(F.desc("created_at"), F.desc("custody_log_id")).limit(max(1, min(limit, 5000)))


def _digests(rows: DataFrame) -> DataFrame:
    """Digest of each block; a list holds ``BLOCK`` hashes at most."""
    listed = rows.groupBy("batch", "part", F.floor(F.col("at") / BLOCK).cast("long").alias("block")).agg(F.count("*").alias("entries"), F.sort_array(F.collect_list(F.struct("at", "entry_hash"))).alias("l"))
    return listed.select("batch", "part", "block", "entries", F.sha2(F.array_join(F.transform("l", lambda e: F.concat_ws("=", e["at"].cast("string"), e["entry_hash"])), ","), 256).alias("digest"))


def _roots(blocks: DataFrame) -> DataFrame:
    """Entries and root of each batch, over the digests of its parts."""
    joined = lambda key: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "digest"))), lambda e: F.concat_ws("=", e[key].cast("string"), e["digest"])), ","), 256)
    parts = blocks.groupBy("batch", "part").agg(F.sum("entries").alias("entries"), joined("block").alias("digest"))
    return parts.groupBy("batch").agg(F.sum("entries").alias("entries"), joined("part").alias("root"))


def _seal(before: Column) -> Column:
    return F.sha2(F.concat_ws("|", before, F.col("batch").cast("string"), F.col("entries").cast("string"), F.col("root")), 256)


def append(spark: SparkSession, root: str, batch: int, log: DataFrame) -> str:
    """Adds a batch, which must follow those sealed before; returns the last seal. Extra columns are dropped."""
    last = seals(spark, root).orderBy(F.desc("batch")).first()
    if last and seals(spark, root).filter(F.col("batch") == batch).limit(1).count():
        return last.seal
    if last and batch < last.batch:
        raise ValueError(f"batch {batch} must follow batch {last.batch}")
    ordered = log.select(*FIELDS).withColumn("entry_hash", entry_hash()).repartitionByRange("created_at", "custody_log_id").sortWithinPartitions("created_at", "custody_log_id", "entry_hash")
    place = F.monotonically_increasing_id()
    placed = ordered.withColumns({"part": F.shiftright(place, 33).cast("int"), "at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    placed.write.mode("overwrite").parquet(f"{root}/entries/batch={batch}")
    written = spark.read.parquet(f"{root}/entries/batch={batch}").withColumn("batch", F.lit(batch))
    _digests(written).drop("batch").write.mode("overwrite").parquet(f"{root}/blocks/batch={batch}")
    blocks = spark.read.parquet(f"{root}/blocks/batch={batch}").withColumn("batch", F.lit(batch))
    of = _roots(blocks).first()  # one row
    row = spark.createDataFrame([(batch, of.entries if of else 0, of.root if of else "", last.seal if last else "")], "batch int, entries long, root string, before string").withColumn("seal", _seal(F.col("before")))
    row.drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{root}/seals/batch={batch}")
    return row.first().seal


def verify(spark: SparkSession, root: str, head: str | None = None) -> DataFrame:
    """(level, batch, part, position, reason): what does not hold; no rows for a sound log.

    ``entry``: the content does not give its hash (position ``at``). ``block``: entries are altered, missing or added in
    the block at ``position``. ``batch``: the blocks do not give the root. ``chain``: a seal does not follow from the one
    before. ``head``: the last seal is not the one that the caller kept.
    """
    rows = entries(spark, root).withColumn("__now", entry_hash())
    sealed = seals(spark, root)
    wrong = rows.filter("__now <> entry_hash").select(F.lit("entry").alias("level"), "batch", "part", F.col("at").alias("position"), F.lit("altered").alias("reason"))
    now = _digests(rows.withColumn("entry_hash", F.col("__now"))).select("batch", "part", "block", F.col("entries").alias("n"), F.col("digest").alias("d"))
    stored = _folder(spark, root, "blocks", _BLOCK).join(F.broadcast(sealed.select("batch")), "batch", "left_semi")
    met = stored.join(now, ["batch", "part", "block"], "full")
    size = F.when(F.coalesce("n", F.lit(0)) < F.coalesce("entries", F.lit(0)), "missing").when(F.coalesce("n", F.lit(0)) > F.coalesce("entries", F.lit(0)), "added").otherwise("altered")
    blocks = met.filter(~F.col("d").eqNullSafe(F.col("digest"))).select(F.lit("block").alias("level"), "batch", "part", F.col("block").alias("position"), size.alias("reason"))
    roots = sealed.join(_roots(stored).select("batch", F.col("entries").alias("n"), F.col("root").alias("r")), "batch", "left")
    none = [F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("position")]
    batches = roots.filter((F.coalesce("r", F.lit("")) != F.col("root")) | (F.coalesce("n", F.lit(0)) != F.col("entries"))).select(F.lit("batch").alias("level"), "batch", *none, F.lit("root").alias("reason"))
    # one row a batch: the only step in order
    order = Window.orderBy("batch")
    chained = sealed.withColumn("__before", F.coalesce(F.lag("seal").over(order), F.lit(""))).withColumn("__last", F.lead("batch").over(order).isNull())
    chain = chained.filter((F.col("before") != F.col("__before")) | (F.col("seal") != _seal(F.col("before")))).select(F.lit("chain").alias("level"), "batch", *none, F.lit("seal").alias("reason"))
    out = wrong.unionByName(blocks).unionByName(batches).unionByName(chain)
    if head is not None:
        out = out.unionByName(chained.filter(F.col("__last") & (F.col("seal") != head)).select(F.lit("head").alias("level"), "batch", *none, F.lit("seal").alias("reason")))
    return out
