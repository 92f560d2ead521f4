"""Near hashes by Hamming distance, without pairs inside a crowded band.

Two hashes within ``limit`` bits agree on one of ``limit + 1`` bands. Hashes of a band value meet in pairs while they are
few. Where more hold the value than a hash has neighbours within half the limit, each lists those neighbours instead:
hashes at distance d share one that is ceil(d / 2) from the one and floor(d / 2) from the other, so the sums of flips of
what meets at a neighbour never go below a distance, and reach it. Smallest values per neighbour then answer the search,
and the work on a band value grows with its hashes, not with their square. Both ways give the same rows.

Positions in which all hashes agree tell nothing and belong to no band. Where even values spread evenly would crowd every
band, one empty band replaces them: each hash lists its neighbours once, not once a band.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tasks over which the rows of one band value are dealt when they learn whether it is crowded.
DEAL = 64


class Bands:
    """Bands of ``bits`` positions for searches within ``limit``; hashes travel as words ``w0``, ``w1``, ... of up to 32 bits."""

    def __init__(self, bits: int, limit: int, vary: list[int] | None = None, hashes: int = 0, most: int | None = None):
        """``vary``: the positions in which hashes differ, all by default; ``hashes``: how many there are, for the choice of bands."""
        if not 0 <= limit < bits:
            raise ValueError("the limit must lie between 0 and the number of bits")
        self.bits, self.limit, self.reach = bits, limit, (limit + 1) // 2
        self.sizes = [min(32, bits - i) for i in range(0, bits, 32)]
        self.words = [f"w{i}" for i in range(len(self.sizes))]
        self.vary = list(range(bits)) if vary is None else vary
        n = len(self.vary)
        cuts = [round(n * i / (limit + 1)) for i in range(limit + 2)]
        self.bands = [self.vary[a:b] for a, b in zip(cuts, cuts[1:])]
        #: Neighbours that a hash lists in a crowded band, at most.
        self.listed = max(sum(comb(n - len(b), k) for k in range(self.reach + 1)) for b in self.bands)
        if hashes > (self.listed if most is None else most) << max(map(len, self.bands)):
            self.bands, self.listed = [[]], sum(comb(n, k) for k in range(self.reach + 1))

    @classmethod
    def of(cls, bits: int, limit: int, hashes: DataFrame, most: int | None = None) -> Bands:
        """Bands for what ``hashes(w0, ...)`` hold: one aggregate of a row tells where they differ and how many there are."""
        plain = cls(bits, limit)
        found = hashes.agg(F.count("*").alias("n"), *[f(w).alias(f"{name}_{w}") for w in plain.words for name, f in (("some", F.bit_or), ("all", F.bit_and))]).first()
        differ = [(found[f"some_{w}"] or 0) ^ (found[f"all_{w}"] or 0) for w in plain.words]
        vary = [p for p in range(bits) if differ[p // 32] & plain.mask([p])[p // 32]]
        return cls(bits, limit, vary, found["n"], most)

    def mask(self, positions) -> list[int]:
        out = [0] * len(self.sizes)
        for p in positions:
            out[p // 32] |= 1 << (self.sizes[p // 32] - 1 - p % 32)
        return out

    def parse(self, bits: Column) -> list[Column]:
        return [F.conv(F.substring(bits, 32 * i + 1, n), 2, 10).cast("long").alias(w) for i, (w, n) in enumerate(zip(self.words, self.sizes))]

    def spread(self, hashes: DataFrame) -> DataFrame:
        """Each hash once a band: ``band`` and the words ``p0``, ... that hold the band's positions only."""
        part = lambda b: [F.col(w).bitwiseAND(F.lit(m).cast("long")).alias(f"p{i}") for i, (w, m) in enumerate(zip(self.words, self.mask(b)))]
        every = F.array(*[F.struct(F.lit(i).alias("band"), *part(b)) for i, b in enumerate(self.bands)])
        return hashes.withColumn("__s", F.explode(every)).select("*", "__s.*").drop("__s")

    @property
    def place(self) -> list[str]:
        return ["band", *[f"p{i}" for i in range(len(self.words))]]

    def neighbours(self, rows: DataFrame) -> DataFrame:
        """Each row with every hash up to ``reach`` flips outside its band: words ``v0``, ... and ``flips``.

        Flips come one at a time, in rising position, so only the single flips travel: one row for each band and position.
        """
        single = [(i, p, *self.mask([p])) for i, b in enumerate(self.bands) for p in self.vary if p not in b]
        table = F.broadcast(rows.sparkSession.createDataFrame(single, ", ".join(["band int", "__p int", *[f"m{i} long" for i in range(len(self.words))]])))
        at = rows.withColumns({f"v{i}": F.col(w) for i, w in enumerate(self.words)} | {"flips": F.lit(0), "__last": F.lit(-1)})
        out = at
        for k in range(1, self.reach + 1):
            met = at.join(table, "band").filter("__p > __last")
            at = met.withColumns({f"v{i}": F.col(f"v{i}").bitwiseXOR(F.col(f"m{i}")) for i in range(len(self.words))} | {"flips": F.lit(k), "__last": F.col("__p")}).select(*out.columns)
            out = out.unionAll(at)
        return out.drop("__last")

    @property
    def at(self) -> list[str]:
        return ["band", *[f"v{i}" for i in range(len(self.words))]]

    def distance(self, left: str = "", right: str = "o_") -> Column:
        return sum((F.bit_count(F.col(left + w).bitwiseXOR(F.col(right + w))) for w in self.words), F.lit(0)).cast("int")

    def crowded(self, spread: DataFrame, most: int | None) -> DataFrame:
        """Band values of more than ``most`` rows, one row for each of ``DEAL`` shares, so that a join with them splits the crowd."""
        many = spread.groupBy(*self.place).agg(F.count("*").alias("__n")).filter(F.col("__n") > (self.listed if most is None else most))
        return many.select(*self.place, F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("__deal"), F.lit(True).alias("__crowded"))

    def split(self, spread: DataFrame, crowded: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
        """Rows of sparse and of crowded band values."""
        dealt = spread.withColumn("__deal", F.pmod(F.xxhash64(by), F.lit(DEAL)).cast("int")).join(crowded, [*self.place, "__deal"], "left").drop("__deal")
        return dealt.filter("__crowded is null").drop("__crowded"), dealt.filter("__crowded").drop("__crowded")


def near_duplicate_hashes(hashes: DataFrame, limit: int = 4, bits: int = 64, most: int | None = None) -> DataFrame:
    """For bit strings ``hashes(id, bits)``: each id with its nearest other id within ``limit`` bits, the smallest of equally near ones.

    Strings of another length, with other characters or null meet their exact copies only. Equal strings collapse first, so
    copies never meet. ``most`` moves the point from which a band value counts as crowded; the rows do not depend on it.
    """
    b = Bands(bits, limit)
    groups = hashes.filter(F.col("bits").isNotNull()).groupBy("bits").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    second = hashes.join(groups.filter("n > 1"), "bits").filter("id <> low").groupBy("bits").agg(F.min("id").alias("next"))
    words = groups.filter(F.col("bits").rlike(f"^[01]{{{bits}}}$")).select("low", *b.parse(F.col("bits")))
    b = Bands.of(bits, limit, words, most)
    spread = b.spread(words)
    few, many = b.split(spread, b.crowded(spread, most), "low")
    other = few.select(*b.place, F.col("low").alias("other"), *[F.col(w).alias(f"o_{w}") for w in b.words])
    pairs = few.join(other, b.place).filter("low <> other").withColumn("distance", b.distance()).filter(F.col("distance") <= limit)
    listed = b.neighbours(many.select("low", "band", *b.words)).select("low", "flips", *b.at)
    there, alike = Window.partitionBy(*b.at), Window.partitionBy(*b.at, "flips").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = {f"__l{k}": F.min(F.when(F.col("flips") == k, F.col("low"))).over(there) for k in range(b.reach + 1)}
    beside = listed.withColumns(least | {"__next": F.nth_value("low", 2).over(alike)})
    found = []
    for k in range(b.reach + 1):
        smallest, d = F.col(f"__l{k}"), F.col("flips") + k
        of = F.when(smallest == F.col("low"), F.col("__next")).otherwise(smallest)  # a hash is the smallest at its own number of flips only
        found.append(F.when(of.isNotNull() & (d <= limit), F.struct(d.cast("int").alias("distance"), of.alias("other"))))
    met = pairs.select("low", F.struct("distance", "other").alias("m")).union(beside.select("low", F.array_min(F.array(*found)).alias("m")).filter("m is not null"))
    near = met.groupBy("low").agg(F.min("m").alias("m"))
    own = hashes.join(groups.select("bits", "low"), "bits").join(second, "bits", "left").join(near, "low", "left")
    copy = F.when(F.col("id") != F.col("low"), F.col("low")).otherwise(F.col("next"))
    out = own.select("id", F.coalesce(copy, F.col("m.other")).alias("nearest"), F.when(copy.isNotNull(), 0).otherwise(F.col("m.distance")).alias("distance"))
    return out.filter("nearest is not null")


def first_duplicates(observations: DataFrame, known: DataFrame, limit: int = 4, most: int | None = None) -> DataFrame:
    """(observation_id, ordinal, distance): the first of what is known that an observation repeats.

    ``observations(observation_id, exact_hash, perceptual_hash)`` and ``known(ordinal, exact_hash, perceptual_hash)``, the
    baseline at the smallest ordinal, then the history in order. A repeat has the same exact hash, or a perceptual hash (up
    to 16 hex digits) within ``limit`` bits; ``distance`` is null where only the exact hash agrees. Empty and null exact
    hashes repeat nothing. Equal hashes of either side collapse before they meet.
    """
    b = Bands(64, limit)
    half = lambda n: F.conv(F.substring(F.lpad("perceptual_hash", 16, "0"), 8 * n + 1, 8), 16, 10).cast("long").alias(f"w{n}")
    hexed = lambda df: df.filter(F.col("perceptual_hash").rlike("^[0-9a-fA-F]{1,16}$"))
    asked = hexed(observations).select(half(0), half(1)).distinct()
    first = hexed(known).select("ordinal", half(0), half(1)).groupBy(*b.words).agg(F.min("ordinal").alias("ordinal"))
    b = Bands.of(64, limit, asked.select(*b.words).unionAll(first.select(*b.words)), most)
    right, left = b.spread(first), b.spread(asked)
    # a value is crowded when what both sides hold of it is: either side alone may be small
    crowd = b.crowded(left.select(*b.place).unionAll(right.select(*b.place)), most)
    (few, many), (few_known, many_known) = b.split(left, crowd, "w1"), b.split(right, crowd, "w1")
    theirs = few_known.select(*b.place, "ordinal", *[F.col(w).alias(f"o_{w}") for w in b.words])
    pairs = few.join(theirs, b.place).filter(b.distance() <= limit).select(*b.words, "ordinal")
    earliest = b.neighbours(many_known.select("ordinal", "band", *b.words)).groupBy(*b.at, F.col("flips").alias("flips_known")).agg(F.min("ordinal").alias("ordinal"))
    listed = b.neighbours(many.select("band", *b.words)).join(earliest, b.at).filter(F.col("flips") + F.col("flips_known") <= limit).select(*b.words, "ordinal")
    near = pairs.union(listed).groupBy(*b.words).agg(F.min("ordinal").alias("near"))
    exact = known.filter("exact_hash <> ''").groupBy("exact_hash").agg(F.min("ordinal").alias("same"))
    out = observations.select("observation_id", "exact_hash", F.when(F.col("perceptual_hash").rlike("^[0-9a-fA-F]{1,16}$"), F.col("perceptual_hash")).alias("perceptual_hash"))
    out = out.withColumns({"w0": half(0), "w1": half(1)}).join(near, b.words, "left").join(exact, "exact_hash", "left").withColumn("ordinal", F.least("near", "same")).filter("ordinal is not null")
    of = known.filter(F.col("perceptual_hash").rlike("^[0-9a-fA-F]{1,16}$")).select("ordinal", half(0).alias("o_w0"), half(1).alias("o_w1"))
    return out.join(of, "ordinal", "left").select("observation_id", "ordinal", b.distance().alias("distance"))
