"""Collocations: phrases of up to five words whose parts occur together more often than apart.

Counting sorts suffixes, in ``ROUNDS``: after the words are counted, suffixes of two words, then those of three or more. Texts
split at words and pairs rarer than the threshold, which no frequent phrase can hold; the counts of the rounds before tell
them. Broadcasts say which are frequent, by a bit per hash value: 1 and 8 MB at any size. A rare one that shares its bit only
costs work. In a round each position gives its suffix if that has the round's number of words; equal suffixes of a run of
words are merged before they shuffle by language and first word. Each task reads its suffixes in reverse lexicographic order
and counts their prefixes with one stack. Where the first word holds more than 1/``HOT_WORDS`` of all words, the next words
take part in the dealing, up to the first that is not hot; only prefixes of nothing but hot words are then added up from
several tasks. Parts are joined to the phrases at the end, when only frequent ones are left.

Defined results: a null text is empty; a null language is ``und``; repeated rows count each; rows without an id count like
others (ids play no part); texts of any length are read whole, in slices; a phrase never leaves its piece; ties of score
order by count, then by the phrase's bytes; of equal cuts the shortest first part counts; other columns of any name play
no part; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evifuse.llm.common import cut, join_skewed, table

MAX_N, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Fewest and most words of the suffixes of each round.
ROUNDS = (2, 2), (3, MAX_N)
#: Bits that say which words and pairs are frequent, as powers of two.
SIEVES = 23, 26
#: A word with more than 1/HOT_WORDS of all words is hot; there are fewer than HOT_WORDS such.
HOT_WORDS = 200
#: Bytes of text that are split and merged at a time, and of one text.
RUN = 1 << 21
_PIECES = r"[.,;:!?\n\x0b\x0c\r]"
_CUTS = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
#: Salts for the last ranking, so that one language is not sorted in one task.
SALTS = 64


def _name(lang: str | None) -> str:
    """A language as a word without blanks: it stands second in the sort key."""
    return ("und" if lang is None else lang).replace("%", "%25").replace(" ", "%20").replace("\t", "%09")


def _runs(batches):
    """(language, texts, whether the text goes on): texts of one language, about ``RUN`` bytes; longer ones alone, in slices cut after a separator."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    for b in batches:
        text = b.column("text")
        length = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(length > RUN).tolist():
            data, at = text[i].as_buffer().to_pybytes(), 0
            while at < len(data):
                m = _CUTS.search(data, at + RUN)
                end = m.end() if m else len(data)
                yield _name(b.column("lang")[i].as_py()), pa.array([data[at:end]], pa.binary()).cast(pa.string()), end < len(data)
                at = end
        codes = b.column("lang").dictionary_encode()
        at = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for k in np.unique(at).tolist():
            name = _name(codes.dictionary[k].as_py() if k >= 0 else None)
            own = np.flatnonzero((at == k) & (length > 0) & (length <= RUN))
            cuts = np.flatnonzero(np.diff(np.cumsum(length[own]) // RUN)) + 1
            for part in np.split(own, cuts):
                if len(part):
                    held.setdefault(name, []).append(text.take(pa.array(part)))
                    size[name] = size.get(name, 0) + int(length[part].sum())
                    if size[name] >= RUN or sum(size.values()) >= 4 * RUN:
                        most = max(size, key=size.get)
                        size.pop(most)
                        yield most, pa.concat_arrays(held.pop(most)), False
    for name, texts in held.items():
        yield name, pa.concat_arrays(texts), False


def _words(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Word numbers of all texts in order, with -1 before each text and between pieces, and the words by number."""
    marked = pc.binary_join_element_wise(".", pc.replace_substring_regex(pc.ascii_lower(texts), _PIECES, " . "), " ")
    codes = pc.ascii_split_whitespace(marked).flatten().dictionary_encode()
    words = codes.dictionary.to_pylist()
    stop = np.array([w in ("", ".") for w in words], bool)
    at = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # empty strings, if any, stand where a text ends
    return np.where(stop[at], -1, at), words


def _count_words(batches):
    """(w, lang, n) with the counts of each run; Spark adds those of a task before they shuffle."""
    for name, texts, _ in _runs(batches):
        at, words = _words(texts)
        counts = np.bincount(at[at >= 0], minlength=len(words))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"w": pa.array(words, pa.string()).take(pa.array(used)), "lang": pa.array([name] * len(used), pa.string()), "n": counts[used]})


def _marks(name: str, words: list[str]) -> np.ndarray:
    seed = zlib.crc32(f"{name} ".encode())
    return np.fromiter((zlib.crc32(w.encode(), seed) for w in words), np.int64, len(words))


def _look(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def _bit(at, power: int):
    """The place in a sieve of 2^power bits of a gram's hash, an array or a Column."""
    if isinstance(at, np.ndarray):
        return (at ^ at >> 31) & (1 << power) - 1
    return at.bitwiseXOR(F.shiftright(at, 31)).bitwiseAND(F.lit((1 << power) - 1))


def _look(sieve: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = _bit(at, len(sieve).bit_length() + 2)
    return (sieve[at >> 3] >> (at & 7) & 1).astype(bool)


class _Run:
    """A run's words as numbers (frequent words from 1, all else 0), and for each position whether a frequent gram of 1, 2, ... words may begin there, for as many sizes as there are sieves."""

    def __init__(self, sieves: list[np.ndarray], name: str, texts: pa.Array):
        at, words = _words(texts)
        seed = zlib.crc32(f"{name} ".encode())
        mark = np.fromiter((zlib.crc32(w.encode(), seed) for w in words), np.int64, len(words))
        often = _look(sieves[0], mark)
        a = np.append(np.where(often, np.cumsum(often), 0), 0)[at]
        self.size, self.tokens, self.spelled = len(a), (at, words), ["", *(w for w, good in zip(words, often) if good)]
        self.a = np.concatenate([a, np.zeros(MAX_N, np.int64)])
        self.mark = np.concatenate([[0], mark[often]])[self.a]
        self.ok = [self.a > 0]
        for k, sieve in enumerate(sieves[1:], 2):
            may = self.may(k)
            self.ok.append(may & _look(sieve, self.hashes(k)))

    def may(self, k: int) -> np.ndarray:
        """Whether both grams of k - 1 words inside the gram of k words from here may be frequent."""
        return self.ok[k - 2] & np.append(self.ok[k - 2][1:], False)

    def hashes(self, k: int) -> np.ndarray:
        """60 bits for the k words from each position."""
        h = self.mark
        for j in range(1, k):
            h = (h << 28 ^ h >> 19 ^ np.append(self.mark[j:], np.zeros(j, np.int64))) & (1 << 60) - 1
        return h

    def tail(self, n: int) -> str:
        """The last n words, with which the next slice of the same text begins."""
        at, words = self.tokens
        return " ".join("." if i < 0 else words[i] for i in at[-n:].tolist()) + " "


def _sieved_runs(sieves, batches, n: int):
    """(language, run, whether its text goes on); the slice of a text begins with the last n words of the one before."""
    tail = ""
    for name, texts, goes_on in _runs(batches):
        run = _Run(sieves, name, pa.array([tail + texts[0].as_py()], pa.string()) if tail else texts)
        tail = run.tail(n) if goes_on else ""
        yield name, run, goes_on


def _gram_hash(words, lang: str, k: int):
    """``_Run.hashes`` of k words, an array Column."""
    mark = lambda j: F.crc32(F.concat(F.col(lang), F.lit(" "), words[j]))
    h = mark(0)
    for j in range(1, k):
        h = F.shiftleft(h, 28).bitwiseXOR(F.shiftright(h, 19)).bitwiseXOR(mark(j)).bitwiseAND(F.lit((1 << 60) - 1))
    return h


def _suffixes(sieves, hot, least: int, most: int):
    def run_task(batches):
        """(key, hot, n): a suffix of ``least`` to ``most`` words as "first lang second ..." with its count in the run and the number of hot words that it begins with; keys end in a blank, so that prefixes are whole words. The suffix ends before a rare gram."""
        for name, run, goes_on in _sieved_runs(sieves.value, batches, most - 1):
            ok, size = run.ok, max(0, run.size - (most - 1)) if goes_on else run.size
            start = np.flatnonzero(run.may(least)[:size])
            if not len(start):
                continue
            cols = [run.a[start + j] for j in range(least)]
            for j in range(least, most):
                k = min(len(ok), j + 1)
                cols.append(np.where((cols[-1] > 0) & ok[k - 1][start + j + 1 - k], run.a[start + j], 0))
            # three numbers below 2^21 fit in one key
            keys = [functools.reduce(lambda x, y: x << 21 | y, cols[i : i + 3]) for i in range(0, most, 3)] if len(run.spelled) <= 1 << 21 else cols
            order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
            m = np.stack(cols, 1)[order]
            first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]).any(1)]))
            counts = np.diff(np.append(first, len(m)))
            spelled = pa.array([w and w + " " for w in run.spelled], pa.string())
            is_hot = np.array([(name, w) in hot for w in run.spelled], bool)
            for i in range(0, len(first), 100_000):
                u = m[first[i : i + 100_000]]
                w = [spelled.take(pa.array(u[:, j])) for j in range(most)]
                keys = pc.binary_join_element_wise(w[0], f"{name} ", *w[1:], "")
                hots = np.logical_and.accumulate(is_hot[u], axis=1).sum(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.array(hots), pa.array(counts[i : i + 100_000])], names=["key", "hot", "n"])

    return run_task


def _stack(least: int, fewest: int, most: int):
    def run_task(batches):
        """(key, n) of all prefixes of ``fewest`` words or more of keys that come in reverse order and have ``most`` at most. The stack holds the open prefixes, one a depth; a batch closes those that end in it.

        Counts under ``least`` stay only for prefixes of hot words, whose suffixes are dealt to several tasks.
        """
        depths = range(fewest + 1, most + 2)
        stack: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            key, hot, n = b.column("key"), b.column("hot").to_numpy(zero_copy_only=False), b.column("n").to_numpy()
            split = pc.split_pattern(key, " ")
            ends = split.offsets.to_numpy()
            flat = split.flatten().dictionary_encode()
            # one column a depth, -1 beyond the last word; keys end in a blank, so the last part of each is empty
            size = np.diff(ends) - 1
            ids = flat.indices.to_numpy(zero_copy_only=False)
            m = np.full((len(n), most + 1), -1, np.int64)
            for j in range(most + 1):
                has = size > j
                m[has, j] = ids[ends[:-1][has] - ends[0] + j]
            same = np.logical_and.accumulate(m[1:] == m[:-1], axis=1)
            out_keys, out_counts = [], []
            for d in depths:
                starts = np.concatenate([[0], np.flatnonzero(~same[:, d - 1]) + 1])
                starts_words = m[starts, d - 1] >= 0
                sums = np.add.reduceat(n, starts)
                words = lambda i, d=d: " ".join(key[int(i)].as_py().split(" ")[:d])
                parted = hot >= d - 1
                open_key, open_n, open_parted = stack.pop(d, (None, 0, False))
                if open_key is not None:
                    if starts_words[0] and words(0) == open_key:
                        sums[0] += open_n
                    elif open_n >= least or open_parted:
                        out_keys.append(pa.array([open_key], pa.string()))
                        out_counts.append([open_n])
                last = len(starts) - 1
                if starts_words[last]:
                    stack[d] = [words(starts[last]), int(sums[last]), bool(parted[starts[last]])]
                done = starts_words & ((sums >= least) | parted[starts])
                done[last] = False
                if done.any():
                    closed = pc.binary_join(pc.list_slice(split.take(pa.array(starts[done])), 0, d), " ")
                    out_keys.append(closed)
                    out_counts.append(sums[done])
            if out_keys:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out_keys), pa.array(np.concatenate(out_counts), pa.int64())], names=["key", "n"])
        left = [x for x in stack.values() if x[1] >= least or x[2]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in left], pa.string()), pa.array([x[1] for x in left], pa.int64())], names=["key", "n"])

    return run_task


def _sieve(marks: DataFrame, power: int) -> np.ndarray:
    """A bit for every ``at``, as bytes; Spark gathers it in blocks of 4 KB."""
    one = marks.select((_bit(F.col("at"), power) + 1).alias("at"))
    blocks = one.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(1 << power - 3, np.uint8)
    for r in blocks.collect():
        bits[(r.block - 1) * 4096 : r.block * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of every phrase of up to ``MAX_N`` words with f >= least, (lang, n) with all word occurrences) of ``docs(text, lang)``.

    Languages are written as in ``_name``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = rows.mapInArrow(_count_words, "w string, lang string, n long").groupBy("lang", "w").agg(F.sum("n").alias("f"))
    # rarer words matter for the totals only
    kept = cut(counted.groupBy("lang", F.when(F.col("f") >= least, F.col("w")).alias("w")).agg(F.sum("f").alias("f")))
    totals = cut(kept.groupBy("lang").agg(F.sum("f").alias("n")))
    words = kept.filter("w is not null")
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot = {(r.lang, r.w) for r in words.filter(F.col("f") * HOT_WORDS > total).select("lang", "w").collect()}
    sieves = [_sieve(words.select(F.crc32(F.concat("lang", F.lit(" "), "w")).alias("at")), SIEVES[0])]
    found, w = words.select("lang", F.col("w").alias("phrase"), F.lit(1).alias("words"), "f"), F.split("key", " ")
    for fewest, most in ROUNDS:
        suffixes = rows.mapInArrow(_suffixes(spark.sparkContext.broadcast(sieves), hot, fewest, most), "key string, hot int, n long")
        # the language, the first word, and where that is hot the next ones up to the first that is not
        dealt = suffixes.repartition(F.expr("substring_index(key, ' ', hot + 2)"))
        sums = dealt.sortWithinPartitions(F.col("key").desc()).mapInArrow(_stack(least, fewest, most), "key string, n long").groupBy("key").agg(F.sum("n").alias("f"))
        phrases = cut(sums.filter(F.col("f") >= least).select(w[1].alias("lang"), F.concat_ws(" ", F.concat(F.slice(w, 1, 1), F.slice(w, 3, MAX_N))).alias("phrase"), (F.size(w) - 1).alias("words"), "f"))
        found = found.union(phrases)
        if most < MAX_N:
            sieves = [*sieves, _sieve(phrases.select(_gram_hash(F.split("phrase", " "), "lang", most).alias("at")), SIEVES[most - 1])]
    return cut(found), totals


def _with(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, by keys that many rows of ``left`` may share."""
    n = left.groupBy(*keys).agg(F.count("*").alias("n"))
    packed = F.struct(*keys).alias("__key")
    sized = n.join(right, keys).select(packed, "n", *[c for c in right.columns if c not in keys])
    return join_skewed(left.withColumn("__key", packed), sized, "__key", total, how).drop("__key")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of ``docs(text, lang)``.

    A phrase is dropped if a longer one that holds it has at least ``share`` percent of its count.
    """
    counts, totals = frequent(docs, least)
    long = counts.filter("words > 1").withColumnRenamed("f", "a")
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(w) - 1)), lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.concat_ws(" ", F.slice(w, i, k)))))
    inside = long.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = cut(long.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer"))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), w.alias("w"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("head"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.lit(MAX_N))).alias("tail"))
    cuts = cut(cuts)
    total = cuts.count()
    cuts = _with(cuts, counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"], total)
    cuts = cut(cuts)
    cuts = _with(cuts, counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"], total)
    cuts = cut(cuts)
    cuts = _with(cuts, totals.withColumnRenamed("n", "words"), ["lang"], total).withColumnRenamed("words", "n")
    wide = lambda c: F.col(c).cast("decimal(17,0)")
    score = F.expr("div(cast(1000 as decimal(4,0)) * a0 * n0, l0 * r0)")
    scored = cuts.withColumns({f"{c}0": wide(c) for c in "alrn"}).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("salt")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    plain = F.replace(F.replace(F.replace("lang", F.lit("%09"), F.lit("\t")), F.lit("%20"), F.lit(" ")), F.lit("%25"), F.lit("%"))
    return ranked.select(plain.alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
worded as materialized (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from worded, range(1, {MAX_N + 1}) as t(k) where len(w) >= k),
counts as materialized (select lang, k as words, phrase, count(*) as f from grams group by all having count(*) >= {LEAST}),
cand as (select lang, words, phrase, f as a, string_split(phrase, ' ') as w from counts where words > 1),
inside as (select c.lang, array_to_string(c.w[i:i + k - 1], ' ') as phrase, max(a) as longer from cand c, range(2, {MAX_N}) as s(k), range(1, {MAX_N}) as t(i) where k < words and i + k - 1 <= words group by all),
kept as (select c.* from cand c left join inside i on i.lang = c.lang and i.phrase = c.phrase where longer is null or 100 * longer < {SHARE} * a),
cuts as (select c.lang, c.phrase, c.a, k, h.f as l, t.f as r, n, ((1000::hugeint * a * n) // (h.f::hugeint * t.f))::bigint as score
  from kept c join range(1, {MAX_N}) as s(k) on k < words join counts h on h.lang = c.lang and h.phrase = array_to_string(c.w[1:k], ' ')
  join counts t on t.lang = c.lang and t.phrase = array_to_string(c.w[k + 1:], ' ') join totals on totals.lang = c.lang),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {TOP}"""
