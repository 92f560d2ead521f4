"""Language-model scores: prediction by partial matching over bytes, and a word model beside it.

The byte model is pretrained. Every byte of the training texts (A-Z lowered; four marks before each text, one as its end)
counts under the ``ORDER`` bytes before it; Spark adds those counts over all training documents. Nothing is left out: each
different gram of the corpus (a symbol and the bytes before it) is judged once, by all counts. It is judged from the longest
context that training holds: an unseen symbol costs the escape (method C, distinct symbols against their count), and every
shorter context excludes the symbols of the longer one. Below the empty context all symbols left are alike. Grams meet by the
``LOW + 1`` bytes before the symbol, at most 2^24 of them, which decide all longer contexts; counts of contexts up to ``LOW``
bytes are at most 2^24 in all and are broadcast.

Grams with at least 1/``KNOWN`` of the training bytes, at most ``KNOWN`` at any size of the corpus, are broadcast with what
they cost, and texts look them up. All others are rare, so no hot keys: a chunk of texts asks for each once, and the answers
come back to it beside the counts of its words.

The word model needs the count of any word anywhere, so no vocabulary is broadcast: tasks cut what they read into chunks of
``CHUNK`` bytes and write each as its distinct words and rare grams and its documents as numbers of those (gaps between them, in binary columns). Counts are summed by
word and come back to the chunks as numbers; texts never shuffle. A word stands once in a chunk, so a frequent one is no
hot key.

Defined results: a null text is empty and has one token, its end; rows without an id are scored, count as not held out and do
not train; repeated rows train and score each, alike; texts of any length are read whole, in slices; without training
documents every symbol costs 1/256 and every token log10(1); other columns of any name play no part; an empty table gives
no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evifuse.llm.common import crc_mod, remove, shared_dir, table

ORDER = 5
#: Contexts of up to LOW bytes are broadcast.
LOW = 2
#: Grams with at least 1/KNOWN of the training bytes are looked up where texts are; the others meet them by joins.
KNOWN = 1 << 23
#: No byte of UTF-8: it stands before and after each text.
END = 0xFF
#: Bytes of text in a chunk, and in one step of a task.
CHUNK, STEP = 1 << 22, 1 << 20
#: Log-probabilities are multiples of 1/GRAIN, so sums do not depend on the steps.
GRAIN = 1 << 20


def _pieces(text: bytes):
    """Grams of ORDER bytes and a symbol, of the text and its end, in steps."""
    text = text.lower()
    for at in range(0, len(text) + 1, STEP):
        before = text[max(0, at - ORDER) : at]
        own = b"\xff" * (ORDER - len(before)) + before + text[at : at + STEP] + (b"\xff" if at + STEP > len(text) else b"")
        a = np.frombuffer(own, np.uint8).astype(np.uint64)
        n = len(a) - ORDER
        g = a[:n].copy()
        for j in range(1, ORDER + 1):
            g = g << np.uint64(8) | a[j : j + n]
        yield g


def _texts(column: pa.Array):
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def _count_grams(batches):
    """(g, n): the grams of about STEP bytes at a time, and how often they stand in training texts; Spark adds those of a task before they shuffle."""
    held, size = [], 0

    def counted():
        k = np.sort(np.concatenate(held))
        g = k >> np.uint64(1)
        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(g[new].astype(np.int64)), pa.array(np.add.reduceat((k & np.uint64(1)).astype(np.int64), new))], names=["g", "n"])

    for b in batches:
        for text, trains in zip(_texts(b.column("text")), b.column("trains").to_pylist()):
            for g in _pieces(text):
                held.append(g << np.uint64(1) | np.uint64(bool(trains)))
                size += len(g)
                if size >= STEP:
                    yield counted()
                    held, size = [], 0
    if held:
        yield counted()


class Trie:
    """Sorted entries and contexts by order, with log10 of what coding there costs."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]):
        """By order: (gram, count) of the kept entries, and (context, count of all its symbols)."""
        self.entries, self.contexts, self.log_count = [], [], []
        kept, distinct, total = [], [], []
        for (g, n), (c, t) in zip(entries, totals):
            at, by = np.argsort(g), np.argsort(c)
            g, n, c, t = g[at], n[at], c[by], t[by]
            node = np.searchsorted(c, g >> 8)
            self.entries.append(g)
            self.contexts.append(c)
            self.log_count.append(np.log10(n.astype(float)) if len(n) else np.zeros(0))
            kept.append(np.bincount(node, n, len(c)))
            distinct.append(np.bincount(node, minlength=len(c)).astype(float))
            total.append(t.astype(float))
        self.first, self.later = [], []
        with np.errstate(divide="ignore"):
            for j, c in enumerate(self.contexts):
                # coded first: the escape weighs as its distinct symbols and what the trie leaves out
                out = total[j] - kept[j] + distinct[j]
                self.first.append((np.log10(total[j] + distinct[j]), np.log10(out)))
                if not j:
                    self.later.append(None)
                    continue
                # coded after this context escaped, in the context a byte shorter, without this one's symbols
                up = np.searchsorted(self.contexts[j - 1], c & (1 << 8 * (j - 1)) - 1)
                g = self.entries[j]
                own = np.searchsorted(self.entries[j - 1], g & (1 << 8 * j) - 1)
                seen = np.bincount(np.searchsorted(c, g >> 8), np.round(10 ** self.log_count[j - 1][own]), len(c))
                rest = kept[j - 1][up] - seen
                out = total[j - 1][up] - kept[j - 1][up] + distinct[j - 1][up] - distinct[j]
                # nothing is left there: the escape is certain
                sure = rest <= 0
                self.later.append((np.where(sure, 0, np.log10(rest + out)), np.where(sure, 0, np.log10(out))))
        left = 256 - (len(self.entries[0]) if self.entries else 0)
        self.least = -np.log10(left) if left else 0.0

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's symbol after its context."""
        out = np.zeros(len(grams))
        open_, child = np.arange(len(grams)), np.full(len(grams), -1)
        for j in range(len(self.contexts) - 1, -1, -1):
            if not len(open_) or not len(self.contexts[j]):
                continue
            g = grams[open_] & (1 << 8 * (j + 1)) - 1
            c = g >> 8
            node = np.minimum(np.searchsorted(self.contexts[j], c), len(self.contexts[j]) - 1)
            here = self.contexts[j][node] == c
            entry = np.minimum(np.searchsorted(self.entries[j], g), len(self.entries[j]) - 1)
            found = here & (self.entries[j][entry] == g)
            after = child[open_]
            size, out_of = self.first[j][0][node], self.first[j][1][node]
            later = here & (after >= 0)
            if later.any():
                size[later], out_of[later] = self.later[j + 1][0][after[later]], self.later[j + 1][1][after[later]]
            out[open_[found]] += self.log_count[j][entry[found]] - size[found]
            lost = here & ~found
            out[open_[lost]] += out_of[lost] - size[lost]
            child[open_[here]] = node[here]
            open_ = open_[~found]
        out[open_] += self.least
        return np.round(out * GRAIN) / GRAIN


def _grams(texts: DataFrame) -> DataFrame:
    """(g, n): every gram of ``texts(text, trains)`` and its count in the training texts, 0 if only others hold it."""
    return texts.select("text", "trains").mapInArrow(_count_grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def _nodes(grams: DataFrame, orders: int, total: int, shares: int | None):
    """What ``Trie`` takes, for the first ``orders`` orders of ``grams(g, n)``."""
    masks = F.array(*[F.lit((1 << 8 * (j + 1)) - 1).cast("long") for j in range(orders)])
    counts = grams.filter("n > 0").select("n", "g", F.posexplode(masks).alias("j", "mask")).groupBy("j", F.col("g").bitwiseAND(F.col("mask")).alias("g")).agg(F.sum("n").alias("n"))
    # at most 256 symbols a context
    kept = F.collect_list(F.when(F.lit(True) if shares is None else F.col("n") * shares >= total, F.struct("g", "n")))
    nodes = counts.groupBy("j", F.shiftright("g", 8).alias("c")).agg(F.sum("n").alias("t"), kept.alias("kept")).filter(F.size("kept") > 0)
    got = nodes.select("j", "c", "t", "kept.g", "kept.n").toPandas()
    flat = lambda x: np.concatenate([np.asarray(y, np.int64) for y in x]) if len(x) else np.zeros(0, np.int64)
    by = [got[got["j"] == j] for j in range(orders)]
    return [(flat(x["g"]), flat(x["n"])) for x in by], [(x["c"].to_numpy(np.int64), x["t"].to_numpy(np.int64)) for x in by]


def fit(texts: DataFrame, total: int, shares: int | None = None) -> Trie:
    """The model of few ``texts(text)``, which have ``total`` bytes and ends, in one trie; ``shares`` as in ``scores``."""
    return Trie(*_nodes(_grams(texts.select("text", F.lit(True).alias("trains"))), ORDER + 1, total, shares))


def _judge(low, total: int, shares: int | None):
    def longer(g, n):
        """Entries and contexts of the orders above LOW."""
        g, n = g[n > 0], n[n > 0]
        for j in range(LOW + 1, ORDER + 1):
            e, at = np.unique(g & (1 << 8 * (j + 1)) - 1, return_inverse=True)
            k = np.bincount(at, n, len(e)).astype(np.int64)
            c, node = np.unique(e >> 8, return_inverse=True)
            t = np.bincount(node, k, len(c)).astype(np.int64)
            kept = np.full(len(e), True) if shares is None else k * shares >= total
            own = np.unique(node[kept])
            yield (e[kept], k[kept]), (c[own], t[own])

    def judged(g, n):
        entries, totals = low.value
        more = list(longer(g, n))
        logs = Trie([*entries, *(x for x, _ in more)], [*totals, *(x for _, x in more)]).log10(g)
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(np.round(logs * GRAIN).astype(np.int64))], names=["g", "n", "c"])

    def run_task(batches):
        """(g, n, c): c is log10 of the probability of each gram's symbol after its context, times GRAIN. Grams come in order of the LOW + 1 bytes before the symbol; those with equal ones stay together."""
        g, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < STEP:
                continue
            g, n = (np.concatenate([x, *(y.column(k).to_numpy() for y in held)]) for k, x in enumerate((g, n)))
            held, suffix = [], g >> 8 & (1 << 8 * (LOW + 1)) - 1
            at = int(np.searchsorted(suffix, suffix[-1]))
            if at:
                yield judged(g[:at], n[:at])
            g, n, size = g[at:], n[at:], 0
        g, n = (np.concatenate([x, *(y.column(k).to_numpy() for y in held)]) for k, x in enumerate((g, n)))
        if len(g):
            yield judged(g, n)

    return run_task


def _look_up(known: tuple[np.ndarray, np.ndarray], texts: list[bytes]):
    """What the known grams of each text cost, and (text, gram, count) of its others; equal grams of about STEP bytes are looked up once."""
    total, others = np.zeros(len(texts), np.int64), [np.zeros((3, 0), np.int64)]
    # a gram and the number of its text in the step, in one key
    bits = np.uint64(64 - 8 * (ORDER + 1))
    held, size, first = [], 0, 0

    def add():
        s = np.sort(np.concatenate(held))
        new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        n, s = np.diff(np.append(new, len(s))), s[new]
        g, at = (s >> bits).astype(np.int64), (s & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
        fresh = np.concatenate([[True], g[1:] != g[:-1]])
        entry = np.searchsorted(known[0], g[fresh])
        here = np.append(known[0], -1)[entry] == g[fresh]
        cost = np.where(here, np.append(known[1], 0)[entry], 0)
        back = np.cumsum(fresh) - 1
        sums = np.bincount(at, cost[back] * n).astype(np.int64)
        total[first : first + len(sums)] += sums
        rest = ~here[back]
        others.append(np.stack([at[rest] + first, g[rest], n[rest]]))

    for i, text in enumerate(texts):
        for g in _pieces(text):
            if held and (size >= STEP or i - first >> int(bits)):
                add()
                held, size = [], 0
            if not held:
                first = i
            held.append(g << bits | np.uint64(i - first))
            size += len(g)
    if held:
        add()
    return total, np.concatenate(others, axis=1)


def _tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts, with the number of the text each comes from."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    parent, words = pc.list_parent_indices(split), split.flatten()
    good = pc.not_equal(words, "")
    return words.filter(good).dictionary_encode(), parent.filter(good).to_numpy()


def _steps(texts: pa.Array):
    """(indices, texts): neighbours of about STEP bytes; a longer text alone, in slices cut after a blank."""
    size = pc.binary_length(texts).to_numpy()
    for i in np.flatnonzero(size > STEP).tolist():
        data, at = texts[i].as_buffer().to_pybytes(), 0
        while at < len(data):
            end = min((x for x in (data.find(c, at + STEP) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0), default=len(data))
            yield np.array([i]), pa.array([data[at:end]], pa.binary()).cast(pa.string())
            at = end
    short = np.flatnonzero(size <= STEP)
    for part in np.split(short, np.flatnonzero(np.diff(np.cumsum(size[short]) // STEP)) + 1):
        if len(part):
            yield part, texts.take(pa.array(part))


def _chunks(batches):
    """Record batches of about CHUNK bytes of text; a longer text alone."""
    held, size = [], 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(lengths > CHUNK).tolist():
            yield b.slice(i, 1)
        short = np.flatnonzero(lengths <= CHUNK)
        for part in np.split(short, np.flatnonzero(np.diff(np.cumsum(lengths[short]) // CHUNK)) + 1):
            if len(part):
                held.append(b.take(pa.array(part)))
                size += int(lengths[part].sum())
                if size >= CHUNK:
                    yield pa.concat_batches(held)
                    held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _planes(x: np.ndarray) -> bytes:
    """int32 numbers by place of their bytes: the high places are nearly all zero, which compression removes."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _whole(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)


def _lists(d: np.ndarray, w: np.ndarray, k: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Gaps between the numbers ``w``, and the counts ``k``, of each of ``n`` documents; ``d``, the document of each, is in order, and so are its numbers."""
    ends = np.searchsorted(d, np.arange(n + 1))
    gaps = np.diff(w, prepend=0)
    gaps[ends[:-1][np.diff(ends) > 0]] = w[ends[:-1][np.diff(ends) > 0]]
    cut = lambda x: pa.array([_planes(x[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
    return cut(gaps), cut(k)


_SURVEY = "kind int, chunk long, id int, w string, c long, g long, {doc_id}, held_out boolean, trains boolean, n_tokens long, score double, ids binary, ks binary, gids binary, gks binary"


def _survey(known):
    def run_task(batches):
        """Three kinds of rows: 0, the distinct words of a chunk by number with their counts in its training texts; 1, its distinct rare grams by number; 2, its documents as numbers and counts of both, with what their known grams cost."""
        task = TaskContext.get().partitionId() << 32
        for seq, b in enumerate(_chunks(batches)):
            texts, trains = pc.fill_null(b.column("text"), ""), b.column("trains").to_numpy(zero_copy_only=False)
            names, docs, numbers, counts = [], [], [], []
            for rows, some in _steps(texts):
                words, parent = _tokens(some)
                pair, k = np.unique(rows[parent] << 32 | words.indices.to_numpy(), return_counts=True)
                docs.append(pair >> 32)
                numbers.append((pair & (1 << 32) - 1) + sum(map(len, names)))
                counts.append(k)
                names.append(words.dictionary)
            none = np.zeros(0, np.int64)
            found = pa.concat_arrays(names or [pa.array([], pa.string())]).dictionary_encode()
            # the same word of several steps has one number
            d, k = np.concatenate([*docs, none]), np.concatenate([*counts, none])
            w = found.indices.to_numpy()[np.concatenate([*numbers, none])].astype(np.int64)
            if len(texts) == 1:
                w, at = np.unique(w, return_inverse=True)
                k, d = np.bincount(at, k, len(w)).astype(np.int64), np.zeros(len(w), np.int64)
            else:
                order = np.argsort(d << 32 | w)
                d, w, k = d[order], w[order], k[order]
            c = np.bincount(w, k * trains[d], len(found.dictionary)).astype(np.int64)
            ids, ks = _lists(d, w, k, len(texts))
            cost, (in_text, rare, times) = _look_up(known.value, list(_texts(texts)))
            rare, number = np.unique(rare, return_inverse=True)
            order = np.argsort(in_text << 32 | number)
            gids, gks = _lists(in_text[order], number[order], times[order], len(texts))
            n = np.bincount(d, k, len(texts)).astype(np.int64) + 1
            for kind, size, own in (
                (0, len(c), {"id": pa.array(np.arange(len(c), dtype=np.int32)), "w": found.dictionary, "c": pa.array(c)}),
                (1, len(rare), {"id": pa.array(np.arange(len(rare), dtype=np.int32)), "g": pa.array(rare)}),
                (2, len(texts), {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "trains": b.column("trains"), "n_tokens": pa.array(n), "score": pa.array(cost / GRAIN), "ids": ids, "ks": ks, "gids": gids, "gks": gks}),
            ):
                own |= {"kind": pa.array(np.full(size, kind, np.int32)), "chunk": pa.array(np.full(size, task | seq))}
                types = {"id": pa.int32(), "w": pa.string(), "c": pa.int64(), "g": pa.int64(), "doc_id": b.schema.field("doc_id").type, "held_out": pa.bool_(), "trains": pa.bool_(), "n_tokens": pa.int64(), "score": pa.float64(), "ids": pa.binary(), "ks": pa.binary(), "gids": pa.binary(), "gks": pa.binary()}
                yield pa.RecordBatch.from_pydict({f: own.get(f, pa.nulls(size, types.get(f))) for f in ("kind", "chunk", *types)})
            pa.default_memory_pool().release_unused()

    return run_task


def _answer(ends: int, tokens: int, floor: float):
    def run_task(batches):
        """Scores of the documents of each chunk; the counts of its words and what its rare grams cost come before them."""
        chunk, found = None, {}
        for b in batches:
            cuts = np.flatnonzero(np.diff(b.column("chunk").to_numpy()) | np.diff(b.column("kind").to_numpy())) + 1
            for part in np.split(np.arange(b.num_rows), cuts):
                if not len(part):
                    continue
                own = b.slice(part[0], len(part))
                if own.column("chunk")[0].as_py() != chunk:
                    chunk, found = own.column("chunk")[0].as_py(), {0: np.zeros(0, np.int64), 1: np.zeros(0, np.int64)}
                kind = own.column("kind")[0].as_py()
                if kind in found:
                    at = own.column("id").to_numpy()
                    if len(found[kind]) <= at.max():
                        found[kind] = np.concatenate([found[kind], np.zeros(int(at.max()) + 1, np.int64)])
                    found[kind][at] = own.column("c").to_numpy()
                    continue

                def of(kind, ids, ks):
                    """Document, value and count of each number."""
                    none = [np.zeros(0, np.int64)]
                    i = np.concatenate([*(np.cumsum(_whole(x)) for x in own.column(ids).to_pylist()), *none])
                    doc = np.repeat(np.arange(len(part)), pc.binary_length(own.column(ids)).to_numpy() // 4)
                    k = np.concatenate([*map(_whole, own.column(ks).to_pylist()), *none])
                    return doc, np.append(found[kind], 0)[np.minimum(i, len(found[kind]))], k

                doc, c, k = of(0, "ids", "ks")
                base = np.bincount(doc, k * (np.log10(c + 0.5) - floor), len(part)) + (np.log10(ends + 0.5) - floor)
                n_known = np.bincount(doc, k * (c > 0), len(part)).astype(np.int64) + (ends > 0)
                doc, c, k = of(1, "gids", "gks")
                score = own.column("score").to_numpy() + np.bincount(doc, k * c, len(part)) / GRAIN
                yield pa.RecordBatch.from_arrays([*(own.column(f) for f in ("doc_id", "held_out", "n_tokens")), pa.array(n_known), pa.array(np.full(len(part), tokens)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run_task


def _costs(spark: SparkSession, rows: DataFrame, total: int, shares: int | None, root: str) -> DataFrame:
    """(g, n, c) of every gram of ``rows(text, trains)``, written below ``root``: its count in training and what its symbol costs there, times GRAIN."""
    _grams(rows).write.parquet(f"{root}/grams")
    grams = spark.read.parquet(f"{root}/grams")
    low = spark.sparkContext.broadcast(_nodes(grams, LOW + 1, total, shares))
    suffix = F.shiftright("g", 8).bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1).cast("long"))
    grams.select("g", "n").repartition(suffix).sortWithinPartitions(suffix).mapInArrow(_judge(low, total, shares), "g long, n long, c long").write.parquet(f"{root}/costs")
    remove(spark, f"{root}/grams")
    return spark.read.parquet(f"{root}/costs")


def scores(docs: DataFrame, held_out=None, trains=None, shares: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for ``docs(doc_id, text)``; the models learn from rows where ``trains`` holds.

    With ``shares``, entries with less than 1/``shares`` of the training bytes only weigh in the escape of their context.
    """
    spark = docs.sparkSession
    mod = crc_mod("doc_id", 5)
    held_out = mod == 1 if held_out is None else held_out
    trains = F.col("doc_id").isNotNull() & (mod != 1) if trains is None else trains
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"), trains.alias("trains"))
    size, ends = rows.filter("trains").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    root, kind = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    costs = _costs(spark, rows, size + ends, shares, root)
    common = (F.col("n") > 0) & (F.col("n") * KNOWN >= size + ends)
    few = costs.filter(common).select("g", "c").toPandas().sort_values("g")
    known = spark.sparkContext.broadcast((few["g"].to_numpy(np.int64), few["c"].to_numpy(np.int32)))
    rows.mapInArrow(_survey(known), _SURVEY.format(doc_id=kind)).write.partitionBy("kind").parquet(f"{root}/survey")
    schema = _SURVEY.format(doc_id=kind)
    survey = spark.read.schema(schema).parquet(f"{root}/survey")
    of_word = W.partitionBy("w")
    words = survey.filter("kind = 0").select("chunk", "id", F.sum("c").over(of_word).alias("c"), (F.row_number().over(of_word.orderBy("chunk", "id")) == 1).alias("first"))
    words.filter("c > 0").write.parquet(f"{root}/words")
    remove(spark, f"{root}/survey/kind=0")
    words = spark.read.parquet(f"{root}/words")
    n, v = words.agg(F.sum(F.when(F.col("first"), F.col("c"))), F.count_if("first")).first()
    tokens, distinct = (n or 0) + ends, v + (ends > 0)
    floor = float(np.log10(tokens + 0.5 * (distinct + 1)))
    # a rare gram stands once in a chunk
    rare = survey.filter("kind = 1").select("chunk", "id", "g").join(costs.filter(~common).select("g", "c"), "g").select(F.lit(1).alias("kind"), "chunk", "id", "c")
    own = survey.filter("kind = 2").select("kind", "chunk", "doc_id", "held_out", "n_tokens", "score", "ids", "ks", "gids", "gks")
    found = words.select(F.lit(0).alias("kind"), "chunk", "id", "c").unionByName(rare)
    both = found.unionByName(own, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return both.mapInArrow(_answer(ends, tokens, floor), f"{kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
