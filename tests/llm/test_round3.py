"""Vector codes, collocations and language-model scores against plain versions, with the awkward cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from evifuse.llm import codes, phrases, ppm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- vector codes ----------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(id, code, error, label error, digest) with Python's whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = [len(v) for _, v, _ in order if v and len(v) % parts == 0][:1]
    kept, order = ([r for r in x if [len(r[1])] == wide] for x in (kept, order))
    if not kept:
        return []
    w = wide[0] // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = collections.defaultdict(list)
            for _, v, _ in kept:
                got[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(got[e]) for c in zip(*got[e])] if e in got else y for e, y in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    out, by = [], collections.Counter()
    for i, v, label in kept:
        d = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in d), sum(x for x, _ in d), label, digest))
        by[label] += out[-1][2]
    return [(i, c, e, by[label], h) for i, c, e, label, h in out]


VECTORS = "vec_id long, embedding array<double>, label int, code string, v string, n int, error long"


@pytest.mark.parametrize("n", [0, 1, 9, 300])
def test_vector_codes(spark, tmp_path, n):
    r = np.random.RandomState(n)
    rows = [(i * 7 % 997, [float(x) for x in v], None if i % 5 == 0 else i % 3) for i, v in enumerate(r.normal(size=(n, 16)) * 3)]
    if n == 300:
        rows += rows[:5] + [(None, rows[3][1], 1), (5000, None, 1), (5001, rows[1][1][:15] + [None], 1), (5002, [float("nan")] * 16, 1), (5003, [float("inf")] * 16, 1), (5004, [], 1), (5005, [1.0] * 8, 1), (-1, [0.5] * 7, 1), (5006, [-1e-9] * 16, 2)]
    spark.createDataFrame([(*x, "c", "v", 1, 2) for x in rows], VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(x) for x in codes.op12_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=str) == sorted(plain_codes(rows), key=str)


def test_vector_codes_refuse_what_could_wrap(spark, tmp_path):
    spark.createDataFrame([(1, [1e30] * 8, 0)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(ArithmeticError):
        codes.op12_vector_codes(spark, str(tmp_path)).collect()


# --- collocations ----------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, share=100, top=2000):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, a in own.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * a >= share * counts[q[i : i + k]]}
        scored = []
        for p, a in own.items():
            if p not in gone:
                s, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


DOCS = "doc_id long, text string, lang string, w string, key string, n long, rank int, hot boolean, f long"


def test_collocations(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = ["the", "of", "Ünï", "ﬀ", "a\x01", "b", "new", "york", "x" * 40, "city", "state", "\x1c", "ÄB"]
    text = lambda k: "".join(r.choice(vocabulary[: r.randint(2, 13)]) + r.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", " the of "]) for _ in range(k))
    rows = [(text(r.randint(0, 60)), r.choice(["en", "en", "en", None, "d e%\t", "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), ("word " * 3000 + "end of", "en"), (text(9000), "en"), ("the of " * 4000, "x"), (". , ;", "en"), ("One two one two", "en")] + [("new york city of the state", "en")] * 30
    df = spark.createDataFrame([(i % 100, t, g, "w", "k", 1, 2, True, 3) for i, (t, g) in enumerate(rows)], DOCS).repartition(3)
    for run, least in ((phrases.RUN, 20), (300, 7)):
        # texts beyond the run are read in slices
        monkeypatch.setattr(phrases, "RUN", run)
        got = sorted(tuple(x) for x in phrases.collocations(df, least, top=40).collect())
        assert got == plain_phrases(rows, least, top=40) and len(got) > 60
        monkeypatch.undo()
    loose = sorted(tuple(x) for x in phrases.collocations(df, 10, share=60).collect())
    assert loose == plain_phrases(rows, 10, share=60)
    assert phrases.collocations(df.limit(0)).collect() == []


def test_suffix_rows_grow_with_the_texts(spark, monkeypatch):
    """Five times the texts make no more than nine times the suffixes in all, though far more phrases reach the threshold; a round makes one a word at most."""
    r, plain = random.Random(6), phrases._suffixes
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 3) for i in range(400)]
    texts = [" ".join(r.choices(vocabulary, weights, k=200)) for _ in range(300)]
    made = []
    for part in (texts[:60], texts):
        rounds = []

        def counted(*a, rounds=rounds):
            rows, make = spark.sparkContext.accumulator(0), plain(*a)
            rounds.append(rows)

            def run_task(batches):
                for b in make(batches):
                    rows.add(b.num_rows)
                    yield b

            return run_task

        monkeypatch.setattr(phrases, "_suffixes", counted)
        df = spark.createDataFrame([(t, "en") for t in part], "text string, lang string").repartition(4)
        assert sorted(tuple(x) for x in phrases.collocations(df, 20, top=50).collect()) == plain_phrases([(t, "en") for t in part], 20, top=50)
        made.append([x.value for x in rounds])
    few, many = made
    assert sum(many) <= 9 * sum(few) and max(many) <= 200 * len(texts), made


# --- language model --------------------------------------------------------------------------------------------------


def plain_ppm(training, texts, shares):
    """log10 of the probability by walking contexts from long to short, with dictionaries."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    raw = lambda t: low(t).encode()
    symbols = lambda t: (b"\xff" * ppm.ORDER + raw(t) + b"\xff")
    total = 0
    for t in training:
        s = symbols(t)
        for i in range(ppm.ORDER, len(s)):
            total += 1
            for j in range(ppm.ORDER + 1):
                counts[j][s[i - j : i]][s[i]] += 1
    kept = [{c: {x: n for x, n in d.items() if n * shares >= total} for c, d in by.items()} for by in counts]

    def log(context, x):
        out, seen = 0.0, {}
        for j in range(ppm.ORDER, -1, -1):
            c = context[len(context) - j :]
            own = kept[j].get(c, {})
            if not own:
                continue
            left = {s: n for s, n in own.items() if s not in seen}
            escape = sum(counts[j][c].values()) - sum(own.values()) + len(left)
            size = sum(left.values()) + escape
            if x in left:
                return out + math.log10(left[x] / size)
            if left:
                out += math.log10(escape / size)
            seen = own
        return out - math.log10(256 - len(kept[0].get(b"", {})))

    return [sum(log(s[i - ppm.ORDER : i], s[i]) for i in range(ppm.ORDER, len(s))) for s in map(symbols, texts)]


def lm_rows():
    r = random.Random(6)
    para = lambda k: " ".join(r.choice(["the", "An", "quite", "Ünï", "ﬀ", "re", "tion", "\x0b", "x\x1cy"]) for _ in range(k))
    rows = [(i, para(r.randint(0, 60))) for i in range(120)]
    return rows + rows[:4] + [(500, None), (501, ""), (None, "no id here"), (502, " \t\n"), (503, "the An " * 3000), (504, "unseen zebra \U0001f600 words"), (505, "x" * 9000)]


@pytest.mark.parametrize("step", [None, 500])
def test_lm_scores(spark, monkeypatch, step):
    if step:
        monkeypatch.setattr(ppm, "STEP", step)
        monkeypatch.setattr(ppm, "CHUNK", 3 * step)
    rows = lm_rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    training = [t for i, t in rows if i is not None and not held(i)]
    c = collections.Counter(w for t in training for w in WORD.findall(low(t)))
    tokens, distinct, ends = sum(c.values()) + len(training), len(c) + 1, len(training)
    floor = math.log10(tokens + 0.5 * (distinct + 1))
    df = spark.createDataFrame([(i, t, "clash", 1, 2.0) for i, t in rows], "doc_id long, text string, w string, c int, score double").repartition(3)
    for shares in (1 << 21, 400):
        got = sorted((tuple(x) for x in ppm.scores(df, shares=shares).collect()), key=str)
        want = []
        for (i, t), s in zip(rows, plain_ppm(training, [t for _, t in rows], shares)):
            w = WORD.findall(low(t))
            want.append((i, held(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, tokens, sum(math.log10(c[x] + 0.5) - floor for x in w) + math.log10(ends + 0.5) - floor, s))
        assert [x[:5] for x in got] == [x[:5] for x in sorted(want, key=str)]
        for a, b in zip(got, sorted(want, key=str)):
            assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-4, abs=1e-3)


def test_lm_without_training_rows(spark):
    df = spark.createDataFrame([(None, "ab"), (None, None)], "doc_id long, text string")
    got = sorted(tuple(x) for x in ppm.scores(df).collect())
    assert [x[:5] for x in got] == [(None, False, 1, 0, 0), (None, False, 2, 0, 0)]
    assert got[0][6] == pytest.approx(-math.log10(256), abs=1e-5) and got[1][6] == pytest.approx(-3 * math.log10(256), abs=1e-5)
    assert all(x[5] == pytest.approx(0) for x in got)
    assert ppm.scores(df.limit(0)).collect() == []


def test_lm_probabilities_sum_to_one(spark):
    rows = lm_rows()
    df = spark.createDataFrame([(t,) for _, t in rows], "text string")
    trie = ppm.fit(df, sum(len((t or "").encode()) + 1 for _, t in rows), 2000)
    for context in (b"the a", b"\xff\xff\xff\xff\xff", b"zzzzz", b"n the", "ünï".encode()[:5]):
        base = int.from_bytes(context, "big") << 8
        assert (10 ** trie.log10(base + np.arange(256))).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("known", [1, 60])
def test_lm_rare_grams_cost_the_same(spark, monkeypatch, known):
    """Grams that are not broadcast meet what they cost by a join; the result is that of all counts."""
    monkeypatch.setattr(ppm, "KNOWN", known)
    monkeypatch.setattr(ppm, "CHUNK", 2000)
    monkeypatch.setattr(ppm, "STEP", 700)
    rows = lm_rows()
    training = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id or -1, x.score) for x in ppm.scores(df).collect())
    want = sorted((i or -1, s) for (i, _), s in zip(rows, plain_ppm(training, [t for _, t in rows], 1 << 40)))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-4, abs=1e-3)


def test_lm_learns_what_a_large_corpus_holds_once(spark):
    """Before, entries with less than 1/2^21 of the training bytes were left out, so a passage that training holds scored as one that it does not."""
    r = random.Random(2)
    passage, other = ("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(300)) for _ in range(2))
    rows = [(1, "a plain text of the same words " * 160_000), (2, passage), (3, passage), (4, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trains = df["doc_id"] <= 2
    got = {x.doc_id: x.score for x in ppm.scores(df, ~trains, trains).collect()}
    assert got[3] == got[2] > 0.5 * got[4]
