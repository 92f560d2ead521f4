"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause. The lexical one rewrites words as symbols: insult (word stems induced from
labelled rows, each with its weight), threat, target, negation and reported speech (short closed lists). The others copy
symbols and mark what they govern: negation the next words, reported speech the rest of the clause, a target the insults
after it, and a threat becomes a menace once it meets a target. Each arc has a weight; composing the four gives one
deterministic transducer over symbols, in which weights along a path multiply and the marked insults and menaces of a
clause add up. Clause scores, not isolated words, make the features that a logistic output calibrates.

Everything learned comes from a bounded sample of labelled rows (``TRAIN_ROWS``), so the lexicon is bounded as well. A
word is known by its first ``STEM`` letters.

Defined results: null, empty or wordless text gets the score of a text without a match; rows whose id is null are scored
and count as not held out; several labels of one document count as toxic if any is; with no toxic training row no word
is an insult; repeated rows score alike; other columns of any name play no part; a text of any length is one row of work,
linear in its length; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import bounded_sample, crc_mod, cut, table

#: Most labelled rows that are used.
TRAIN_ROWS = 8_000
#: Letters of the longest stem; a whole word of any length counts beside its stems.
STEM = 16
THRESHOLD = 0.7

TARGET = set("you your he him she her they them ye du dich dir ihr euch sie tu te toi vous il elle ils tú usted ustedes ellos ella él vosotros".split())
NEGATION = set("not no never isn't aren't nor nicht kein keine keinen nie niemals pas jamais aucun nunca jamás ningún tampoco".split())
REPORTED = set("said says called claimed reported quoted sagte sagt nannte behauptete dit disait appelé déclaré dijo dice llamó afirmó".split())
THREAT = set("kill hurt destroy beat stab shoot hang umbringen töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
#: Words that a negation governs, and the weights of the arcs.
SCOPE = 3
NEGATED, QUOTED, AIMED, MENACE = 0.5, 0.7, 1.2, 0.5

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


def class_of(word: str) -> str:
    return "N" if word in NEGATION else "T" if word in TARGET else "R" if word in REPORTED else "H" if word in THREAT else "O"


class Transducer:
    """Deterministic weighted transducer: ``arcs[state, symbol] = (next state, output symbol, weight)``."""

    def __init__(self, start, symbols: set[str], rule: Callable):
        self.start, self.symbols, self.arcs = start, symbols, {}
        new = [start]
        while new:
            state = new.pop()
            for x in sorted(symbols):
                arc = rule(state, x)
                self.arcs[state, x] = arc
                if (arc[0], x) not in self.arcs and arc[0] not in new and arc[0] != state:
                    new.append(arc[0])

    def outputs(self) -> set[str]:
        return {out for _, out, _ in self.arcs.values()}

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes; weights multiply."""

        def rule(state, x):
            a, mid, u = self.arcs[state[0], x]
            b, out, v = other.arcs[state[1], mid]
            return (a, b), out, u * v

        return Transducer((self.start, other.start), self.symbols, rule)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        """Output symbols with their weights."""
        state, out = self.start, []
        for x in symbols:
            state, y, w = self.arcs[state, x]
            out.append((y, w))
        return out


def negation(symbols: set[str]) -> Transducer:
    """The next ``SCOPE`` words after a negation: insults weigh less, threats are none."""

    def rule(left, x):
        if x == "N":
            return SCOPE, x, 1.0
        if not left:
            return 0, x, 1.0
        return left - 1, "O" if x == "H" else x, NEGATED if x == "I" else 1.0

    return Transducer(0, symbols, rule)


def reported(symbols: set[str]) -> Transducer:
    """Insults after a verb of speaking weigh less."""
    return Transducer(False, symbols, lambda quoted, x: (quoted or x == "R", x, QUOTED if quoted and x == "I" else 1.0))


def target(symbols: set[str]) -> Transducer:
    """Insults after a target weigh more; a threat after one is a menace."""
    return Transducer(False, symbols, lambda aimed, x: (aimed or x == "T", "M" if aimed and x == "H" else x, AIMED if aimed and x == "I" else 1.0))


def threat(symbols: set[str]) -> Transducer:
    """A target after a threat is a menace; each menace has its weight."""

    def rule(open_, x):
        if x == "M" or x == "T" and open_:
            return False, "M", MENACE
        return open_ or x == "H", x, 1.0

    return Transducer(False, symbols, rule)


def grammar() -> Transducer:
    """Negation, then reported speech, then target, then threat, over the symbols of the lexical transducer."""
    whole = negation({"I", "H", "T", "N", "R", "O"})
    for part in (reported, target, threat):
        whole = whole.then(part(whole.outputs()))
    return whole


def clause_score(symbols: list[tuple[str, float]], fst: Transducer) -> float:
    """Sum of the marked insults (lexical weight times arc weights) and menaces of a clause."""
    return sum((w * u if y == "I" else u) for (_, w), (y, u) in zip(symbols, fst.run([x for x, _ in symbols])) if y in "IM")


def induce(sample: DataFrame, precision: float = 0.75, evidence: float = 12.0) -> dict[str, float]:
    """Word stems (a whole word is one too) that tell toxic rows apart, with log-odds weights.

    Rows are counted per stem in Spark; only stems with ``evidence`` come to the driver: their divergence from the toxic
    share, in nats over all rows, that chance must not reach. The sample is bounded, so these are too.
    """
    n_pos, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_neg = n - n_pos
    if not n_pos or not n_neg:
        return {}
    share = n_pos / n
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{3,}"), 0))
    stems = F.transform(words, lambda w: F.transform(F.sequence(F.lit(3), F.least(F.length(w), F.lit(STEM))), lambda n: F.substring(w, F.lit(1), n)))
    stems = F.array_union(F.flatten(stems), words)
    counts = sample.select("toxic", F.explode(stems).alias("p")).groupBy("p").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    pos, neg, q = F.col("pos"), F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    told = pos * F.log(q / share) + F.when(neg > 0, neg * F.log((1 - q) / (1 - share))).otherwise(0.0)
    good = {r["p"]: (r["pos"], r["neg"]) for r in counts.filter((pos >= 4) & (q >= precision) & (q > share) & (told >= evidence)).collect()}
    # of stems with the same rows the longest says most
    for p in sorted(good):
        if good.get(p[:-1]) == good[p]:
            good.pop(p[:-1])
    chosen: dict[str, float] = {}
    for p in sorted(good, key=lambda p: (-(good[p][0] - 3 * good[p][1]), len(p), p)):
        if not any(p[:k] in chosen for k in range(3, len(p))):
            pos, neg = good[p]
            chosen[p] = float(np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)))
    return chosen


class Grammar:
    """The lexical transducer over a lexicon, followed by ``grammar()``."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.fst = lexicon, grammar()
        stems = sorted(lexicon, key=len, reverse=True) + sorted(THREAT)
        self.hit = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, stems)) + ")")
        self.cache: dict[str, tuple[str, float]] = {}
        self.sizes = sorted({len(p) for p in lexicon})

    def symbol(self, word: str) -> tuple[str, float]:
        got = self.cache.get(word)
        if got is None:
            w = max((self.lexicon.get(word[:n], 0.0) for n in self.sizes if n <= len(word)), default=0.0)
            got = ("I", w) if w > 0 else (class_of(word), 0.0)
            if len(self.cache) < 200_000:
                self.cache[word] = got
        return got

    def features(self, text: str | None) -> tuple[float, float, float]:
        """log(1 + clause scores), log(1 + matched clauses), log(1 + different insult words)."""
        t = (text or "").lower()
        if not self.hit.search(t):
            return 0.0, 0.0, 0.0
        total, clauses, words = 0.0, 0, set()
        for clause in _CLAUSE.split(t):
            if self.hit.search(clause):
                ws = _WORD.findall(clause)
                symbols = [self.symbol(w) for w in ws]
                score = clause_score(symbols, self.fst)
                if score > 0:
                    total, clauses = total + score, clauses + 1
                    words.update(w for w, (s, _) in zip(ws, symbols) if s == "I")
        return float(np.log1p(total)), float(np.log1p(clauses)), float(np.log1p(len(words)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method; the intercept is the last weight."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + keep
        w -= np.linalg.solve(h, a.T @ (p - y) + keep @ w)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic): at most about ``rows`` labelled rows outside the held-out third. The label side is cut to its bound first, so the join broadcasts it and moves no text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    few = bounded_sample(known.filter(crc_mod("doc_id", 3) != 1), "doc_id", rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select("text", "toxic")


def fit(sample: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and output weights from (text, toxic); equal texts count once."""
    sample = cut(sample.withColumn("toxic", (F.col("toxic") == 1).cast("int")).groupBy("text").agg(F.max("toxic").alias("toxic")))
    lexicon = induce(sample)
    x = sample.select(features_column(sample.sparkSession, lexicon)("text").alias("f"), "toxic").select("f.*", "toxic").toPandas()
    weights = logistic(x[["a", "b", "c"]].to_numpy(float), (x["toxic"] == 1).to_numpy(float)) if len(x) else np.array([0.0, 0.0, 0.0, -3.0])
    return lexicon, weights


def features_column(spark: SparkSession, lexicon: dict[str, float]):
    shared = spark.sparkContext.broadcast(lexicon)
    kept: dict = {}

    @F.pandas_udf("a double, b double, c double")
    def features(texts: pd.Series) -> pd.DataFrame:
        if "g" not in kept:
            kept["g"] = Grammar(shared.value)
        return pd.DataFrame([kept["g"].features(t) for t in texts], columns=["a", "b", "c"])

    return features


def scorer(spark: SparkSession, lexicon: dict[str, float], weights: np.ndarray):
    """Column function: text -> score."""
    features = features_column(spark, lexicon)

    def score(text):
        f = features(text)
        z = f["a"] * float(weights[0]) + f["b"] * float(weights[1]) + f["c"] * float(weights[2]) + float(weights[3])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    return score


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = scorer(spark, *fit(labelled_sample(docs, table(spark, sf_dir, "labels"))))
    return docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), score(F.col("text").cast("string")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
