"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased, non-letters become one blank code, and runs of 1, 2 and 3 characters hash into a fixed
number of columns. The log-probability matrix (columns x languages, so bounded) is broadcast; the n-grams of a batch of
texts form a sparse matrix that numpy multiplies with it.

Defined results: null text or text without a letter gives ``und`` with score 0, and the stage drops it; rows with a null
label or id do not train; rows without an id are predicted and count as not held out; repeated rows score alike and stay;
texts of any length are read whole, in pieces; an empty training table gives ``und`` everywhere; ties go to the first
language by name; other columns of any name stay; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import bounded_sample, boxed, crc_mod, table, unboxed

BUCKETS = 1 << 16
#: Most labelled rows that the model is fitted on.
TRAIN_ROWS = 12_000
#: Evidence counts as that of so many n-grams at most when log-probabilities become a score.
EVIDENCE = 48
_CHUNK = 1 << 20
_LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)])


def letter_codes(text: str) -> np.ndarray:
    """Code points with non-letters set to a blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = _LETTER[np.minimum(c, 0xFFFF)]
    if c.size and c.max() > 0xFFFF:
        high = {x: unicodedata.category(chr(x))[0] == "L" for x in np.unique(c[c > 0xFFFF]).tolist()}
        low = low.copy()
        for x, is_letter in high.items():
            low[c == x] = is_letter
    return np.where(low, c, np.uint32(32)).astype(np.uint64)


def ngram_columns(codes: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Hashed columns of all 1-, 2- and 3-grams that begin in [start, stop)."""
    c = codes[start : stop + 2]
    n = min(stop, len(codes)) - start
    a = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    b = (a[:-1] ^ (a[:-1] >> np.uint64(29))) * np.uint64(31) + a[1:]
    d = (b[:-1] ^ (b[:-1] >> np.uint64(31))) * np.uint64(37) + a[2:]
    h = np.concatenate([a[:n], b[:n], d[:n]])
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64)


def _counts(batches):
    totals: dict[str, np.ndarray] = {}
    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"]):
            n = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            codes = letter_codes(text)
            for i in range(0, len(codes), _CHUNK):
                n += np.bincount(ngram_columns(codes, i, i + _CHUNK), minlength=BUCKETS)
    for lang, n in totals.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "col": at, "n": n[at]})


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages by name and the log-probability matrix (columns x languages)."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    got = rows.mapInPandas(_counts, "lang string, col long, n long").groupBy("lang", "col").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    m = np.full((BUCKETS, len(langs)), alpha)
    for i, name in enumerate(langs):
        own = got[got["lang"] == name]
        m[own["col"].to_numpy(np.int64), i] += own["n"].to_numpy()
    return langs, (np.round(np.log(m / m.sum(0)) * 65536) / 65536).astype(np.float32) if langs else m


def score_batch(texts, langs: list[str], logp: np.ndarray) -> pd.DataFrame:
    """Language and score of every text. The n-grams of a batch are one sparse matrix (text, column), multiplied with the
    matrix in pieces of ``_CHUNK`` entries; log-probabilities are multiples of 2^-16, so sums do not depend on the pieces."""
    total, size = np.zeros((len(texts), len(langs))), np.zeros(len(texts), np.int64)
    columns, rows, held, step = [], [], 0, max(1, _CHUNK // max(1, len(langs)))

    def multiply():
        starts = np.cumsum([0] + [len(c) for c in columns[:-1]])
        sums = np.add.reduceat(logp.take(np.concatenate(columns), axis=0), starts, axis=0, dtype=np.float64)
        np.add.at(total, rows, sums)

    for i, text in enumerate(texts):
        if not text or not langs:
            continue
        codes = letter_codes(text)
        if not (codes != 32).any():
            continue
        for at in range(0, len(codes), step):
            columns.append(ngram_columns(codes, at, at + step))
            rows.append(i)
            size[i] += len(columns[-1])
            held += len(columns[-1])
            if held >= step:
                multiply()
                columns, rows, held = [], [], 0
    if columns:
        multiply()
    known = size > 0
    lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    if known.any():
        x = total[known] * (np.minimum(size[known], EVIDENCE) / size[known])[:, None]
        p = np.exp(x - x.max(axis=1, keepdims=True))
        best = total[known].argmax(axis=1)
        lang[known] = np.array(langs, object)[best]
        score[known] = p[np.arange(len(best)), best] / p.sum(axis=1)
    return pd.DataFrame({"lang": lang, "score": score})


def predictor(spark: SparkSession, langs: list[str], logp: np.ndarray):
    """A Column function: text -> struct(lang, score)."""
    model = spark.sparkContext.broadcast((langs, logp))

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return score_batch(texts.tolist(), *model.value)

    return predict


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2))
    return fit(bounded_sample(known, "doc_id", rows))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predict = predictor(spark, *train(docs))
    return docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), predict(F.col("text").cast("string")).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


#: Documents scored below this are rejected by the stage; so are those without a letter.
MIN_SCORE = 0.5


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    predict = predictor(spark, *train(docs))
    judged = boxed(docs, lang=predict(F.col("text").cast("string")))
    return unboxed(judged.filter((F.col("lang.lang") != "und") & (F.col("lang.score") >= MIN_SCORE)), docs.columns)
