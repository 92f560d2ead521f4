"""Secret scan: base patterns, and a small character convolutional network over every further candidate.

Base spans always stay. A wide generator proposes other tokens (long mixed tokens, values of credential-like names), also
where they overlap; the network reads each candidate with its surroundings, long ones in windows of which the highest
counts, and of overlapping candidates above a threshold the likeliest is added. It is trained on labelled findings
that a seeded generator writes out, calibrated on a held-out part, and its threshold is the highest that keeps the
required recall there.

Defined results: null or empty text has no span; a span is (kind, start, end) in code points, end exclusive; of an
added token only what lies outside base spans is added; of equally likely candidates the first stays; repeated rows and
rows without an id scan alike; texts and candidates of any length are read whole; other columns of any name play no part;
an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The wide generator: values of other credential-like names, and long tokens.
NAMED = re.compile(r"""(?ai:pwd|passphrase|credential|auth|bearer|private_?key|access_?key|client_?id)["']?\x20*[:=\x20]\x20*["']?(?=[A-Za-z0-9+/_.=-]{8})""")
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGIT = re.compile(r"[0-9]")

WIDTH, BEFORE, LONGEST = 72, 20, 40
#: Step between the windows of a long candidate.
STEP = 20
FILTERS, KERNEL, EMBED = 24, 5, 8
REQUIRED_RECALL = 0.9
ALPHABET = {c: i + 1 for i, c in enumerate(string.printable[:95])}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind index, end) of the base patterns, leftmost and non-overlapping in each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _mixed(s: str) -> bool:
    return len(s) >= 20 and bool(_DIGIT.search(s)) and any(c.isalpha() for c in s)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further spans the network judges: (start, kind index, end). They may overlap each other and base spans, but none lies in a base span."""
    found, end = set(), -1
    for m in NAMED.finditer(text):
        # values that start in one run end with it
        if m.end() >= end:
            end = VALUE.match(text, m.end()).end()
        found.add((m.end(), 0, end))
    if _DIGIT.search(text):
        assigned = [(a, b) for a, k, b in base if k == 0]
        at = 0
        for m in LONG.finditer(text):
            # what an assignment leaves of a token must be one by itself
            while at < len(assigned) and assigned[at][1] <= m.start():
                at += 1
            a, j = m.start(), at
            while j < len(assigned) and assigned[j][0] < m.end():
                if _mixed(text[a : assigned[j][0]]):
                    found.add((a, 0, assigned[j][0]))
                a, j = max(a, assigned[j][1]), j + 1
            if _mixed(text[a : m.end()]):
                found.add((a, 1 if text[a : m.end()].isupper() else 0, m.end()))
    covered = union(base)
    return [(a, k, b) for a, k, b in sorted(found) if outside(a, b, covered)]


def union(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The places that sorted spans cover, as separate stretches in order."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def outside(start: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What covered stretches leave of a span."""
    out, i = [], bisect.bisect_right(covered, (start, 0))
    if i and covered[i - 1][1] > start:
        start = covered[i - 1][1]
    while i < len(covered) and covered[i][0] < end:
        if covered[i][0] > start:
            out.append((start, covered[i][0]))
        start, i = max(start, covered[i][1]), i + 1
    return out + [(start, end)] if start < end else out


def windows(start: int, end: int) -> list[int]:
    """Where the network starts to read a candidate: at its start, and in a long one at every further step up to its last characters."""
    if end - start <= LONGEST:
        return [start]
    return [start, *range((start // STEP + 1) * STEP, end - LONGEST, STEP), end - LONGEST]


def chosen(scored: list[tuple[float, tuple[int, int, int]]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """Of overlapping accepted candidates the likeliest, then the first; without the places of base spans."""
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []
    for _, (a, k, b) in sorted(scored, key=lambda c: (-c[0], c[1])):
        i = bisect.bisect_left(starts, a)
        if (i == 0 or kept[i - 1][2] <= a) and (i == len(kept) or kept[i][0] >= b):
            kept.insert(i, (a, k, b))
            starts.insert(i, a)
    covered = union(base)
    return [(x, k, y) for a, k, b in kept for x, y in outside(a, b, covered)]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of the candidate and its surroundings, the candidate at a fixed place."""
    row = np.zeros(WIDTH, np.uint8)
    left = text[max(0, start - BEFORE) : start]
    body = text[start : min(end, start + LONGEST)]
    right = text[end : end + WIDTH - BEFORE - len(body)]
    for i, c in enumerate(left, BEFORE - len(left)):
        row[i] = ALPHABET.get(c, 96)
    for i, c in enumerate((body + right)[: WIDTH - BEFORE], BEFORE):
        row[i] = ALPHABET.get(c, 96)
    return row


class CharCNN:
    """Embedding, one convolution with ReLU, max over places, logistic output; plain numpy."""

    def __init__(self, seed: int = 7):
        r = np.random.RandomState(seed)
        self.e = r.normal(0, 0.3, (97, EMBED))
        self.w = r.normal(0, 0.2, (KERNEL * EMBED, FILTERS))
        self.b = np.zeros(FILTERS)
        self.v = r.normal(0, 0.2, FILTERS)
        self.c = np.zeros(1)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        emb = self.e[x]
        cols = np.lib.stride_tricks.sliding_window_view(emb, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, KERNEL * EMBED)
        act = np.maximum(cols @ self.w + self.b, 0)
        at = act.argmax(1)
        top = np.take_along_axis(act, at[:, None, :], 1)[:, 0]
        return cols, at, top, top @ self.v + self.c[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[3] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        params = [self.e, self.w, self.b, self.v, self.c]
        m, s, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        r = np.random.RandomState(seed)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                at_rows = order[i : i + batch]
                xb, yb = x[at_rows], y[at_rows]
                cols, at, top, z = self._forward(xb)
                dz = (1 / (1 + np.exp(-z)) - yb) / len(xb)
                dtop = dz[:, None] * self.v * (top > 0)
                picked = np.take_along_axis(cols, at[:, :, None], 1)
                dw = np.einsum("nf,nfk->kf", dtop, picked)
                de = np.zeros_like(self.e)
                back = (dtop[:, :, None] * self.w.T[None]).reshape(len(xb), FILTERS, KERNEL, EMBED)
                where = at[:, :, None] + np.arange(KERNEL)
                np.add.at(de, xb[np.arange(len(xb))[:, None, None], where], back)
                t += 1
                for k, (p, g) in enumerate(zip(params, [de, dw, dtop.sum(0), top.T @ dz, np.array([dz.sum()])])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = REQUIRED_RECALL) -> None:
        """Platt scaling, then the highest threshold with the required recall."""
        z = self.logits(x)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
            self.scale -= 0.05 * float(((p - y) * z).mean())
            self.shift -= 0.05 * float((p - y).mean())
        own = np.sort(self.probability(x)[y == 1])
        self.threshold = max(0.5, float(own[int((1 - recall) * len(own))]) if len(own) else 0.5)


def labelled_findings(n: int = 1600, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates: keys, tokens and passwords in credential contexts against identifiers, paths, numbers and words."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = "the an er in on re ed ti es or le de ue ar os ch en ver ge ung ment eau".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    mixed = string.ascii_letters + string.digits
    x, y = [], []
    for i in range(n):
        secret = i % 2 == 0
        if secret:
            body = r.choice([lambda: pick(mixed, r.randint(20, 44)), lambda: pick(mixed + "+/", r.randint(24, 44)) + "=", lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(mixed, 24), lambda: pick(mixed + "_-", r.randint(10, 24))])()
            before = r.choice(["pwd=", "auth: ", "bearer ", "credential = ", "private_key: ", 'access_key="', "export KEY=", word() + " "])
            if i % 16 == 0:
                body = "".join(word() for _ in range(4))[:24].ljust(8, "e")
                before = r.choice(["pwd=", "pwd: ", "passphrase: ", "passphrase=", "pwd = "])
        else:
            body = r.choice([lambda: "-".join(word() for _ in range(5)) + str(r.randint(1, 99)), lambda: "/" + "/".join(word() for _ in range(4)) + "/" + str(r.randint(1, 999)), lambda: pick(string.digits, r.randint(20, 26)), lambda: word() + "_" + word() + "_" + word() + "_" + str(r.randint(1, 9999)), lambda: (word() * 6)[:24] + str(r.randint(0, 9)), lambda: "-" * r.randint(20, 30) + str(r.randint(1, 9)) + "a"])()
            before = r.choice([word() + " ", word() + ", ", "see ", "page ", "auth: " if r.random() < 0.1 else "in "])
            if i % 16 == 1:
                body = "".join(word() for _ in range(4))[:24].ljust(8, "e")
                before = r.choice(["auth ", "bearer ", "credential ", "passphrase ", "pwd ", "private key "])
        text = f"{word()} {word()} {before}{body} {word()} {word()}"
        at = text.index(body, text.index(before))
        x.append(encode(text, at, at + len(body)))
        y.append(float(secret))
    return np.array(x), np.array(y)


def train() -> CharCNN:
    x, y = labelled_findings()
    k = len(x) * 3 // 4
    net = CharCNN()
    net.fit(x[:k], y[:k])
    net.calibrate(x[k:], y[k:])
    return net


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_batch(texts, net: CharCNN) -> pd.DataFrame:
    bases, wide, rows, where, blocks = [], [], [], [], []
    for i, t in enumerate(texts):
        t = t or ""
        base = base_spans(t)
        bases.append(base)
        wide.append([])
        own: dict[tuple[int, int], int] = {}
        shared: dict[int, tuple[int, int, int]] = {}
        # by rising start, so the first long candidate of an end has all windows of the others
        for c in candidates(t, base):
            a, _, b = c
            if (a, b) not in own:
                own[a, b] = len(rows)
                rows.append(encode(t, a, b))
            rest = own[a, b]
            if b - a > LONGEST:
                if b not in shared:
                    more = windows(a, b)[1:]
                    shared[b] = (a // STEP, len(rows), len(rows) + len(more))
                    blocks.append(shared[b][1:])
                    rows += [encode(t, w, b) for w in more]
                first, low, high = shared[b]
                rest = min(low + a // STEP - first, high - 1)
            where.append((i, c, own[a, b], rest))
    if rows:
        p = net.probability(np.array(rows))
        # highest of a window and those after it, so a run costs its length however many candidates end with it
        top = p.copy()
        for low, high in blocks:
            top[low:high] = np.maximum.accumulate(p[low:high][::-1])[::-1]
        for i, c, at, rest in where:
            best = float(max(p[at], top[rest]))
            if best >= net.threshold:
                wide[i].append((best, c))
    wide = [chosen(more, base) if more else [] for base, more in zip(bases, wide)]
    out = []
    for base, more in zip(bases, wide):
        text = digest(base)
        n = [sum(k == j for _, k, _ in base) for j in range(3)]
        out.append((*n, hashlib.sha256(text.encode()).hexdigest(), digest(base + more) if more else text))
    return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scanner(spark: SparkSession, net: CharCNN | None = None):
    """Column function: text -> struct of counts and spans."""
    shared = spark.sparkContext.broadcast(net or train())

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        return scan_batch(texts, shared.value)

    return scan


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scanner(spark)(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")
