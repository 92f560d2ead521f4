"""Personal data: base patterns, and boosted trees over further candidates. DataFrame functions only.

Regular expressions run inside the JVM; places come from the lengths of what lies between matches. Quantifiers are
possessive where no other split can match, so long runs neither recurse nor rescan. High-recall generators then propose
overlapping candidates (other numbers of card length, local phone numbers, spelled-out addresses); a
small gradient-boosted tree ensemble scores each from format and context features, written out as one SQL expression,
its margins are calibrated to probabilities, and a threshold per kind selects. Candidates that overlap a base span or one that was chosen before them, by falling probability, are dropped.

The trees are trained on labelled candidates that a seeded generator writes (``TRAIN_ROWS``); their features come from
the same columns that score documents.

Defined results: null or empty text has no span; spans are (kind, start, end) in code points, end exclusive; base spans of
different kinds may overlap and all count; of overlapping candidates the likeliest stays, of equal ones the first by kind, then start, and a candidate that gave way drops no other; repeated rows
and rows without an id scan alike; texts of any length are read whole; other columns of any name stay; an empty table
gives no rows.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import boxed, table, unboxed

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass before a pattern runs.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_DOT = r"(?: ?(?:\(dot\)|\[dot\]|\[\.\]|\(\.\)) ?| dot )"
#: Further candidates by kind.
WIDE = {
    "email": rf"[{_LOCAL}]{{1,64}} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{{1,63}}){{1,5}}",
    "ip": rf"(?<![0-9]){_OCTET}(?:{_DOT}{_OCTET}){{3}}(?![0-9])",
    # 3-3-4; pairs after 0x (fr); area codes with 0 (de, en); nine digits in threes or pairs (es)
    "phone": r"(?<![0-9+(])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|0[1-9](?:[ .-]?[0-9]{2}){4}|\(?0[0-9]{1,4}\)?[ /-]{1,3}[0-9]{3,4}[ -]?[0-9]{2,5}|[6-9][0-9]{2}(?:(?:[ .-][0-9]{3}){2}|(?:[ .-][0-9]{2}){3}))(?![0-9])",
}
WIDE_GUARDS = {"email": r"[(\[]at[)\]]", "ip": rf"[0-9]{_DOT}[0-9]", "phone": r"[0-9]{2}\)?[ ./-]{1,3}[0-9]{2}|0[1-9][0-9]{8}"}
HINTS = "(?i)(?:card|visa|credit|kreditkarte|carte|tarjeta|account|konto|call|tel|phone|fon|mobile|fax|mail|contact|write|anruf|handy|appel|llam|m[oó]vil|host|server)"
AGAINST = "(?i)(?:order|isbn|serial|ref|version|invoice|sku|model|part|hash|#)"
TRAIN_ROWS = 900
FEATURES = ("kind", "digits", "luhn", "left", "right", "hint", "against", "marks")
#: Share of true candidates that each kind's threshold must keep on the calibration part.
REQUIRED_RECALL = 0.95
_SPAN = "array<struct<k:int,a:int,b:int,m:string>>"


def _let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _located(text: Column, regex: str, kind: int) -> Column:
    """All matches with their places. Starts are sums of lengths, taken over blocks so that many matches stay cheap."""
    size = 128

    def total(a):
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def place(p):
        lens = F.transform(p["m"], lambda m, i: F.length(p["s"][i]) + F.length(m))
        return _let(lens, lambda n: _let(_blocks(n), lambda sums: F.transform(p["m"], lambda m, i: _span(p, n, sums, m, i))))

    def _blocks(n):
        whole = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / size).cast("int")), lambda j: total(F.slice(n, j * size + 1, F.lit(size))))
        return _let(whole, lambda w: F.transform(w, lambda x, j: total(F.slice(w, F.lit(1), j))))

    def _span(p, n, sums, m, i):
        j = F.floor(i / size).cast("int")
        start = sums[j] + total(F.slice(n, j * size + 1, i - j * size)) + F.length(p["s"][i])
        return F.struct(F.lit(kind).alias("k"), start.alias("a"), (start + F.length(m)).alias("b"), m.alias("m"))

    pair = F.struct(F.split(text, regex, -1).alias("s"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"))
    return _let(pair, place)


def _guarded(text: Column, guard: str, spans: Column) -> Column:
    test = F.instr(text, guard) > 0 if guard == "@" else text.rlike(guard)
    return F.when(test, spans).otherwise(F.array().cast(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Checksum of a string of digits."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _passing(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["m"]))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["k"] == kind)


def with_base(rows: DataFrame) -> DataFrame:
    """Adds to ``rows(t, ...)`` the columns ``found`` (all pattern matches by kind) and ``base`` (those that pass) as structs of arrays."""
    t = F.col("t")
    found = [_guarded(t, GUARDS[k], _located(t, PATTERNS[k], i)).alias(k) for i, k in enumerate(KINDS)]
    out = rows.withColumn("found", F.struct(*found))
    base = [_passing(F.col("found")[k], k).alias(k) for k in KINDS]
    return out.withColumn("base", F.struct(*base))


def _overlaps(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (a["a"] < b["b"]) & (b["a"] < a["b"]))


def _clear(spans: Column) -> Column:
    """Of spans in order of preference those that overlap none that stayed before them."""
    none = F.slice(spans, 1, 0)
    return F.aggregate(spans, none, lambda kept, s: F.when(_overlaps(s, kept), kept).otherwise(F.concat(kept, F.array(s))))


def _side(c: Column) -> Column:
    """0 at an edge or blank, 1 for a mark, 2 for a letter or digit."""
    return F.when((F.length(c) == 0) | c.rlike(r"^\s"), 0.0).when(c.rlike(r"^[\p{L}\p{N}_]"), 2.0).otherwise(1.0)


def candidate_features(text: Column, s: Column) -> dict[str, Column]:
    before = F.substring(text, F.greatest(s["a"] - 17, F.lit(1)), F.least(s["a"], F.lit(18)))
    near = F.when(s["a"] > 0, F.substring(text, s["a"], F.lit(1))).otherwise("")
    after = F.substring(text, s["b"] + 1, F.lit(1))
    digits = _digits(s["m"])
    return {
        "kind": s["k"].cast("double"),
        "digits": F.length(digits).cast("double"),
        "luhn": F.when(F.length(digits) > 0, luhn(digits)).otherwise(False).cast("double"),
        "left": _side(near),
        "right": _side(after),
        "hint": before.rlike(HINTS).cast("double"),
        "against": before.rlike(AGAINST).cast("double"),
        "marks": F.length(F.regexp_replace(s["m"], "[0-9A-Za-z]", "")).cast("double"),
    }


def with_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``wide``: proposed spans that overlap no base span."""
    t, base = F.col("t"), F.concat(*[F.col("base")[k] for k in KINDS])
    long_number = F.filter(F.col("found")["card"], lambda s: F.length(_digits(s["m"])).between(13, 19))
    wide = F.concat(long_number, *[_guarded(t, WIDE_GUARDS[k], _located(t, WIDE[k], KINDS.index(k))) for k in WIDE])
    out = rows.withColumn("all", base).withColumn("wide", wide)
    return out.withColumn("wide", F.when(F.size("wide") > 0, F.filter("wide", lambda s: ~_overlaps(s, F.col("all")))).otherwise(F.col("wide")))


# --- boosted trees ---------------------------------------------------------------------------------------------------


def labelled_texts(rows: int = TRAIN_ROWS, seed: int = 5) -> list[tuple[int, str, int]]:
    """(id, text with one candidate, label)."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("the an er in on re ti es de ue ar os ver ung eau".split()) for _ in range(r.randint(1, 3)))

    def number(k, valid):
        d = digits(k - 1)
        total = sum(int(c) if j % 2 else int(c) * 2 - 9 * (c > "4") for j, c in enumerate(reversed(d)))
        return d + str((-total + (0 if valid else r.randint(1, 9))) % 10)

    out = []
    for i in range(rows):
        good, kind = i % 2 == 0, r.choice(["card", "phone", "email", "ip", "card", "phone", "email"])
        a, b = f"{word()} {word()} ", f" {word()} {word()}"
        hints, against = ["call ", "tel ", "phone: "], ["isbn ", "part x", "version ", "model ", "sku-"]
        if kind == "card":
            # valid numbers of 16 to 19 digits are base spans; failing ones are cards only where the context says so
            valid = r.random() < (0.7 if good else 0.3)
            body = number(r.choice([13, 14, 15, 15]) if valid else r.randint(13, 19), valid)
            if r.random() < 0.3:
                body = " ".join(body[k : k + 4] for k in range(0, len(body), 4))
            if good:
                a += r.choice(["card ", "account ", "", "", ""] if valid else ["card ", "account ", "visa ", "credit "])
            else:
                a += r.choice(["order ", "serial ", "ref ", "#", "hash a"] + ([] if valid else ["", "", ""]))
        elif kind == "phone":
            full = [f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", "0" + r.choice("1234567") + "".join(" " + digits(2) for _ in range(4)), f"0{r.choice('2346789')}{digits(1)} {digits(7)}", f"0{digits(3)}/{digits(6)}", f"020 {digits(4)} {digits(4)}"]
            nine = [f"{r.choice('6789')}{digits(2)} {digits(3)} {digits(3)}", f"9{digits(2)} {digits(2)} {digits(2)} {digits(2)}"]
            loose = r.random() < 0.3
            body = r.choice(nine if loose else full)
            # nine digits in groups may be any number
            a += r.choice(hints if loose else [*hints, ""]) if good else r.choice([*against, "", ""] if loose else against)
        elif kind == "ip":
            body = r.choice([" dot ", "[.]", "(dot)", " [dot] ", "(.)"]).join(str(r.randint(1, 255)) for _ in range(4))
            a += r.choice(["host ", "server ", "", ""]) if good else r.choice(["version ", "part ", "model "])
        else:
            at = r.choice(["(at)", " (at) ", " [at] "])
            body = f"{word()}{at}{word()}{r.choice(['.', ' [dot] ', '(dot)'])}{r.choice(['com', 'org', 'de'])}"
            if not good and r.random() < 0.5:
                body = f"{word()}{at}{r.randint(1, 99)}.{digits(2)}"
                a += r.choice(["mail ", "", ""])
            else:
                a += r.choice(["mail ", "write ", "contact ", "", "", ""]) if good else r.choice(["version ", "model ", "part "])
        out.append((i, a + body + b, int(good)))
    return out


class BoostedTrees:
    """Logistic gradient boosting with trees of depth 2 over few features; small enough to write out as SQL."""

    def __init__(self, rounds: int = 24, rate: float = 0.35, least: int = 8):
        self.rounds, self.rate, self.least, self.trees, self.start = rounds, rate, least, [], 0.0
        #: By kind: scale and shift that turn a margin into log-odds.
        self.calibrated: dict[int, tuple[float, float]] = {}

    def _split(self, x, g, h, rows):
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for v in (values[:-1] + values[1:]) / 2:
                left = rows[x[rows, f] < v]
                if self.least <= len(left) <= len(rows) - self.least:
                    right = rows[x[rows, f] >= v]
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1)
                    if best is None or gain > best[0]:
                        best = (gain, f, float(v), left, right)
        return best

    def _grow(self, x, g, h, rows, depth):
        s = self._split(x, g, h, rows) if depth else None
        if s is None:
            return float(self.rate * g[rows].sum() / (h[rows].sum() + 1))
        return (s[1], s[2], self._grow(x, g, h, s[3], depth - 1), self._grow(x, g, h, s[4], depth - 1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = min(max(y.mean(), 0.01), 0.99)
        self.start = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            tree = self._grow(x, y - q, q * (1 - q), np.arange(len(y)), 2)
            self.trees.append(tree)
            z += np.array([self._walk(tree, row) for row in x])
        return self

    def _walk(self, node, row) -> float:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.start + sum(self._walk(t, row) for t in self.trees) for row in x])

    def column(self, features: dict[str, Column]) -> Column:
        """The margin as an expression; equal splits of different trees are summed first."""
        names = list(features)

        def walk(node):
            if not isinstance(node, tuple):
                return F.lit(node)
            return F.when(features[names[node[0]]] < node[1], walk(node[2])).otherwise(walk(node[3]))

        merged: dict[tuple, float] = {}
        for t in self.trees:
            for path, value in _paths(t):
                merged[path] = merged.get(path, 0.0) + value
        out = F.lit(self.start)
        for path, value in merged.items():
            test = F.lit(True)
            for f, v, below in path:
                c = features[names[f]]
                test = test & ((c < v) if below else (c >= v))
            out = out + F.when(test, value).otherwise(0.0)
        return out


def _paths(node, path=()):
    if not isinstance(node, tuple):
        yield path, node
    else:
        yield from _paths(node[2], (*path, (node[0], node[1], True)))
        yield from _paths(node[3], (*path, (node[0], node[1], False)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift that turn margins into probabilities, by Newton's method."""
    a, w = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0])
    keep = np.diag([1e-2, 1e-2])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + keep, a.T @ (p - y) + keep @ (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


def train(spark: SparkSession, rows: int = TRAIN_ROWS) -> tuple[BoostedTrees, dict[int, float]]:
    """Trees and the margin that each kind's candidates must reach: a calibrated probability of a half at least, and more where ``REQUIRED_RECALL`` is kept."""
    made = spark.createDataFrame(labelled_texts(rows), "id int, t string, y int")
    spans = with_candidates(with_base(made)).select("id", "t", "y", F.explode("wide").alias("s"))
    feats = candidate_features(F.col("t"), F.col("s"))
    got = spans.select("id", "y", *[feats[n].alias(n) for n in FEATURES]).orderBy("id").collect()
    x, y = np.array([[r[n] for n in FEATURES] for r in got], float), np.array([r["y"] for r in got], float)
    cal = np.array([r["id"] % 4 == 3 or r["id"] % 4 == 0 and r["id"] % 8 == 0 for r in got])
    trees = BoostedTrees().fit(x[~cal], y[~cal])
    z, limits = trees.margin(x[cal]), {}
    for k in range(len(KINDS)):
        of = x[cal][:, 0] == k
        own = np.sort(z[of & (y[cal] == 1)])
        scale, shift = platt(z[of], y[cal][of])
        even = -shift / scale if scale > 0 else np.inf
        trees.calibrated[k] = scale, shift
        limits[k] = float(max(even, own[int((1 - REQUIRED_RECALL) * len(own))] if len(own) else even)) - 1e-9
    return trees, limits


# --- the whole -------------------------------------------------------------------------------------------------------


def with_spans(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, t, base, spans): every row of ``docs`` as a struct, its text (null is empty), and structs of arrays by kind."""
    trees, limits = train(spark)
    df = with_candidates(with_base(boxed(docs, t=F.coalesce(F.col(text).cast("string"), F.lit("")))))
    feature_struct = lambda s: F.struct(*[c.alias(n) for n, c in candidate_features(F.col("t"), s).items()])

    margin = lambda s: _let(feature_struct(s), lambda f: trees.column({n: f[n] for n in FEATURES}))
    of = lambda s, values, none: F.element_at(F.array(*[F.lit(float(values.get(k, none))) for k in range(len(KINDS))]), s["k"] + 1)
    scale, shift = ({k: c[i] for k, c in trees.calibrated.items()} for i in (0, 1))
    scored = F.transform("wide", lambda s: F.struct(s.alias("s"), margin(s).alias("z")))
    ranked = lambda x: F.struct((-F.round(x["z"] * of(x["s"], scale, 1.0) + of(x["s"], shift, 0.0), 6)).alias("p"), x["s"]["k"].alias("k"), x["s"]["a"].alias("a"), x["s"]["b"].alias("b"), x["s"].alias("s"))
    good = F.transform(F.filter(scored, lambda x: x["z"] >= of(x["s"], limits, float("inf"))), ranked)
    df = df.withColumn("good", F.when(F.size("wide") > 0, F.array_sort(good)).otherwise(F.slice(F.array_sort(good), 1, 0)))
    # likeliest first; a candidate stays where none that stayed overlaps it
    df = df.withColumn("good", F.transform(F.when(F.size("good") > 1, _clear(F.col("good"))).otherwise(F.col("good")), lambda x: x["s"]))
    spans = [F.array_sort(F.concat(F.col("base")[k], _of_kind(F.col("good"), i)), lambda x, y: x["a"] - y["a"]).alias(k) for i, k in enumerate(KINDS)]
    return df.withColumn("spans", F.when(F.size("good") > 0, F.struct(*spans)).otherwise(F.col("base"))).select("row", "t", "base", "spans")


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(F.concat(*[spans[k] for k in KINDS]), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["a"], s["b"]))
    return F.array_join(named, ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_spans(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select("row.doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """Text with every span replaced by its kind in brackets; overlapping spans take the first one's kind."""
    ordered = F.array_sort(F.concat(*[spans[k] for k in KINDS]), lambda x, y: F.when(x["a"] != y["a"], x["a"] - y["a"]).otherwise(x["k"] - y["k"]))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        fresh = F.struct(
            s["b"].alias("at"),
            F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), F.element_at(names, s["k"] + 1))).alias("out"),
        )
        return F.when(s["a"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["b"]).alias("at"), acc["out"].alias("out")))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays with its spans redacted; ``n_chars``, where there is one, follows the new text."""
    df = with_spans(spark, docs)
    n = sum((F.size(F.col("spans")[k]) for k in KINDS), F.lit(0))
    df = df.select("row", "spans", "t", F.when(n > 0, redact(F.col("t"), F.col("spans"))).alias("new"))
    found = F.col("new").isNotNull()
    text = F.when(found, F.col("new")).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(found, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unboxed(df, docs.columns, **changed)
