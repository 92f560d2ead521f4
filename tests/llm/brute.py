"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def components(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        a, b = find(root, a), find(root, b)
        root[max(a, b)] = min(a, b)
    return [find(root, i) for i in range(n)]


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    fp = [fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 2]
    comp = components(len(rows), near)
    low = {}
    for (i, _), c in zip(rows, comp):
        low[c] = min(low.get(c, i), i)
    return {i: (f"{f:016x}", low[c]) for (i, _), f, c in zip(rows, fp, comp)}


def substrings(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - n + 1):
            s = raw[p : p + n]
            if s in seen:
                gone[p : p + n] = True
            seen.add(s)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def pii(text):
    """Base spans by kind as listed."""
    out = []
    for kind, regex in PII.items():
        for m in re.finditer(regex, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def pii_spans(text, trees, limits):
    """All spans as a digest: base spans, then accepted candidates by falling log-odds where no chosen one overlaps."""
    from evifuse.llm import pii as p

    text = text or ""
    base = pii(text)
    found = [(2, m.start(), m.end(), m.group()) for m in re.finditer(PII["card"], text) if 13 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
    for kind, regex in p.WIDE.items():
        found += [(p.KINDS.index(kind), m.start(), m.end(), m.group()) for m in re.finditer(regex, text)]
    side = lambda c: 0.0 if not c or c.isspace() else 2.0 if c.isalnum() or c == "_" else 1.0
    kept = []
    for k, a, b, m in found:
        if any(a < y and x < b for _, x, y in base):
            continue
        d, before = re.sub("[^0-9]", "", m), text[max(0, a - 18) : a]
        row = [k, len(d), float(bool(d) and luhn(d)), side(text[a - 1 : a] if a else ""), side(text[b : b + 1]), float(bool(re.search(p.HINTS, before))), float(bool(re.search(p.AGAINST, before))), len(re.sub("[0-9A-Za-z]", "", m))]
        z = trees.margin(np.array([row], float))[0]
        if z >= limits[k]:
            scale, shift = trees.calibrated[k]
            kept.append((-round(z * scale + shift, 6), k, a, b))
    chosen = []
    for _, k, a, b in sorted(kept):
        if not any(a < y and x < b for _, x, y in chosen):
            chosen.append((k, a, b))
    kept = chosen
    spans = sorted([(p.KINDS.index(k), a, b) for k, a, b in base] + kept)
    return ",".join(f"{p.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def secret_spans(text, net):
    """All spans as a digest: every candidate scored in every window, the likeliest taken one after the other."""
    from evifuse.llm import secrets as x

    text = text or ""
    base = [(a, ("assign", "access", "hex").index(k), b) for k, a, b in secrets(text)]
    gone = set()
    for a, _, b in base:
        gone.update(range(a, b))
    found = set()
    for m in re.finditer(r"""(?ai:pwd|passphrase|credential|auth|bearer|private_?key|access_?key|client_?id)["']?\x20*[:=\x20]\x20*["']?(?=[A-Za-z0-9+/_.=-]{8})""", text):
        found.add((m.end(), 0, re.compile("[A-Za-z0-9+/_.=-]+").match(text, m.end()).end()))
    mixed = lambda s: len(s) >= 20 and re.search("[0-9]", s) and re.search("[A-Za-z]", s)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        a = m.start()
        for s, k, e in base:
            if k == 0 and e > m.start() and s < m.end():
                if mixed(text[a:s]):
                    found.add((a, 0, s))
                a = max(a, e)
        if mixed(text[a : m.end()]):
            found.add((a, int(text[a : m.end()].isupper()), m.end()))
    scored = []
    for a, k, b in found:
        if all(i in gone for i in range(a, b)):
            continue
        starts = [a] if b - a <= 40 else sorted({a, b - 40} | {i for i in range(a + 1, b - 40) if i % 20 == 0 and i >= (a // 20 + 1) * 20})
        p = max(net.probability(np.array([x.encode(text, i, b)]))[0] for i in starts)
        if p >= net.threshold:
            scored.append((-p, (a, k, b)))
    kept = []
    for _, (a, k, b) in sorted(scored):
        if not any(a < e and s < b for s, _, e in kept):
            kept.append((a, k, b))
    out = list(base)
    for a, k, b in kept:
        free = [i for i in range(a, b) if i not in gone]
        for i in free:
            if i - 1 not in free or i == a:
                end = i
                while end in free:
                    end += 1
                out.append((i, k, end))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def secrets(text):
    """Base spans by start, then kind as listed."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.A | re.I):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, regex, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(regex, text or "") if len(m.group()) >= least]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def vectors(rows, threshold=0.93):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([rows[i][1] for i in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    label = np.array([rows[i][2] for i in ok])
    near &= label[:, None] == label[None, :]
    np.fill_diagonal(near, False)
    comp = components(len(ok), zip(*np.nonzero(np.tril(near))))
    low = {}
    for i, c in zip(ok, comp):
        low[c] = min(low.get(c, rows[i][0]), rows[i][0])
    out = {r[0]: (0, r[0]) for r in rows}
    for k, (i, c) in enumerate(zip(ok, comp)):
        out[rows[i][0]] = (int(near[k].sum()), low[c])
    return out


def url_scores(urls, ids):
    """Method scores: words between hyphens are counted over all rows, every way to split a run is tried."""
    import functools
    import math

    from evifuse.llm import urlfilter as u

    names = u.BLOCKED_NAMES + u.ALLOWED_NAMES
    named = [w for n in names for w in n.split("-")]
    counted = {}
    for host, path in urls:
        for w in re.findall(r"(?<=-)[a-z]{2,}(?![a-z])|(?<![a-z])[a-z]{2,}(?=-)", f"{host}/{path}"):
            counted[w] = counted.get(w, 0) + 1
    total = sum(counted.values())

    def price(w):
        p = 0.5 * named.count(w) / len(named) + (0.5 * counted.get(w, 0) / total if total else 0)
        nano = lambda x: round(x * 1e9)
        return max(nano(math.log(p)) if p else -math.inf, nano(math.log(1e-4)) + len(w) * nano(math.log(1 / 12)))

    @functools.cache
    def best(run):
        """(score, words) of the likeliest split; of equal ones the shorter last word."""
        if not run:
            return 0, ()
        tried = []
        for n in range(1, len(run) + 1):
            s, words = best(run[:-n])
            tried.append((s + price(run[-n:]), -n, (*words, run[-n:])))
        s, _, words = max(tried)
        return s, words

    sides = [[w for n in side for w in n.split("-")] for side in (u.BLOCKED_NAMES, u.ALLOWED_NAMES)]
    every = set(named)
    weight = {w: math.log((sides[0].count(w) + 0.3) / (len(sides[0]) + 0.3 * (len(every) + 1))) - math.log((sides[1].count(w) + 0.3) / (len(sides[1]) + 0.3 * (len(every) + 1))) for w in every}
    out = {}
    for i, (host, path) in zip(ids, urls):
        first, _, rest = host.partition(".")
        topic = rest if first in u.SERVICES and "." in rest else host
        z = math.log(u.PRIOR_BLOCK / (1 - u.PRIOR_BLOCK)) + sum(weight.get(w, 0.0) for run in re.findall("[a-z]+", f"{topic}/{path}".lower()) for w in best(run)[1])
        out[i] = 1 / (1 + math.exp(-z))
    return out


def languages(rows):
    """(language, score) by id and fold: n-grams counted and added up one by one."""
    import math
    import unicodedata
    import zlib
    from fractions import Fraction

    full = (1 << 64) - 1

    def grams(text):
        c = [ord(x) if unicodedata.category(x)[0] == "L" else 32 for x in text.lower()]
        out = []
        for i in range(len(c)):
            h = (c[i] + 1) * 0x9E3779B97F4A7C15 & full
            out.append(h)
            for mult, shift, k in ((31, 29, 1), (37, 31, 2)):
                if i + k < len(c):
                    h = (h ^ h >> shift) * mult + ((c[i + k] + 1) * 0x9E3779B97F4A7C15) & full
                    out.append(h)
        return [((h ^ h >> 32) * 0xD6E8FEB86659FD93 & full) >> 48 for h in out], any(x != 32 for x in c)

    counts = {}
    for i, t, lang in rows:
        if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            own = counts.setdefault(lang, {})
            for g in grams(t)[0]:
                own[g] = own.get(g, 0) + 1
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * 65536 for x in langs}
    cost = lambda x, g: Fraction(round(math.log((counts[x].get(g, 0) + 0.5) / total[x]) * 65536), 65536)
    out = {}
    for i, t, _ in rows:
        key = i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        g, letters = grams(t or "")
        if not letters or not langs:
            out[key] = ("und", 0.0)
            continue
        z = {x: float(sum(cost(x, y) * n for y, n in Counter(g).items())) for x in langs}
        best = max(langs, key=lambda x: z[x])
        scale = min(len(g), 48) / len(g)
        out[key] = (best, 1 / sum(math.exp((z[x] - z[best]) * scale) for x in langs))
    return out


def stems(rows, precision=0.75, evidence=12.0):
    """Toxic word stems of (text, toxic), equal texts once, with their log-odds."""
    import math

    once = {}
    for t, y in rows:
        once[t] = max(once.get(t, 0), y)
    n_pos, n = sum(once.values()), len(once)
    counts = {}
    for t, y in once.items():
        for p in {w[:k] for w in re.findall(r"[^\W\d_]{3,}", (t or "").lower()) for k in (*range(3, min(len(w), 16) + 1), len(w))}:
            counts.setdefault(p, [0, 0])[1 - y] += 1
    good = {}
    for p, (a, b) in counts.items():
        q, share = a / (a + b), n_pos / n
        if a >= 4 and q >= precision and q > share and a * math.log(q / share) + (b * math.log((1 - q) / (1 - share)) if b else 0) >= evidence:
            good[p] = (a, b)
    longest = {p for p in good if not any(len(x) == len(p) + 1 and x.startswith(p) and good[x] == good[p] for x in good)}
    out = {}
    for p in sorted(longest, key=lambda p: (-(good[p][0] - 3 * good[p][1]), len(p), p)):
        if not any(p.startswith(c) for c in out):
            out[p] = math.log((good[p][0] + 0.5) / (n_pos + 1)) - math.log((good[p][1] + 0.5) / (n - n_pos + 1))
    return out


def toxic_score(text, lexicon, weights):
    """Clause by clause, word by word: what is in force when an insult comes."""
    import math

    from evifuse.llm import toxicity as x

    total, clauses, different = 0.0, 0, set()
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        negated = quoted = aimed = menaced = 0
        score, insults = 0.0, set()
        for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause):
            insult = max((v for p, v in lexicon.items() if w.startswith(p)), default=0.0)
            if insult:
                score += insult * (0.5 if negated else 1) * (0.7 if quoted else 1) * (1.2 if aimed else 1)
                insults.add(w)
            elif w in x.NEGATION:
                negated = 4
            elif w in x.TARGET:
                score, aimed, menaced = score + 0.5 * menaced, 1, 0
            elif w in x.REPORTED:
                quoted = 1
            elif w in x.THREAT and not negated:
                score, menaced = (score + 0.5, 0) if aimed else (score, 1)
            negated = max(0, negated - 1)
        if score > 0:
            total, clauses = total + score, clauses + 1
            different |= insults
    z = weights[0] * math.log1p(total) + weights[1] * math.log1p(clauses) + weights[2] * math.log1p(len(different)) + weights[3]
    return 1 / (1 + math.exp(-z))


def best_match(item, text):
    """(smallest distance of the item to any substring, last start of the substring with the first end)."""
    row = [(0, -j) for j in range(len(text) + 1)]
    for i, c in enumerate(item, 1):
        new = [(i, 0)]
        for j, d in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (c != d), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    d, start = min(row, key=lambda x: x[0])
    return d, -start
