"""URL filter: rules first, then host word segmentation and naive Bayes.

Names such as ``cheappills`` split into words by unigram Viterbi. A word's probability is half its share of the words that
hyphens set apart in all urls (``cheap-pills`` shows two words; an undivided name shows none) and half its share of the
labelled names below, so it means the same in a table of any size; an unknown word pays per letter. Multinomial naive
Bayes then adds up the words of host and path as block or allow.

All counted words take part. Only runs of letters that hold a labelled word are split, each different run once: the
others add nothing to a score however they split. The words of such a run come by an equi-join of its stretches with the
counts, so neither the vocabulary nor the urls are gathered; runs and urls that fill the table meet their result by
``join_skewed``, as do words that fill the counts.

Defined results: a null url or one without ``://`` has empty host and path and is allowed by the method unless a rule
fits; rows without a page_id are judged like others; repeated rows judge alike, equal splits take the shorter last word;
an empty table gives no rows. Words have any length: those of up to ``SHORT`` letters are found by equality, longer ones by
their first ``SHORT`` letters and then whole. Names of any length segment in time linear in their length, in stretches of
``STRETCH`` letters. Other columns of any name play no part.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import cut, join_skewed, table

#: (verdict, host, path) in the order of the contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Labelled names that the classifier is trained on.
BLOCKED_NAMES = """casino-win free-casino online-casino-bonus poker-bets free-bets sports-bet-bonus slot-jackpot lucky-lotto-win bet-win
cheap-pills buy-viagra online-pharmacy-pills diet-pills weight-loss-miracle cheap-meds-online adult-x adult-video-cams sex-dating
hot-singles-cams porn-tube xxx-video escort-dating spam-farm link-farm seo-link-farm click-farm spam-mail ads-track ad-click-track
popup-ads tracking-pixel-ads free-download-crack warez-crack keygen-serial torrent-pirate fast-loan-cash payday-loan quick-cash-credit
get-rich-quick crypto-double-win fake-watches replica-watches malware-download phishing-login free-prize-winner""".split()
ALLOWED_NAMES = """city-library public-school science-journal history-museum daily-news weather-report travel-blog cooking-recipes garden-club
music-archive film-review book-store open-source-code software-docs math-lessons language-course health-clinic sports-club football-news
university-research art-gallery local-government train-timetable photo-album language-wiki press-archive mail-server cloud-host
tech-blog physics-lab bird-watching chess-club map-service data-archive law-review parent-forum school-blog news-feed video-lessons""".split()
#: Letters of a word up to which it is looked up as a whole; longer ones are found by as many first letters.
SHORT = 24
#: Letters of a run that are looked up at a time.
STRETCH = 1024
#: Share of the labelled names in the probability of a word.
LABELLED = 0.5
UNKNOWN = math.log(1e-4)
PER_LETTER = math.log(1 / 12)
#: The two in units of 1e-9.
STRANGE, LETTER = round(UNKNOWN * 1e9), round(PER_LETTER * 1e9)
PRIOR_BLOCK = 0.35
#: First labels that name a service, not a topic; they say nothing.
SERVICES = ("www", "m", "mobile", "blog", "news", "shop", "mail")
THRESHOLD = 0.6


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi over a run of letters: probabilities from counted words and labelled names."""

    def __init__(self, labelled: list[str], total: float):
        words = [w for n in labelled for w in n.split("-")]
        self.labelled = {w: LABELLED * words.count(w) / len(words) for w in set(words)}
        self.total = total

    def price(self, word: str, counted: dict[str, int]) -> int | None:
        """Log-probability in units of 1e-9, so that equal splits tie; None for unknown words and for what such a one beats."""
        p = self.labelled.get(word, 0.0) + ((1 - LABELLED) * counted.get(word, 0) / self.total if self.total else 0.0)
        own = round(math.log(p) * 1e9) if p else -math.inf
        return own if own > STRANGE + LETTER * len(word) else None

    def split(self, run: str, counted: dict[str, int]) -> list[str]:
        known = {w: self.price(w, counted) for w in {*self.labelled, *counted}}
        known = {w: c for w, c in known.items() if c is not None}
        sizes = sorted({len(w) for w in known if len(w) <= SHORT})
        ends: dict[int, list[int]] = {}
        for w in known:
            if len(w) > SHORT:
                at = run.find(w)
                while at >= 0:
                    ends.setdefault(at + len(w), []).append(len(w))
                    at = run.find(w, at + 1)
        n = len(run)
        best, back = [0] * (n + 1), [0] * (n + 1)
        # an unknown word costs the same per letter wherever it starts, so the best start is kept
        strange = (0, 0)
        for end in range(1, n + 1):
            tried = [(strange[0] + STRANGE + LETTER * end, strange[1])]
            for k in sizes:
                if k > end:
                    break
                c = known.get(run[end - k : end])
                if c is not None:
                    tried.append((best[end - k] + c, end - k))
            tried += [(best[end - k] + known[run[end - k : end]], end - k) for k in ends.get(end, ())]
            # of equal splits the later start, the shorter last word
            best[end], back[end] = max(tried)
            strange = max(strange, (best[end] - LETTER * end, end))
        words, at = [], n
        while at:
            words.append(run[back[at] : at])
            at = back[at]
        return words[::-1]


class NaiveBayes:
    """Multinomial, two classes; unseen words say nothing."""

    def __init__(self, blocked: list[list[str]], allowed: list[list[str]], prior: float = PRIOR_BLOCK, alpha: float = 0.3):
        counts: dict[str, list[float]] = {}
        for side, names in ((0, blocked), (1, allowed)):
            for words in names:
                for w in words:
                    counts.setdefault(w, [0.0, 0.0])[side] += 1
        total = [sum(c[s] for c in counts.values()) + alpha * (len(counts) + 1) for s in (0, 1)]
        self.weight = {w: math.log((c[0] + alpha) / total[0]) - math.log((c[1] + alpha) / total[1]) for w, c in counts.items()}
        self.bias = math.log(prior / (1 - prior))

    def add(self, words: list[str]) -> float:
        return sum(self.weight.get(w, 0.0) for w in words)


def bayes() -> NaiveBayes:
    return NaiveBayes([n.split("-") for n in BLOCKED_NAMES], [n.split("-") for n in ALLOWED_NAMES])


def letter_runs(host: Column, path: Column) -> Column:
    """Runs of letters in host and path, lower-cased, without a first label that names a service."""
    topic = F.when(F.split(host, r"\.")[0].isin(*SERVICES), F.regexp_replace(host, r"^[^.]*\.(?=.*\.)", "")).otherwise(host)
    return F.regexp_extract_all(F.lower(F.concat_ws("/", topic, path)), F.lit(r"\p{L}+"), 0)


def word_counts(urls: DataFrame) -> DataFrame:
    """(w, c): how often hyphens set each word apart in ``urls(host, path, n)``."""
    words = F.regexp_extract_all(F.lower(F.concat_ws("/", "host", "path")), F.lit(r"(?<=-)\p{L}{2,}+|(?<!\p{L})\p{L}{2,}+(?=-)"), 0)
    return urls.select(F.explode(words).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("c"))


def split_runs(runs: DataFrame, counts: DataFrame, labelled: list[str]) -> DataFrame:
    """(run, words) for distinct ``runs(run)``, with ``counts(w, c)`` of all counted words."""
    total = float(counts.agg(F.sum("c")).first()[0] or 0)
    model = Segmenter(labelled, total)
    # a word below the price of an unknown one never wins
    price = UNKNOWN + F.length("w") * PER_LETTER
    useful = counts.filter(F.log(F.col("c") * ((1 - LABELLED) / total)) > price) if total else counts
    parts = F.transform(F.sequence(F.lit(0), F.length("run") - 1, F.lit(STRETCH)), lambda i: F.substring(F.col("run"), i + 1, F.lit(STRETCH + SHORT - 1)))
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.length("part")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.length("part") - i + 1, F.lit(SHORT))), lambda n: F.substring(F.col("part"), i, n))))
    keyed = runs.select("run", F.sha2("run", 256).alias("id"))
    seen = keyed.select("id", F.explode(parts).alias("part")).select("id", F.explode(F.array_distinct(windows)).alias("w")).distinct()
    long = useful.filter(F.length("w") > SHORT)
    found = join_skewed(seen, useful.filter(F.length("w") <= SHORT).select("w", "c", F.col("c").alias("n")), "w", int(total))
    begun = seen.join(long.select(F.substring("w", 1, SHORT).alias("w"), F.col("w").alias("whole"), "c"), "w").select("id", "whole", "c")
    found = found.unionByName(begun.join(keyed, "id").filter(F.contains("run", "whole")).select("id", F.col("whole").alias("w"), "c").distinct())
    own = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "c"))).alias("counted"))

    @F.pandas_udf("array<string>")
    def split(runs: pd.Series, counted: pd.Series) -> pd.Series:
        return pd.Series([model.split(r, dict(c) if c is not None else {}) for r, c in zip(runs, counted)], dtype=object)

    return keyed.join(own, "id", "left").select("run", split("run", "counted").alias("words"))


def judged(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, method_score."""
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("url", F.sha2(F.concat_ws("/", "host", "path"), 256))
    distinct = cut(urls.groupBy("host", "path").agg(F.count("*").alias("n")))
    model, labelled = bayes(), BLOCKED_NAMES + ALLOWED_NAMES
    holds = "|".join(sorted({w for n in labelled for w in n.split("-")}))
    told = cut(distinct.select(F.sha2(F.concat_ws("/", "host", "path"), 256).alias("url"), "n", F.filter(letter_runs(F.col("host"), F.col("path")), lambda r: r.rlike(holds)).alias("runs")).filter(F.size("runs") > 0))
    uses = told.select("url", F.explode("runs").alias("run"))
    times = cut(uses.groupBy("run").agg(F.count("*").alias("n")))
    words = split_runs(times.select("run"), word_counts(distinct), labelled)
    weights = F.create_map(*[F.lit(x) for w in model.weight for x in (w, round(model.weight[w] * 1e9))])
    # whole numbers add up alike in any order
    weight = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.coalesce(F.element_at(weights, w), F.lit(0)).cast("long"))
    weighed = cut(words.select("run", weight.alias("weight")).join(times, "run"))
    sums = join_skewed(uses, weighed, "run", uses.count()).groupBy("url").agg(F.sum("weight").alias("z"))
    scored = cut(told.select("url", "n").join(sums, "url"))
    out = join_skewed(urls, scored, "url", urls.count(), "left")
    z = F.lit(model.bias) + F.coalesce(F.col("z"), F.lit(0)) / 1e9
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    rule, verdict = rule_columns(F.col("host"), F.col("path"))
    method = F.when(score >= THRESHOLD, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), score.alias("method_score"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, table(spark, sf_dir, "pages"))
