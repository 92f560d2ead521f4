"""HTML pages as rows: meta, links of every kind, scripts, tables, tags and visible text.

One pass of a tokenizer per page, over the whole page: tags with attributes in any quoting, comments, declarations, and
script and style content that runs to its own end tag. Pages are rows of an Arrow UDF, nothing is shuffled; links explode
from there and resolve as Columns. Markup that never closes is text, as browsers show it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.functions import urls
from evifuse.operators.analysis import NOT_LINKS

# Fixed values.
EMBEDS = ("img", "iframe", "video", "audio", "source", "script")
DATA_URLS = ("data-url", "data-src", "data-stream", "data-endpoint", "data-api")
UNSEEN = ("script", "style", "noscript")
ANCHOR_TEXT, HEADER_TEXT = 500, 200

_NAME = r"[A-Za-z][^\s/>]*+"
#: Comment, declaration, end tag, or start tag whose quoted values may hold any character.
TOKEN = re.compile(rf"<!--(?:.*?--!?>|>)|<[!?][^>]*+>|</({_NAME})[^>]*+>|<({_NAME})((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>", re.DOTALL)
#: The same without quoting, for what follows a tag that ends inside quotes only.
PLAIN = re.compile(rf"<[!?][^>]*+>|</({_NAME})[^>]*+>|<({_NAME})([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: Character references as XML has them. HTML also reads some names that lack the semicolon.
ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|([A-Za-z][A-Za-z0-9]*));")
REFRESH = re.compile(r"(?i)\burl\s*=\s*['\"]?(.+?)['\"]?\s*$")

_strings = T.ArrayType(T.StringType())
_rows = lambda **k: T.ArrayType(T.StructType([T.StructField(n, t) for n, t in k.items()]))
MARKUP = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("base", T.StringType()),
    T.StructField("meta", _rows(name=T.StringType(), content=T.StringType())),
    T.StructField("links", _rows(href=T.StringType(), origin=T.StringType(), relation=T.StringType(), anchor_text=T.StringType(), nofollow=T.BooleanType(), media_type=T.StringType())),
    T.StructField("scripts", _strings),
    T.StructField("json_ld", _strings),
    T.StructField("tables", _rows(depth=T.IntegerType(), headers=_strings, n_rows=T.IntegerType(), n_cells=T.IntegerType())),
    T.StructField("tags", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("text", T.StringType()),
])


def squeeze(text: str) -> str:
    return " ".join(text.split())


def decode(text: str, ended: bool = False) -> str:
    """Text with its character references resolved; with ``ended`` those only that end in a semicolon."""
    if not ended:
        return html.unescape(text)
    return ENDED.sub(lambda m: html5.get(m[1] + ";", m[0]) if m[1] else html.unescape(m[0]), text)


def tokens(page: str, ended: bool = False):
    """(kind, name, value): ``text``, ``open`` with its attributes, ``close``, and ``raw`` for script and style content."""
    at, n, pattern, last = 0, len(page), TOKEN, page.rfind(">")
    while at < n:
        low = page.find("<", at)
        if low < 0 or low > last:
            yield "text", "", page[at:]
            return
        m = pattern.match(page, low)
        if m is None and pattern is TOKEN and page[low + 1 : low + 2].isalpha():
            # no bracket outside quotes up to the end: from here on tags end at the next one
            pattern = PLAIN
            m = pattern.match(page, low)
        if m is None and page.startswith("<!--", low):
            m = PLAIN.match(page, low)
        end = m.end() if m else low + 1
        if at < low or not m:
            yield "text", "", page[at : low if m else end]
        at = end
        if m and m[1]:
            yield "close", m[1].lower(), ""
        elif m and m[2]:
            name = m[2].lower()
            found: dict[str, str] = {}
            for a in ATTRIBUTE.finditer(m[3]):
                found.setdefault(a[1].lower(), decode(a[2] or a[3] or a[4] or "", ended))
            yield "open", name, found
            if name in ("script", "style"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                stop = close.start() if close else n
                yield "raw", name, page[at:stop]
                at = stop


class _Page:
    def __init__(self, ended: bool = False):
        self.ended = ended
        self.tags, self.meta, self.links, self.scripts, self.json_ld, self.tables = Counter(), [], [], [], [], []
        self.title, self.text, self.base = [], [], None
        self.in_title, self.hidden, self.kind = False, 0, ""
        self.anchor: list | None = None
        self.open_tables: list[list] = []
        self.header: list[str] | None = None

    def link(self, href: str, origin: str, relation: str, nofollow: bool = False, media_type: str | None = None) -> None:
        self.links.append([href, origin, relation, None, nofollow, media_type])

    def open(self, tag: str, a: dict[str, str]) -> None:
        self.tags[tag] += 1
        if tag == "title":
            self.in_title = True
        elif tag == "noscript":
            self.hidden += 1
        elif tag == "base":
            self.base = self.base or a.get("href") or None
        elif tag == "meta":
            self.describe((a.get("name") or a.get("property") or a.get("http-equiv") or "").lower(), a.get("content", "").strip())
        elif tag == "table":
            self.open_tables.append([len(self.open_tables) + 1, [], 0, 0])
            self.tables.append(self.open_tables[-1])
        elif tag == "tr" and self.open_tables:
            self.open_tables[-1][2] += 1
        elif tag in ("td", "th") and self.open_tables:
            self.open_tables[-1][3] += 1
            self.end_header()
            self.header = [] if tag == "th" else None
        elif tag == "script":
            self.kind = a.get("type", "").lower()
        rel = a.get("rel", "").lower().split()
        if tag == "a" and a.get("href"):
            self.end_anchor()
            self.link(a["href"], "html_anchor", "nofollow" if "nofollow" in rel else "outbound", "nofollow" in rel)
            self.anchor = []
        elif tag == "link" and a.get("href"):
            self.link(a["href"], "html_link", rel[0] if rel else "reference", media_type=a.get("type"))
        elif tag in EMBEDS and a.get("src"):
            self.link(a["src"], f"html_{tag}", "embed", media_type=a.get("type"))
        elif tag == "form" and a.get("action"):
            self.link(a["action"], "html_form", "action")
        for k in DATA_URLS:
            if a.get(k):
                self.link(a[k], "html_data", k.removeprefix("data-"))

    def describe(self, name: str, content: str) -> None:
        if not name or not content:
            return
        self.meta.append((name, content))
        target = REFRESH.search(content) if name == "refresh" else None
        if target:
            self.link(target[1], "html_meta", "refresh")
        elif name != "refresh" and name.endswith((":url", "_url")):
            self.link(content, "html_meta", name)

    def end_anchor(self) -> None:
        if self.anchor is not None:
            last = next(x for x in reversed(self.links) if x[1] == "html_anchor")
            last[3] = squeeze(" ".join(self.anchor))[:ANCHOR_TEXT] or None
            self.anchor = None

    def end_header(self) -> None:
        if self.header is not None and self.open_tables:
            name = squeeze(" ".join(self.header))[:HEADER_TEXT]
            if name and name not in self.open_tables[-1][1]:
                self.open_tables[-1][1].append(name)
        self.header = None

    def close(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        elif tag == "noscript":
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a":
            self.end_anchor()
        elif tag in ("th", "tr", "table"):
            self.end_header()
            if tag == "table" and self.open_tables:
                self.open_tables.pop()

    def data(self, text: str) -> None:
        text = decode(text, self.ended)
        for on, part in ((self.in_title, self.title), (self.anchor is not None, self.anchor), (self.header is not None, self.header), (not self.hidden, self.text)):
            if on:
                part.append(text)

    def raw(self, tag: str, text: str) -> None:
        if tag == "script":
            self.scripts.append(text)
            if "ld+json" in self.kind:
                self.json_ld.append(text)

    def row(self) -> tuple:
        self.end_anchor()
        self.end_header()
        return squeeze(" ".join(self.title)) or None, self.base, self.meta, [tuple(x) for x in self.links], self.scripts, self.json_ld, [tuple(t) for t in self.tables], dict(self.tags), squeeze("".join(self.text))


def read_page(page: str | None, ended: bool = False) -> tuple:
    """The fields of ``MARKUP``; a null page has empty ones."""
    p = _Page(ended)
    for kind, name, value in tokens(page or "", ended):
        if kind == "text":
            p.data(value)
        elif kind == "open":
            p.open(name, value)
        elif kind == "close":
            p.close(name)
        else:
            p.raw(name, value)
    return p.row()


def _frame(pages: pd.Series, ended: bool) -> pd.DataFrame:
    as_rows = lambda names, rows: [dict(zip(names.split(), r)) for r in rows]
    out = []
    for p in pages:
        title, base, meta, links, scripts, json_ld, tables, tags, text = read_page(p, ended)
        out.append((title, base, as_rows("name content", meta), as_rows("href origin relation anchor_text nofollow media_type", links), scripts, json_ld, as_rows("depth headers n_rows n_cells", tables), tags, text))
    return pd.DataFrame(out, columns=MARKUP.names)


@F.pandas_udf(MARKUP)
def markup(pages: pd.Series) -> pd.DataFrame:
    """Pages as browsers read them."""
    return _frame(pages, False)


@F.pandas_udf(MARKUP)
def ended_markup(pages: pd.Series) -> pd.DataFrame:
    """Pages whose character references count only where a semicolon ends them, as in XML."""
    return _frame(pages, True)


def resolved_links(pages: DataFrame, key: str, url: str = "url", page: str = "html") -> DataFrame:
    """(key, position, canonical_url, origin, relation, anchor_text, nofollow, media_type) of every link that has a canonical form, in page order.

    ``base`` resolves relative links where the page has one, itself resolved against the page's address.
    """
    rows = pages.select(key, F.col(url).alias("__url"), markup(F.col(page)).alias("m"))
    rows = rows.withColumn("__base", F.coalesce(urls.canonical_url(F.col("m.base"), F.col("__url")), F.col("__url"))).select(key, "__base", F.posexplode("m.links").alias("position", "l"))
    rows = rows.filter(~F.lower(F.trim("l.href")).rlike(NOT_LINKS)).select(key, "position", urls.canonical_url(F.col("l.href"), F.col("__base")).alias("canonical_url"), "l.*")
    return rows.filter("canonical_url is not null").drop("href")
