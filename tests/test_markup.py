"""HTML walk: quoting, comments, raw content, nested tables, broken markup, links of every kind."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

from evifuse.operators import markup

PAGE = """<!DOCTYPE html><!-- <title>no</title> <a href="/no"> --><html><head>
<TITLE>Metro &amp; <!-- x -->I-94
  Cameras</TITLE><base href="/sub/"><base href="/other/">
<meta property="geo.position" content=" 44.981;-93.271 "><meta name=empty content=''><meta http-equiv=Refresh content="5; URL='next.html'">
<meta property="og:url" content="https://a.org/x"><link rel="Alternate feed" type="application/rss+xml" href=/alerts.xml>
<style>a > b { content: "</p>" }</style><script>if (a < b) t = "<a href='/no'></p>";</script><script TYPE='application/ld+json'>{"@type": "Dataset"}</SCRIPT >
</head><body data-url="/api"><a title='a > b' HREF = "../snap.jpg?a=1&amp;b=2" rel="external NoFollow">Latest <b>snapshot</b></a>
<a>none</a><a href=one>un<a href='two'>ended</a><noscript>hidden <img src="/pixel.gif"></noscript><form action="/go"></form>
<iframe src=//b.org/v></iframe> 1 < 2 & 3 <table><tr><th>Name</th><th>Big  <i>one</i><tr><td><table><tr><th>In</th></tr></table></td><td>x</td></tr></table><td>loose</td></body>"""


def test_page():
    title, base, meta, links, scripts, json_ld, tables, tags, text = markup.read_page(PAGE)
    assert title == "Metro & I-94 Cameras" and base == "/sub/"
    assert meta == [("geo.position", "44.981;-93.271"), ("refresh", "5; URL='next.html'"), ("og:url", "https://a.org/x")]
    assert links == [
        ("next.html", "html_meta", "refresh", None, False, None), ("https://a.org/x", "html_meta", "og:url", None, False, None), ("/alerts.xml", "html_link", "alternate", None, False, "application/rss+xml"),
        ("/api", "html_data", "url", None, False, None), ("../snap.jpg?a=1&b=2", "html_anchor", "nofollow", "Latest snapshot", True, None), ("one", "html_anchor", "outbound", "un", False, None),
        ("two", "html_anchor", "outbound", "ended", False, None), ("/pixel.gif", "html_img", "embed", None, False, None), ("/go", "html_form", "action", None, False, None), ("//b.org/v", "html_iframe", "embed", None, False, None),
    ]
    assert scripts == ["if (a < b) t = \"<a href='/no'></p>\";", '{"@type": "Dataset"}'] and json_ld == scripts[1:]
    assert tables == [(1, ["Name", "Big one"], 2, 4), (2, ["In"], 1, 1)]
    assert tags["a"] == 4 and tags["th"] == 3 and "title" in tags and "p" not in tags
    assert "hidden" not in text and "content" not in text and "1 < 2 & 3" in text and text.endswith("loose")


def test_broken_and_long_pages():
    empty = (None, None, [], [], [], [], [], {}, "")
    assert markup.read_page(None) == markup.read_page("") == markup.read_page("<!-- <a> -->") == empty
    assert markup.read_page("a <b")[-1] == "a <b" and markup.read_page("<script>x")[4] == ["x"]
    # a quote that never closes does not swallow the page
    got = markup.read_page('<a href="/x>one</a> <p>two</p>')
    assert got[7] == {"a": 1, "p": 1} and got[-1] == "one two"
    assert markup.read_page("<a b='1' b=2 c d=\"x'y>z\">")[7] == {"a": 1}
    for piece in ("<", "<a ", '<a "', "<a href='", "<!--", "</", "<table><tr><td>", "<a href=x>", "<script>", "&amp;", "<!-- -"):
        start = time.time()
        markup.read_page(piece * (600_000 // len(piece)) + ">")
        assert time.time() - start < 20, piece


def test_references_without_their_semicolon(spark):
    page = "<title>a&amp;b &lt;c&gt; and&amp</title><a title='x' href='?a=1&copy=2&amp;b'>&#x27;&eacute;&ampx &nosuch; &#8364 &notit;</a>"
    title, _, _, links, *_, text = markup.read_page(page, ended=True)
    assert title == "a&b <c> and&amp" and links[0][0] == "?a=1&copy=2&b" and text.endswith("'é&ampx &nosuch; &#8364 &notit;")
    assert markup.read_page(page)[0] == "a&b <c> and&"
    got = spark.createDataFrame([(page,), (None,)], "html string").select(markup.ended_markup("html").alias("m")).select("m.title").collect()
    assert [r.title for r in got] == [title, None]


def test_tags_and_text_equal_the_standard_parser():
    """On well-formed pages, against a plain event parser."""

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.seen, self.said, self.skip = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.seen.append((tag, dict(reversed([(k, v or "") for k, v in attrs]))))
            self.skip += tag in markup.UNSEEN

        def handle_endtag(self, tag):
            self.skip -= tag in markup.UNSEEN

        def handle_data(self, data):
            if not self.skip:
                self.said.append(data)

    r = random.Random(5)
    word = lambda: r.choice(["one", "zwei", "tr&eacute;s", "a &lt; b", "&#8364;5", "é"])
    for _ in range(300):
        parts = []
        for _ in range(r.randint(1, 15)):
            tag = r.choice("p div b td a".split())
            attrs = "".join(r.choice([f' x="{word()} > {word()}"', f" y='{word()}'", " z=1", " q", f'\n A = "{word()}"']) for _ in range(r.randint(0, 3)))
            parts.append(r.choice([f"<{tag}{attrs}>{word()} {word()}</{tag}>", f"<!-- {word()} <p> -->", f"<script>{word()} <p> '</b>'</script>", f"<style>{word()}</style>", f"<noscript>{word()}</noscript>", word(), f"<br{attrs}/>"]))
        page = "".join(parts)
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert [(n, v) for k, n, v in markup.tokens(page) if k == "open"] == plain.seen, page
        assert markup.read_page(page)[-1] == markup.squeeze("".join(plain.said)), page


def test_links_resolve(spark):
    df = spark.createDataFrame([(1, "https://data.example.gov/cameras/index.html", PAGE), (2, "https://a.org/", None), (3, "https://a.org/d/", "<a href='x?utm_medium=web'>x</a><a href='mailto:a@b.org'>m</a>")], "id int, url string, html string")
    got = {(r.id, r.origin, r.canonical_url): r for r in markup.resolved_links(df, "id").collect()}
    assert (1, "html_anchor", "https://data.example.gov/snap.jpg?a=1&b=2") in got and (1, "html_link", "https://data.example.gov/alerts.xml") in got
    assert got[1, "html_anchor", "https://data.example.gov/sub/two"].anchor_text == "ended" and (1, "html_meta", "https://data.example.gov/sub/next.html") in got
    assert [k for k in got if k[0] > 1] == [(3, "html_anchor", "https://a.org/d/x")]
    assert markup.resolved_links(df.limit(0), "id").count() == 0
