"""Document analysis: format, fields, links, geographic and temporal hints, recommended source kind.

Formats, hints and ladders are Column expressions. One small Arrow UDF flattens a document's JSON, XML or CSV to its
scalar fields and points, since Spark has no function for nesting of unknown depth; a document is bounded as in ``NODES``,
``POINTS`` and ``CSV_ROWS``, which are part of the analysis. Documents are rows; only links shuffle, by document and target.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.functions import signals, urls
from evifuse.functions import text as tx

#: Bounds of the analysis of one document.
TEXT, NODES, POINTS, CSV_ROWS, ITEMS = 256 * 1024, 10_000, 200, 200, 1_000

# Fixed values.
STREAM_TYPES = ("application/vnd.apple.mpegurl", "application/x-mpegurl", "application/dash+xml", "multipart/x-mixed-replace", "text/event-stream", "video/mp2t")
STREAM_EXTENSIONS = ("m3u8", "mpd", "mjpg", "mjpeg")
IMAGE_EXTENSIONS = ("avif", "bmp", "gif", "jpeg", "jpg", "png", "svg", "webp")
JSON_TYPES = ("application/json", "application/geo+json", "application/x-ndjson")
GEOJSON = ("feature", "featurecollection", "geometrycollection", "point", "multipoint", "linestring", "multilinestring", "polygon", "multipolygon")
PLACES = ("addresslocality", "areaserved", "city", "locality", "location", "place", "placename", "port", "spatialcoverage", "town")
JURISDICTIONS = ("addresscountry", "addressregion", "country", "county", "district", "jurisdiction", "province", "region", "state")
ROUTES = ("route", "routeid", "routename", "corridor", "line", "highway", "road")
URL_KEYS = ("url", "uri", "href", "link", "downloadurl", "endpoint", "serviceurl")
TIME_WORDS = "date|time|publish|modified|updated|created|issued|valid"
LATITUDES, LONGITUDES = ("latitude", "lat"), ("longitude", "lon", "lng", "long")
#: Largest latitude and longitude either way.
GLOBE = (90.0, 180.0)
WEB = r"(?i)^(?:https?|wss?)://"
NOT_LINKS = r"^(?:#|data:|javascript:|mailto:|tel:|file:)"

_PAIR = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
FIELDS = T.StructType([T.StructField("fields", T.ArrayType(_PAIR)), T.StructField("points", T.ArrayType(_POINT))])


def _any(c: Column, values) -> Column:
    return c.isin(*values)


def json_kind(text: Column) -> Column:
    """openapi, geojson or json for text that is JSON, else null."""
    v = F.try_parse_json(text)
    has = lambda *names: _either([F.try_variant_get(v, f"$.{n}", "variant").isNotNull() for n in names])
    geo_type = F.lower(F.try_variant_get(v, "$.type", "string"))
    return (
        F.when(v.isNull(), None)
        .when(has("openapi", "swagger"), "openapi")
        .when(F.coalesce(_any(geo_type, GEOJSON), F.lit(False)) & has("coordinates", "features", "geometry"), "geojson")
        .otherwise("json")
    )


def _either(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def looks_like_csv(text: Column) -> Column:
    """The first ten lines hold the same number, one at least, of one delimiter."""
    lines = F.filter(F.slice(F.split(text, r"\r\n|\n|\r"), 1, 10), lambda x: F.trim(x) != "")
    counts = lambda d: F.transform(lines, lambda x: F.length(x) - F.length(F.translate(x, d, "")))
    same = lambda d: (F.size(F.array_distinct(counts(d))) == 1) & (counts(d)[0] >= 1)
    return (F.size(lines) >= 2) & _either([same(d) for d in (",", "\t", ";", "|")])


def detected_format(url: Column, media_type: Column, text: Column) -> Column:
    """stream, pdf, image, openapi, geojson, json, jsonl, html, sitemap, rss, atom, kml, xml, csv or text: the first that fits."""
    media = F.lower(F.trim(F.split(F.coalesce(media_type, F.lit("")), ";")[0]))
    extension = F.lower(F.regexp_extract(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r"\.([A-Za-z0-9]+)$", 1))
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[﻿\u0000 \t\r\n]+", "")
    lines = F.slice(F.filter(F.split(body, r"\r\n|\n|\r"), lambda x: F.trim(x) != ""), 1, ITEMS)
    json_said = media.endswith("+json") | _any(media, JSON_TYPES) | _any(extension, ("json", "geojson", "jsonl", "ndjson"))
    xml_said = media.endswith("+xml") | _any(media, ("application/xml", "text/xml")) | _any(extension, ("atom", "kml", "rss", "xml"))
    prolog = r"^(?:<\?[^>]*>|<!--.*?-->|<!\w+[^\[>]*(?:\[.*?\]\s*)?>|\s)*"
    parts = F.struct(
        F.lower(url).rlike("^wss?:").alias("socket"),
        media.alias("media"),
        extension.alias("extension"),
        body.alias("body"),
        F.when(json_said | body.rlike(r"^[{\[]"), json_kind(body)).alias("json"),
        F.when(json_said | body.rlike(r"^[{\[]"), lines).alias("lines"),
        F.lower(F.regexp_extract(body, rf"(?s){prolog}<(?:[\w.-]+:)?([\w.-]+)", 1)).alias("root"),
        F.lower(F.regexp_extract(body, rf"(?s){prolog}<[\w.:-]+([^>]*)>", 1)).alias("spaces"),
        xml_said.alias("xml_said"),
    )
    return F.element_at(F.transform(F.array(parts), _first_format), 1)


def _first_format(p: Column) -> Column:
    media, extension, body, root = p["media"], p["extension"], p["body"], p["root"]
    is_xml = (p["xml_said"] | body.startswith("<")) & (root != "") & body.rlike(r"(?s)(?:</[\w.:-]+\s*>|/>)\s*$")
    several = (F.size(p["lines"]) >= 2) & F.forall(p["lines"], lambda x: F.try_parse_json(x).isNotNull())
    return (
        F.when(p["socket"] | _any(media, STREAM_TYPES) | _any(extension, STREAM_EXTENSIONS), "stream")
        .when(body.startswith("%PDF-") | (media == "application/pdf") | (extension == "pdf"), "pdf")
        .when(media.startswith("image/") | _any(extension, IMAGE_EXTENSIONS) | body.rlike("^(?:\\x{89}PNG|GIF8)"), "image")
        # the parser reads the first value and ignores what follows, so lines come first
        .when(p["lines"].isNotNull() & several, "jsonl")
        .when(p["json"].isNotNull(), p["json"])
        .when(p["lines"].isNotNull() & (_any(extension, ("jsonl", "ndjson")) | (media == "application/x-ndjson")), "jsonl")
        .when(_any(media, ("text/html", "application/xhtml+xml")) | _any(extension, ("htm", "html")) | body.rlike(r"(?i)^(?:<!doctype\s+html|<html\b)"), "html")
        .when(is_xml & _any(root, ("urlset", "sitemapindex")), "sitemap")
        .when(is_xml & (_any(root, ("rss", "rdf")) | body.rlike(r"(?i)<channel[\s>]")), "rss")
        .when(is_xml & (root == "feed") & F.contains(p["spaces"], F.lit("atom")), "atom")
        .when(is_xml & ((root == "kml") | F.contains(p["spaces"], F.lit("opengis.net/kml"))), "kml")
        .when(is_xml | p["xml_said"], "xml")
        .when(_any(media, ("text/csv", "application/csv", "application/vnd.ms-excel")) | (extension == "csv") | looks_like_csv(body), "csv")
        .otherwise("text")
    )


def _number(v) -> float | None:
    try:
        return None if isinstance(v, bool) else float(v)
    except (TypeError, ValueError):
        return None


class _Fields:
    def __init__(self, bounds: tuple[float, float] | None = GLOBE):
        self.lat, self.lon = bounds or (sys.float_info.max,) * 2
        self.fields: list[tuple[str, str]] = []
        self.points: dict[tuple[float, float], None] = {}

    def point(self, lat, lon) -> None:
        lat, lon = _number(lat), _number(lon)
        if lat is not None and lon is not None and -self.lat <= lat <= self.lat and -self.lon <= lon <= self.lon and len(self.points) < POINTS:
            self.points[round(lat, 7), round(lon, 7)] = None

    def record(self, row: dict) -> None:
        """A flat record: latitude and longitude under any of their names make a point."""
        low = {re.sub("[^a-z0-9]+", "", str(k).lower()): v for k, v in row.items()}
        pick = lambda names: next((low[n] for n in names if n in low), None)
        self.point(pick((*LATITUDES, "y")), pick((*LONGITUDES, "x")))

    def positions(self, value) -> None:
        if isinstance(value, list) and len(value) >= 2 and all(_number(v) is not None for v in value[:2]):
            self.point(value[1], value[0])
        elif isinstance(value, list):
            for v in value[:ITEMS]:
                self.positions(v)

    def walk(self, data) -> None:
        stack = [("", data)]
        for _ in range(NODES):
            if not stack:
                return
            key, value = stack.pop()
            if isinstance(value, dict):
                self.record(value)
                if str(value.get("type") or "").lower() in GEOJSON:
                    self.positions(value.get("coordinates"))
                stack += reversed([(str(k), v) for k, v in value.items()])
            elif isinstance(value, list):
                stack += [(key, v) for v in reversed(value[:ITEMS])]
            elif isinstance(value, str):
                self.fields.append((key, value))

    def xml(self, text: str) -> None:
        if "<!ENTITY" in text or "<!DOCTYPE" in text:
            return
        local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
        for n, e in enumerate(ElementTree.fromstring(text).iter()):
            if n == NODES:
                return
            value = (e.text or "").strip()
            target = e.get("href") or e.get("url")
            if target:
                self.fields.append((f"href@{e.get('rel') or local(e)}", target))
            if value:
                self.fields.append((local(e), value))
            if value and local(e).lower() == "coordinates":
                for pair in value.split():
                    self.positions(pair.split(",")[:2])
            self.record({local(c): (c.text or "").strip() for c in e})

    def csv(self, text: str) -> None:
        first = text.partition("\n")[0]
        rows = csv.reader(io.StringIO(text), delimiter=max(",\t;|", key=first.count))
        head = next(rows, [])
        for _, row in zip(range(CSV_ROWS), rows):
            self.fields += [(k, v) for k, v in zip(head, row) if v.strip()]
            self.record(dict(zip(head, row)))


def _read(texts: pd.Series, formats: pd.Series, bounds: tuple[float, float] | None) -> pd.DataFrame:
    out = []
    for text, kind in zip(texts, formats):
        f = _Fields(bounds)
        try:
            if kind in ("json", "geojson", "openapi"):
                f.walk(json.loads(text.lstrip("﻿\x00 \t\r\n")))
            elif kind == "jsonl":
                f.walk([json.loads(line) for line in [x for x in text.splitlines() if x.strip()][:ITEMS]])
            elif kind in ("xml", "kml", "rss", "atom", "sitemap"):
                f.xml(text.lstrip("﻿\x00 \t\r\n"))
            elif kind == "csv":
                f.csv(text)
        except (ValueError, RecursionError, ElementTree.ParseError, csv.Error):
            pass
        out.append(([{"key": k, "value": v} for k, v in f.fields], [{"lat": a, "lon": b} for a, b in f.points]))
    return pd.DataFrame(out, columns=["fields", "points"])


def fields(texts: Column, formats: Column, bounds: tuple[float, float] | None = GLOBE) -> Column:
    """Scalar text fields and points of JSON, JSON lines, XML and CSV; empty for other formats and for text that does not parse.

    Points lie within ``bounds``; without them, any finite pair counts, as in documents with coordinates of their own.
    """

    @F.pandas_udf(FIELDS)
    def read(texts: pd.Series, formats: pd.Series) -> pd.DataFrame:
        return _read(texts, formats, bounds)

    return read(texts, formats)


def _named(own: Column, names: tuple[str, ...]) -> Column:
    clean = lambda s: F.trim(F.regexp_replace(s["value"], r"\s+", " "))
    of = F.filter(own, lambda s: F.regexp_replace(F.lower(s["key"]), "[^a-z0-9]+", "").isin(*names) & F.length(clean(s)).between(1, 300))
    return F.array_distinct(F.transform(of, clean))


def geo_hints(own: Column) -> dict[str, Column]:
    """places, jurisdictions and routes that fields name."""
    return {"places": _named(own, PLACES), "jurisdictions": _named(own, JURISDICTIONS), "routes": _named(own, ROUTES)}


def field_times(own: Column) -> Column:
    """(kind, at) of every field that names and holds a time; kind is published, modified, updated or observed."""
    kind = lambda k: F.when(k.rlike("publish|issued|created"), "published").when(F.contains(k, F.lit("modif")), "modified").when(F.contains(k, F.lit("updat")), "updated").otherwise("observed")
    at = lambda v: F.coalesce(signals.document_time(v), F.try_to_timestamp(F.regexp_extract(v, signals.ISO_DATE, 1)))
    timed = F.filter(own, lambda s: F.lower(s["key"]).rlike(TIME_WORDS))
    return F.filter(F.transform(timed, lambda s: F.struct(kind(F.lower(s["key"])).alias("kind"), at(s["value"]).alias("at"))), lambda s: s["at"].isNotNull())


def temporal_hints(times: Column) -> dict[str, Column]:
    """published_at, modified_at, updated_at: the first time of each kind; observed_dates: the other times."""
    of = lambda k: F.transform(F.filter(times, lambda s: s["kind"] == k), lambda s: s["at"])
    return {f"{k}_at": F.get(of(k), F.lit(0)) for k in ("published", "modified", "updated")} | {"observed_dates": F.array_distinct(of("observed"))}


def latest_time(df: DataFrame) -> Column:
    """The latest of the temporal hints."""
    return F.array_max(F.concat(F.array("updated_at", "modified_at", "published_at"), "observed_dates"))


def html_anchors(page: Column) -> Column:
    """(href, nofollow) of every anchor, whatever the order of its attributes."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    value = lambda t, name: F.coalesce(tx.blank_to_null(F.regexp_extract(t, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)", 1)), tx.blank_to_null(F.regexp_extract(t, rf"(?is)\s{name}\s*=\s*([^\s>\"']+)", 1)))
    found = F.transform(tags, lambda t: F.struct(value(t, "href").alias("href"), F.coalesce(F.contains(F.lower(value(t, "rel")), F.lit("nofollow")), F.lit(False)).alias("nofollow")))
    return F.filter(found, lambda s: s["href"].isNotNull())


def page_title(page: Column) -> Column:
    return tx.blank_to_null(F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")))


def _elsewhere(target: Column) -> Column:
    """Rows with a target, other than ``__own``, as ``canonical_url``. A filter would be pushed below the projection and repeat the long expression for each mention."""
    return F.explode(F.filter(F.array(target), lambda c: c.isNotNull() & ~c.eqNullSafe(F.col("__own")))).alias("canonical_url")


def page_links(pages: DataFrame, key: str, url: str = "url", page: str = "html") -> DataFrame:
    """(key, position, canonical_url, same_domain, nofollow): all different links of a page, each where it stands first, without those to itself.

    The base element, if any, resolves relative links. Pages are keyed by an id, so duplicates drop by it.
    """
    base = F.coalesce(tx.blank_to_null(F.regexp_extract(page, r"(?is)<base\s[^>]*href\s*=\s*[\"']([^\"']*)", 1)), F.col(url))
    # what a page has once is found before its anchors multiply it; its text does not travel with them
    rows = pages.select(key, F.col(url).alias("__url"), base.alias("__base"), urls.canonical_url(F.col(url)).alias("__own"), F.col(page).alias("__page"))
    rows = rows.select(key, "__url", "__base", "__own", F.posexplode(html_anchors(F.col("__page"))).alias("position", "a")).filter(~F.lower(F.trim("a.href")).rlike(NOT_LINKS))
    rows = rows.select(key, "__url", "position", "a", _elsewhere(urls.canonical_url(F.col("a.href"), F.col("__base"))))
    first = rows.groupBy(key, "canonical_url").agg(F.min_by(F.struct("position", "a.nofollow", "__url"), "position").alias("f"))
    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return first.select(key, "f.position", "canonical_url", (host(F.col("canonical_url")) == host(F.col("f.__url"))).alias("same_domain"), "f.nofollow")


def recommended_kind(url: Column, detected: Column, media_type: Column, document_type: Column) -> Column:
    """Managed source kind for a document, null for social references."""
    is_ = lambda *names: detected.isin(*names)
    return (
        F.when(document_type == "social_reference", None)
        .when(F.lower(url).rlike("^wss?:"), "websocket_stream")
        .when(F.lower(media_type) == "text/event-stream", "sse_stream")
        .when(document_type.isin("camera_image", "camera_stream"), document_type)
        .when(is_("rss", "atom"), "rss")
        .when(is_("jsonl"), "http_jsonl")
        .when(is_("json", "geojson", "openapi"), "http_json")
        .when(is_("xml", "kml", "sitemap"), "http_xml")
        .when(is_("csv", "text"), "http_text")
        .when(document_type == "search_results", "web_search")
        .when(is_("html") & ~document_type.isin("api_docs", "camera_page", "open_data_portal"), "web_crawl")
        .otherwise("web_discovery")
    )


def analyze(docs: DataFrame, url: str = "url", text: str = "text", media_type: str | None = None, bounds: tuple[float, float] | None = GLOBE) -> DataFrame:
    """All columns of ``docs`` and the analysis of each document: format, hash, title, fields' hints, points within ``bounds``, type, cadence, recommended kind."""
    media = F.col(media_type) if media_type else F.lit("")
    d = docs.withColumn("__body", F.substring(F.coalesce(F.col(text), F.lit("")), 1, TEXT))
    body, once = F.col("__body"), lambda c, of: F.element_at(F.transform(F.array(c), of), 1)
    d = d.withColumn("detected_format", detected_format(F.col(url), media, body)).withColumn("content_hash", F.sha2(text, 256))
    d = d.withColumn("__f", fields(body, F.col("detected_format"), bounds))
    own = F.col("__f.fields")
    d = d.withColumns(geo_hints(own)).withColumn("__times", field_times(own)).withColumns(temporal_hints(F.col("__times")))
    d = d.withColumn("points", F.slice(F.array_distinct(F.concat("__f.points", signals.text_points(body, bounds))), 1, POINTS))
    html = F.col("detected_format") == "html"
    d = d.withColumn("title", F.when(html, page_title(body))).withColumn("cadence", once(body, urls.cadence)).withColumn("__host", tx.normalize_domain(F.col(url)))
    article = F.contains(F.lower(body), F.lit("<article"))
    kind = once(F.struct(F.col(url).alias("u"), F.col("__host").alias("h"), F.coalesce("title", F.lit("")).alias("t"), article.alias("a")), lambda p: urls.page_type(p["u"], p["h"], p["t"], F.lit(""), F.lit(False), p["a"]))
    d = d.withColumn("document_type", F.when(html, kind).when(urls.is_social(F.col("__host")), "social_reference").otherwise(F.col("detected_format")))
    return d.withColumn("recommended_kind", recommended_kind(F.col(url), F.col("detected_format"), media, F.col("document_type"))).drop("__f", "__times", "__body", "__host")


def record_links(docs: DataFrame, key: str, url: str = "url", text: str = "text", media_type: str | None = None) -> DataFrame:
    """(key, position, canonical_url, origin, relation, same_domain): the links that fields of JSON, JSON lines, XML and CSV documents hold.

    A field is a link if its name says so or its value begins with a scheme of the web; the first of equal targets stays,
    links of a document to itself aside. The bounds of the analysis of fields hold.
    """
    media = F.col(media_type) if media_type else F.lit("")
    body = F.substring(F.coalesce(F.col(text), F.lit("")), 1, TEXT)
    d = docs.select(key, F.col(url).alias("__url"), body.alias("__body"), media.alias("__media"))
    d = d.withColumn("__kind", detected_format(F.col("__url"), F.col("__media"), F.col("__body")))
    rows = d.select(key, "__url", "__kind", urls.canonical_url(F.col("__url")).alias("__own"), fields(F.col("__body"), F.col("__kind"))["fields"].alias("__fields"))
    rows = rows.select(key, "__url", "__kind", "__own", F.posexplode("__fields").alias("position", "s"))
    name, value = F.lower("s.key"), F.trim("s.value")
    is_json, is_csv, attribute = F.col("__kind").isin("json", "geojson", "openapi", "jsonl"), F.col("__kind") == "csv", name.startswith("href@")
    named = F.regexp_replace(name, "[^a-z0-9]+", "").isin(*URL_KEYS) | attribute | (~is_json & ~is_csv & name.isin("loc", "guid")) | value.rlike(WEB)
    origin = F.when(is_json, "json_url").when(is_csv, "csv_url").when(attribute, "xml_attribute").otherwise("xml_loc")
    name = F.regexp_replace(name, "^href@", "")
    rows = rows.filter(named & ~F.lower(value).rlike(NOT_LINKS)).select(key, "__url", "position", origin.alias("origin"), F.when(name == "", "reference").otherwise(name).alias("relation"), _elsewhere(urls.canonical_url(value, F.col("__url"))))
    first = rows.groupBy(key, "canonical_url").agg(F.min(F.struct("position", "origin", "relation", "__url")).alias("f"))
    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return first.select(key, "f.position", "canonical_url", "f.origin", "f.relation", (host(F.col("canonical_url")) == host(F.col("f.__url"))).alias("same_domain"))
