"""File scans. Every reader returns one row per record with the raw record text."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMATS = {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".txt": "txt", ".log": "txt", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite", ".xml": "xml"}


def infer_format(path: str) -> str:
    """By suffix; unknown suffixes are text."""
    low = path.lower().rstrip("/")
    return next((f for s, f in sorted(FORMATS.items(), key=lambda x: -len(x[0])) if low.endswith(s)), "txt")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; lines that hold no object are dropped."""
    v = F.try_parse_json("value")
    return spark.read.text(path).filter(F.schema_of_variant(v).startswith("OBJECT")).select(F.to_json(v).alias("payload"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files: a list or the list ``items`` gives its objects, another object one row, a scalar a wrapped row."""
    v = F.try_parse_json("value")
    whole = spark.read.text(path, wholetext=True).select(v.alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.items", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    kind = F.schema_of_variant("v")
    rows = F.when(listed.isNotNull(), F.filter(listed, lambda x: F.schema_of_variant(x).startswith("OBJECT"))).when(kind.startswith("OBJECT"), F.array("v")).otherwise(F.array(F.parse_json(F.concat(F.lit('{"value":'), F.to_json("v"), F.lit("}")))))
    return whole.filter("v is not null").select(F.explode(rows).alias("r")).select(F.to_json("r").alias("payload"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-blank stripped line."""
    return spark.read.text(path).select(F.trim("value").alias("content_text")).filter("content_text <> ''").withColumn("raw_hash", F.sha2("content_text", 256))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, UTF-8 with or without BOM, every value a string."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed CSV records with a title that falls back to name, id, then the record's own hash."""
    df = csv(spark, path)
    df = df.select(*[F.trim(c).alias(c) for c in df.columns])
    names = [F.nullif(F.col(c), F.lit("")) for c in ("title", "name", "id") if c in df.columns]
    return df.withColumn("record_title", F.coalesce(*names, F.concat(F.lit("csv-record-"), F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 12))))


def xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Child elements as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS 2 items and Atom entries: title, link, published, with the feed's title. Documents with a DTD are refused."""
    whole = spark.read.text(path, wholetext=True).filter(~F.col("value").rlike(r"(?i)<!(?:DOCTYPE|ENTITY)"))
    clean = F.regexp_replace("value", r'\sxmlns(?::\w+)?="[^"]*"', "")
    x = whole.select(clean.alias("x"))
    atom = F.xpath_boolean("x", F.lit("boolean(/feed)"))
    get = lambda rss, at: F.when(atom, F.xpath("x", F.lit(at))).otherwise(F.xpath("x", F.lit(rss)))
    cols = F.arrays_zip(get("//item/title/text()", "//entry/title/text()").alias("title"), get("//item/link/text()", "//entry/link/@href").alias("link"), get("//item/pubDate/text()", "//entry/updated/text()").alias("published"))
    title = F.when(atom, F.xpath_string("x", F.lit("/feed/title"))).otherwise(F.xpath_string("x", F.lit("/rss/channel/title")))
    return x.select(title.alias("feed_title"), F.explode(cols).alias("r")).select("feed_title", "r.title", "r.link", "r.published")


def arcgis_features(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Attributes, WGS84 point and GeoJSON geometry of each feature; Web-Mercator coordinates are converted.

    Points without two numbers drop out, and with them lines and rings that hold no other; a feature without any is kept
    with a null geometry.
    """
    from evifuse.functions.geo import mercator_to_wgs84

    lines = "array<array<array<double>>>"
    schema = f"spatialReference struct<wkid:int,latestWkid:int>, features array<struct<attributes:map<string,string>,geometry:struct<x:double,y:double,points:array<array<double>>,paths:{lines},rings:{lines}>>>"
    f = payloads.select(F.from_json(payload, schema).alias("j")).select("j.spatialReference", F.explode("j.features").alias("f")).select("f.attributes", "f.geometry.*", F.coalesce("spatialReference.latestWkid", "spatialReference.wkid").alias("wkid"))
    mercator = F.col("wkid").isin(3857, 102100, 102113)

    def place(x, y):
        lon, lat = mercator_to_wgs84(x, y)
        return F.when(x.isNotNull() & y.isNotNull(), F.when(mercator, F.array(lon, lat)).otherwise(F.array(x, y)))

    line = lambda points: F.array_compact(F.transform(points, lambda p: place(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    every = lambda parts: F.filter(F.transform(parts, line), lambda p: F.size(p) > 0)
    shaped = f.select("attributes", place(F.col("x"), F.col("y")).alias("point"), line(F.col("points")).alias("points"), every(F.col("paths")).alias("paths"), every(F.col("rings")).alias("rings"))
    geojson = lambda kind, value: F.to_json(F.struct(F.lit(kind).alias("type"), value.alias("coordinates")))
    geometry = (
        F.when(F.col("point").isNotNull(), geojson("Point", F.col("point")))
        .when(F.size("points") > 0, geojson("MultiPoint", F.col("points")))
        .when(F.size("paths") == 1, geojson("LineString", F.get("paths", F.lit(0))))
        .when(F.size("paths") > 1, geojson("MultiLineString", F.col("paths")))
        .when(F.size("rings") > 0, geojson("Polygon", F.col("rings")))
    )
    return shaped.select("attributes", F.get("point", F.lit(0)).alias("lon"), F.get("point", F.lit(1)).alias("lat"), geometry.alias("geometry"))


def ckan_packages(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per package and resource."""
    schema = "result struct<count:long,results:array<struct<id:string,title:string,resources:array<struct<id:string,url:string,format:string>>>>>"
    p = payloads.select(F.from_json(payload, schema).alias("j")).select(F.explode("j.result.results").alias("p"))
    return p.select(F.col("p.id").alias("package_id"), F.col("p.title").alias("title"), F.explode_outer("p.resources").alias("r")).select("package_id", "title", F.col("r.id").alias("resource_id"), F.col("r.url").alias("url"), F.lower("r.format").alias("format"))


def pages(records: DataFrame) -> DataFrame:
    """Records of paginated scans ``(page_no, payload)`` without repeats: the first page of a record stays."""
    from evifuse.functions.text import record_hash

    return records.groupBy(record_hash(F.col("payload")).alias("signature")).agg(F.min_by("payload", "page_no").alias("payload"), F.min("page_no").alias("page_no"))


class _Table(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            names = [r[0] for r in c.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
        return [_Table(n) for n in names]

    def read(self, partition):
        import json

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            cursor = c.execute('select * from "' + partition.name.replace('"', '""') + '"')
            names = [d[0] for d in cursor.description]
            for row in cursor:
                yield partition.name, json.dumps(dict(zip(names, row)), default=str, sort_keys=True)


class SqliteSource(DataSource):
    """Tables of an SQLite file, one partition each; the file must be readable by the workers."""

    @classmethod
    def name(cls):
        return "sqlite_tables"

    def schema(self):
        return "table_name string, payload string"

    def reader(self, schema):
        return _SqliteReader(self.options["path"])


def sqlite(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_tables").option("path", path).load()


READERS = {"jsonl": jsonl, "json": json_documents, "txt": text_lines, "csv": csv, "sqlite": sqlite}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Dispatch by declared kind, else by suffix."""
    return READERS[kind or infer_format(path)](spark, path)
