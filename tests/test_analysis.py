"""Document analysis, adaptive geofence grids, folds over batches and listings on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evifuse.operators import analysis, evidence, fusion, geofence, graph, listings, planning

FORMATS = [
    ("wss://a.org/x", "", "hello", "stream"),
    ("http://a.org/x.m3u8", "", "#EXTM3U", "stream"),
    ("http://a.org/x", "", "%PDF-1.4", "pdf"),
    ("http://a.org/x", "image/png", "", "image"),
    ("http://a.org/x", "", '{"openapi": "3.0"}', "openapi"),
    ("http://a.org/x", "", '{"type": "Point", "coordinates": [1, 2]}', "geojson"),
    ("http://a.org/x", "", ' {"a": 1}', "json"),
    ("http://a.org/x", "", '{\n"a": [1,\n2]\n}', "json"),
    ("http://a.org/x", "", '{"a": 1}\n{"a": 2}\n', "jsonl"),
    ("http://a.org/x.ndjson", "", "{broken", "jsonl"),
    ("http://a.org/x", "", "<!DOCTYPE html><p>", "html"),
    ("http://a.org/x", "text/html; charset=utf-8", "<p>", "html"),
    ("http://a.org/x", "", '<?xml version="1.0"?><urlset></urlset>', "sitemap"),
    ("http://a.org/x", "", "<!-- c --><rss><channel></channel></rss>", "rss"),
    ("http://a.org/x", "", '<feed xmlns="http://www.w3.org/2005/Atom"></feed>', "atom"),
    ("http://a.org/x", "", "<kml></kml>", "kml"),
    ("http://a.org/x", "", "<a><b/></a>", "xml"),
    ("http://a.org/x.xml", "", "<broken", "xml"),
    ("http://a.org/x", "", "a;b\n1;2", "csv"),
    ("http://a.org/x", "", "plain words", "text"),
    ("http://a.org/x", None, None, "text"),
]


def test_formats(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(FORMATS)], "i int, url string, media string, text string, want string")
    got = df.select("i", "want", analysis.detected_format(F.col("url"), F.col("media"), F.col("text")).alias("got")).collect()
    assert [(r.i, r.got) for r in got if r.got != r.want] == []


def test_analysis_of_fields(spark):
    rows = [
        ('{"location": {"name": "x", "city": "Ghent", "latitude": "51.05", "lng": 3.72}, "modified": "2024-02-03T04:05:06Z", "eventDate": "2024-01-01", "route": "E40"}', "json"),
        ('<kml><Placemark><city>Ghent</city><coordinates>3.72,51.05,0 4.0,50.0</coordinates></Placemark></kml>', "kml"),
        ("city,lat,lon,updated\nGhent,51.05,3.72,2024-02-03\nBruges,91,3,", "csv"),
        ('<!DOCTYPE x [<!ENTITY a "b">]><a>&a;</a>', "xml"),
        ("{broken", "text"),
        (None, "text"),
    ]
    df = spark.createDataFrame([(i, "http://a.org/d", t, 1) for i, (t, _) in enumerate(rows)], "i int, url string, text string, other int")
    got = {r.i: r for r in analysis.analyze(df).collect()}
    assert [got[i].detected_format for i in range(6)] == [k for _, k in rows]
    assert [tuple(p) for p in got[0].points] == [(51.05, 3.72)] and got[0].places == ["Ghent"] and got[0].routes == ["E40"]
    assert got[0].modified_at.isoformat() == "2024-02-03T04:05:06" and len(got[0].observed_dates) == 1 and got[0].recommended_kind == "http_json"
    assert [tuple(p) for p in got[1].points] == [(51.05, 3.72), (50.0, 4.0)] and got[1].places == ["Ghent"]
    assert [tuple(p) for p in got[2].points] == [(51.05, 3.72)] and got[2].places == ["Ghent", "Bruges"] and got[2].updated_at is not None
    assert got[3].places == got[4].points == [] and got[5].content_hash is None
    assert analysis.analyze(df.limit(0)).count() == 0


def test_points_outside_the_globe(spark):
    rows = ["lat,lon\n302.25,0.5\n-7.5,500.25", '{"lat": "302.25", "lon": "0.5"}\n{"lat": 1e999, "lon": 1}', "<r><lat>302.25</lat><lon>0.5</lon></r>", '{"type": "Feature", "geometry": {"type": "Point", "coordinates": [0.5, 302.25]}}', "text lat: 95, lon: 200"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string").withColumn("url", F.lit("http://a.org/d"))
    points = lambda got: [[tuple(p) for p in r.points] for r in got.orderBy("i").collect()]
    assert points(analysis.analyze(df)) == [[]] * 5
    assert points(analysis.analyze(df, bounds=None)) == [[(302.25, 0.5), (-7.5, 500.25)], [(302.25, 0.5)], [(302.25, 0.5)], [(302.25, 0.5)], [(95.0, 200.0)]]


def test_links(spark):
    page = '<base href="http://a.org/d/"><a href="x">1</a><A class="c" HREF=\'y#z\' rel="nofollow">2</A><a href="http://b.org/">3</a><a href="mailto:q@a.org">4</a><a href="x">5</a><a href="/p">self</a><a name="n">'
    got = analysis.page_links(spark.createDataFrame([(1, "http://a.org/p", page), (2, "http://a.org/q", None)], "page_id int, url string, html string"), "page_id").orderBy("position").collect()
    assert [(r.page_id, r.canonical_url, r.same_domain, r.nofollow) for r in got] == [(1, "http://a.org/d/x", True, False), (1, "http://a.org/d/y", True, True), (1, "http://b.org/", False, False)]


def test_all_links_of_a_page_count(spark):
    """Before, links after the first 500 of a page or document were dropped, also where the first 500 led elsewhere."""
    page = "".join(f'<a href="http://b.org/{i}">e</a>' for i in range(500)) + "".join(f'<a href="/own/{i % 700}">o</a>' for i in range(1400))
    got = analysis.page_links(spark.createDataFrame([(1, "http://a.org/p", page)], "page_id int, url string, html string"), "page_id")
    assert got.count() == 1200 and got.filter("same_domain").count() == 700 and got.agg(F.max("position")).first()[0] == 1199
    text = "[" + ", ".join(f'{{"url": "/r/{i}"}}' for i in range(600)) + "]"
    assert analysis.record_links(spark.createDataFrame([(1, "http://a.org/d.json", text)], "i int, url string, text string"), "i").count() == 600


def test_geofences_of_any_size(spark):
    box = lambda w, s, e, n: [[[[w, s], [e, s], [e, n], [w, n]]]]
    fences = [(1, True, box(-179.0, -89.0, 179.0, 89.0)), (2, True, box(3.0, 50.0, 4.0, 51.0)), (3, True, box(-90.0, -45.0, 90.0, 45.0)), (4, False, box(0.0, 0.0, 1.0, 1.0)), (5, True, [])]
    f = spark.createDataFrame(fences, "geofence_id long, enabled boolean, polygons array<array<array<array<double>>>>")
    r = random.Random(1)
    points = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(300)] + [(900, 3.5, 50.5), (901, None, 1.0)]
    p = spark.createDataFrame(points, "observation_id long, lon double, lat double")
    want = {(i, g) for i, x, y in points if x is not None for g, on, poly in fences if on and poly and poly[0][0][0][0] < x < poly[0][0][1][0] and poly[0][0][0][1] < y < poly[0][0][2][1]}
    for more in ({}, {"cell": 0.01, "most_cells": 64}):
        assert {(x.observation_id, x.geofence_id) for x in geofence.hits(p, f, **more).collect()} == want
    assert geofence.hits(p, f.limit(0)).count() == 0


def test_clusters_fold_batch_by_batch(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(0, 40_000_000_000), r.uniform(3, 3.6), r.uniform(50, 50.4)) for i in range(400)]
    rows = [(i, t // 7_200_000_000 * 20_000_000_000 + t % 7_200_000_000, x, y) for i, t, x, y in rows]
    df = spark.createDataFrame(rows, "observation_id long, t_us long, lon double, lat double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x.observation_id: x.cluster_seed for x in fusion.assign_clusters(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    order = sorted((t, i, x, y) for i, t, x, y in rows)
    assert got == dict(zip([i for _, i, _, _ in order], fusion.fold(order, 3_600_000_000, 25.0))) and 10 < len(set(got.values())) < 390


def test_far_clusters_cost_no_distance(monkeypatch):
    """The same clusters as with every distance, for a few distances a row."""
    r, plain, calls = random.Random(4), fusion._km, []

    def every(rows, window_us, km):
        alive, out = [], []
        for t, i, lon, lat in rows:
            alive = [c for c in alive if t - c[1] <= window_us]
            c = next((c for c in alive if plain(c[2] / c[4], c[3] / c[4], lon, lat) <= km), None)
            if c is None:
                c = [i, t, 0.0, 0.0, 0]
                alive.append(c)
            c[1], c[2], c[3], c[4] = t, c[2] + lon, c[3] + lat, c[4] + 1
            out.append(c[0])
        return out

    monkeypatch.setattr(fusion, "_km", lambda *a: calls.append(1) or plain(*a))
    edge = 25.0 / fusion.EARTH_KM * 180 / 3.141592653589793
    for spots in ([(3 + i * 0.05, 50 + j * 0.05) for i in range(40) for j in range(40)], [(r.choice([179.9, -179.9]), r.uniform(-1, 1)) for _ in range(99)], [(r.uniform(-180, 180), r.choice([90.0, 89.9, -89.9])) for _ in range(99)], [(0.0, edge), (0.0, 0.0), (edge, 0.0)]):
        for km in (0.0, 25.0, 15_000.0):
            rows = sorted((r.randrange(0, 40_000_000_000), i, *r.choice(spots)) for i in range(300))
            assert fusion.fold(rows, 3_600_000_000, km) == every(rows, 3_600_000_000, km)
    calls.clear()
    rows = [(i * 1000, i, 3 + r.randrange(40) * 0.05, 50 + r.randrange(40) * 0.05) for i in range(3000)]
    assert fusion.fold(rows, 3_600_000_000, 25.0) == every(rows, 3_600_000_000, 25.0) and len(calls) < 3 * len(rows)


def test_research_plan_keeps_the_caps(spark):
    r = random.Random(3)
    rows = [(i % 3, i, r.choice("abc"), f"d{r.randrange(9)}", r.randrange(5), r.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "question_id long, source_id long, source_class string, domain string, relevance long, trust double")
    want = set()
    for q in range(3):
        classes, domains, n = {}, {}, 0
        for _, i, c, d, rel, trust in sorted((x for x in rows if x[0] == q), key=lambda x: (-x[4], -x[5], x[2], x[3], x[1])):
            if n < 14 and classes.get(c, 0) < 6 and domains.get(d, 0) < 2:
                classes[c], domains[d], n = classes.get(c, 0) + 1, domains.get(d, 0) + 1, n + 1
                want.add((q, i, 1000 + rel * 10 + int(trust * 10)))
    assert {tuple(x) for x in planning.research_plan(df, 6, 2, 14).collect()} == want


def test_nearest_hashes_with_copies(spark):
    r = random.Random(4)
    base = ["".join(r.choice("01") for _ in range(64)) for _ in range(6)]
    flip = lambda b, k: "".join("10"[int(c)] if j in k else c for j, c in enumerate(b))
    bits = [flip(b, set(r.sample(range(64), r.randint(0, 3)))) for b in base for _ in range(12)]
    rows = list(enumerate(bits)) + [(100 + i, bits[0]) for i in range(30)]
    want = {}
    for i, a in rows:
        near = min(((sum(x != y for x, y in zip(a, b)), j) for j, b in rows if j != i), default=None)
        if near and near[0] <= 4:
            want[i] = near
    got = {x.id: (x.distance, x.nearest) for x in evidence.near_duplicate_hashes(spark.createDataFrame(rows, "id long, bits string")).collect()}
    assert got == want


def test_limitations_and_relation_types(spark):
    e = spark.createDataFrame([(1, 1, "supports", "a", 1.0, "inferential"), (2, 2, "contradicts", "a", 1.0, "direct"), (3, 3, "supports", "a", 1.0, "direct"), (3, 4, "supports", "b", 1.0, "direct")], "claim_id long, evidence_id long, relation string, independence_key string, source_trust double, statement_kind string")
    e = e.withColumn("age_days", F.lit(0.0)).withColumn("fit", F.lit(1.0)).withColumn("completeness", F.lit(1.0))
    got = {r.claim_id: [evidence.LIMITATIONS.index(x) for x in r.limitations] for r in evidence.assess_claims(e).collect()}
    assert got == {1: [2, 3], 2: [0, 1, 4], 3: []}
    types = spark.createDataFrame([(f"t{i}", ["person"], ["vessel"]) for i in range(300)] * 2, "relation_type string, subject_types array<string>, object_types array<string>")
    rows = spark.createDataFrame([(i, f"t{i}", i, -i, "person", "vessel") for i in range(1, 310)], "assertion_id long, relation_type string, subject_entity_id long, object_entity_id long, subject_type string, object_type string")
    out = graph.check_assertions(rows, types, rows.select("assertion_id"))
    assert out.count() == 309 and out.filter("reject_reason is null").count() == 299


def test_listings(spark):
    q = spark.createDataFrame([(1, "queued", 1, 5, None), (2, "running", 9, 1, 1), (3, "running", 9, 1, 99), (4, "queued", 5, 2, None)], "task_id int, status string, priority int, created_at int, lease_expires_at int")
    assert [r.task_id for r in listings.claim_next(q, F.lit(10), 5).collect()] == [2, 4, 1]
    t = spark.createDataFrame([("2024-01-01", "x", None, "2024-03-01T00:00:00Z")], "a string, b string, c string, d string")
    assert t.select(listings.best_time(*[F.col(c) for c in t.columns]).alias("t")).first().t.isoformat() == "2024-03-01T00:00:00"
    rows = spark.createDataFrame([("public",), ("public",)], "redaction_level string")
    assert listings.exportable(rows, "public").count() == 2
    with pytest.raises(Exception, match="redaction level above"):
        listings.exportable(rows.union(spark.createDataFrame([("restricted",)], "redaction_level string")), "public").collect()
    none = listings.entity_profile(F.lit(9).cast("long"), spark.createDataFrame([], "entity_id long, alias string"), spark.createDataFrame([], "assertion_id long, subject_entity_id long, object_entity_id long"), spark.createDataFrame([], "assertion_id long, source_uri string"))
    assert listings.coverage_status(none).first().status == "insufficient_evidence"


def test_links_of_records(spark):
    rows = [
        ("https://a.org/d.json", '{"name": "x", "data_url": "/no", "downloadUrl": "/f?utm_campaign=x", "more": [{"see": "HTTPS://B.org:443/y"}, "wss://b.org/s"], "href": "mailto:a@b.org", "self": "https://a.org/d.json", "uri": "f"}'),
        ("https://a.org/d.xml", "<r><loc>https://c.org/1</loc><loc>https://c.org/1</loc><name>plain</name><link rel='Next' href='?p=2'/><e url='/e'>t</e><guid>g7</guid></r>"),
        ("https://a.org/d.csv", "id,link\n1,/p\n2,/q\n3,/p"),
        ("https://a.org/d", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, text string")
    got = [(r.i, r.canonical_url, r.origin, r.relation, r.same_domain) for r in analysis.record_links(df, "i").orderBy("i", "position").collect()]
    assert got == [
        (0, "https://a.org/f", "json_url", "downloadurl", True), (0, "https://b.org/y", "json_url", "see", False), (0, "wss://b.org/s", "json_url", "more", False),
        (1, "https://c.org/1", "xml_loc", "loc", False), (1, "https://a.org/d.xml?p=2", "xml_attribute", "next", True), (1, "https://a.org/e", "xml_attribute", "e", True), (1, "https://a.org/g7", "xml_loc", "guid", True),
        (2, "https://a.org/p", "csv_url", "link", True), (2, "https://a.org/q", "csv_url", "link", True),
    ]
    assert analysis.record_links(df.limit(0), "i").count() == 0


def test_links_are_put_in_canonical_form_once(spark):
    """Once for the page and once for each link: the form is a long expression, and a filter on it used to repeat it."""
    pages = spark.createDataFrame([(1, "https://a.example/x", '<a href="/y">y</a><a href="/x">x</a><a href="mailto:z">z</a>')], "id long, url string, html string")
    records = pages.select("id", "url", F.lit('{"url": "https://b.example/"}').alias("text"))
    for df in (analysis.page_links(pages, "id"), analysis.record_links(records, "id")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("dclid") <= 2
        assert df.count() == 1


def test_prominence_holds_no_table_of_assertions(spark):
    """A task neither hashes all assertion ids for a semi join nor sorts edges again, once for each end."""
    edges = spark.createDataFrame([(1, 7, 8, 0.5), (2, 7, 9, 0.5)], "assertion_id long, subject_entity_id long, object_entity_id long, confidence_score double")
    cited = spark.createDataFrame([(1, "u"), (1, "v"), (2, "u")], "assertion_id long, source_uri string")
    df = graph.prominence(graph.eligible(edges, cited), cited)
    assert "Aggregate [assertion_id" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.entity_id, r.relationship_count, r.distinct_source_count) for r in df.collect()} == {(7, 2, 2), (8, 1, 2), (9, 1, 1)}
