"""Operators on small fixtures with known outcomes."""

from __future__ import annotations

import hashlib
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from evifuse.functions import geo, rules, signals, urls
from evifuse.functions import text as tx
from evifuse.operators import cameras, components, entities, evidence, fusion, geofence, graph, lifecycle, lookups, observations, planning, watches
from evifuse.sources import archive, readers
from evifuse.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, want",
    [("HTTPS://User:pw@WWW.Example.com:8080/a?b", "example.com"), ("example.org:443", "example.org"), ("[::1]", "::1"), ("a@b.net", "b.net"), ("", None), (None, None), ("www.x.y/z", "x.y")],
)
def test_normalize_domain(spark, raw, want):
    assert one(spark, tx.normalize_domain(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "raw, base, want",
    [
        ("HTTP://Example.COM:80//a/../b/?utm_source=x&z=2&a=1#top", None, "http://example.com/b/?a=1&z=2"),
        ("../c?fbclid=1", "https://e.org/a/b/", "https://e.org/a/c"),
        ("bücher.example/x", None, "https://xn--bcher-kva.example/x"),
        ("mailto:a@b.c", None, None),
        ("/relative", None, None),
        ("https://user:p@h.com/%7ea%2f", None, "https://h.com/~a%2F"),
        ("//h.com/a/./b/..", None, "https://h.com/a/"),
        ("https://h.com:08443/?b=&a=%C3%A9+1&amp;B=*~%zz&c", None, "https://h.com:8443/?a=%C3%A9%201&B=%2A~%25zz&b=&c="),
        ("?q=1", "http://e.org/a/b?x=2", "http://e.org/a/b?q=1"),
        ("#top", "http://e.org/a/b?x=2", "http://e.org/a/b?x=2"),
        ("wss://[2001:DB8::1]:443/", None, "wss://[2001:db8::1]/"),
        ("https://h.com:99999/", None, None),
        ("https://a..b/", None, None),
        ("ftp://h.com/", None, None),
        ("https://h.com./%2e%2e/%", None, "https://h.com/%"),
        ("  ", "http://e.org/", None),
        (None, None, None),
    ],
)
def test_canonical_url(spark, raw, base, want):
    df = spark.createDataFrame([(raw, base)], "u string, b string")
    assert df.select(urls.canonical_url(F.col("u"), F.col("b") if base else None).alias("c")).first()["c"] == want


def test_path_pattern(spark):
    f = lambda u: one(spark, urls.path_pattern(F.lit(u)))
    assert f("https://x.y/report/42.PDF") == "/report/{id}.pdf"
    assert f("https://x.y/a/2024-01-31/123e4567-e89b-12d3-a456-426614174000") == "/a/{date}/{uuid}"
    assert f("https://x.y/h/0123456789abcdef0") == "/h/{hash}"


def test_signals_and_times(spark):
    n = lambda k, v: one(spark, tx.normalize_signal(F.lit(k), F.lit(v)))
    assert n("phone", "+1 (555) 010-9999") == "15550109999" and n("phone", "12345") is None
    assert n("handle", "@Some ") == "some" and n("imo", "imo 123-45") == "IMO12345" and n("full_name", " A   B ") == "a b"
    t = lambda v: str(one(spark, rules.parse_time(F.lit(v)).cast("string")))
    assert t("1700000000") == t("1700000000000") == "2023-11-14 22:13:20" and t("2024-01-01T00:00:00+02:00") == "2023-12-31 22:00:00" and t("x") == "None"
    assert one(spark, tx.cursor_decode(tx.cursor_encode(F.lit(77)))) == 77


def test_geometry(spark):
    ring = F.lit(json.dumps([[0, 0], [4, 0], [4, 4], [0, 4]]))
    arr = F.from_json(ring, "array<array<double>>")
    assert one(spark, geo.in_ring(F.lit(1.0), F.lit(1.0), arr)) and not one(spark, geo.in_ring(F.lit(5.0), F.lit(1.0), arr))
    assert not one(spark, geo.in_ring(F.lit(1.0), F.lit(1.0), F.slice(arr, 1, 2)))
    assert one(spark, geo.point_wkt(F.lit(1.5), F.lit(2.0))) == "POINT (1.5 2)"
    assert abs(one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) - 111.195) < 0.01


def test_geofence_scan_is_idempotent(spark):
    fence = spark.createDataFrame([(1, True, [[[[-96.0, 29.0], [-94.0, 29.0], [-94.0, 31.0], [-96.0, 31.0]]]])], "geofence_id long, enabled boolean, polygons array<array<array<array<double>>>>")
    p = spark.createDataFrame([(1, -95.0, 30.0, "blocked"), (2, -90.0, 30.0, "neutral"), (3, None, None, "neutral")], "observation_id long, lon double, lat double, trust_level string")
    found = geofence.hits(p, fence)
    new = geofence.alerts(found)
    assert [(r.observation_id, r.severity) for r in new.collect()] == [(1, "warning")]
    assert geofence.alerts(found, new.withColumn("status", F.lit("open"))).count() == 0
    assert geofence.hits(p, fence, cell=0.01, most_cells=10).count() == 1


def test_longest_suffix(spark):
    f = spark.createDataFrame([("a.b.example.com",), ("other.org",), (None,)], "source_domain string")
    p = spark.createDataFrame([("example.com", "neutral", "manual_review"), ("b.example.com", "trusted", "auto")], "domain string, trust_level string, approval_policy string")
    got = {r.source_domain: (r.trust_level, r.confidence_score) for r in lookups.annotate_trust(f, p).collect()}
    assert got == {"a.b.example.com": ("trusted", 0.85), "other.org": ("neutral", 0.5), None: ("neutral", 0.5)}


def full_fold(rows, window_us, km):
    """Every cluster stays in the list: the plain form."""
    clusters = []
    for t, i, lon, lat in sorted(rows):
        for c in clusters:
            if abs(t - c["end"]) <= window_us and fusion._km(c["x"] / c["n"], c["y"] / c["n"], lon, lat) <= km:
                c["end"], c["x"], c["y"], c["n"] = t, c["x"] + lon, c["y"] + lat, c["n"] + 1
                c["ids"].append(i)
                break
        else:
            clusters.append({"end": t, "x": lon, "y": lat, "n": 1, "ids": [i]})
    return {i: c["ids"][0] for c in clusters for i in c["ids"]}


def test_clustering_equals_the_plain_fold(spark):
    r = random.Random(3)
    rows = [(r.randrange(0, 3_000) * 60_000_000, i, -95 + r.random() * 0.6, 29 + r.random() * 0.6) for i in range(400)]
    df = spark.createDataFrame([(i, t, x, y) for t, i, x, y in rows], "observation_id long, t_us long, lon double, lat double")
    got = {x.observation_id: x.cluster_seed for x in fusion.assign_clusters(df, 60, 25.0).collect()}
    assert got == full_fold(rows, 3_600_000_000, 25.0)


def test_large_sessions_split_by_place(spark, monkeypatch):
    r = random.Random(5)
    rows = [(r.randrange(0, 600) * 60_000_000, i, r.choice([-95.0, -93.0, 10.0]) + r.random() * 0.4, r.choice([29.0, 33.0]) + r.random() * 0.4) for i in range(500)]
    make = lambda rows: spark.createDataFrame([(i, t, x, y) for t, i, x, y in rows], "observation_id long, t_us long, lon double, lat double")
    monkeypatch.setattr(fusion, "LARGE", 50)
    monkeypatch.setattr(fusion, "BLOCK", 3)
    got = {x.observation_id: x.cluster_seed for x in fusion.assign_clusters(make(rows), 60, 25.0).collect()}
    assert got == full_fold(rows, 3_600_000_000, 25.0)
    timed = fusion.sessions(make(rows), 3_600_000_000)
    assert fusion.places(timed, 3_600_000_000, 25.0).select("place").distinct().count() >= 6
    rows += [(t, 1000 + i, x, y) for i, (t, x, y) in enumerate([(0, 179.95, 29.1), (60_000_000, -179.95, 29.1), (90_000_000, 0.0, 29.1)])]
    got = {x.observation_id: x.cluster_seed for x in fusion.assign_clusters(make(rows), 60, 25.0).collect()}
    assert got == full_fold(rows, 3_600_000_000, 25.0) and got[1002] == 1000


def test_event_fusion_reruns_add_nothing(spark):
    rows = [(1, "cam", "a.org", 0, -95.0, 30.0, "trusted", 0.85, True), (2, "news", "b.org", 300_000_000, -95.01, 30.01, "neutral", 0.5, False)]
    df = spark.createDataFrame(rows, "observation_id long, layer_key string, source_domain string, t_us long, lon double, lat double, trust_level string, confidence_score double, ground_truth boolean")
    events, links, products = fusion.fuse_events(df)
    e = events.first()
    assert (e.observation_count, e.source_domain_count, e.trusted_observation_count, e.ground_truth_count, e.time_span_minutes) == (2, 2, 1, 1, 5.0)
    assert links.count() == 2 and products.count() == 2
    again = fusion.fuse_events(df, events, links)
    assert [x.count() for x in again] == [0, 0, 0]


def test_entities(spark):
    rows = [(1, "a.org", "ais", json.dumps({"vessel_name": "Sea Star", "mmsi": "123456789"}), ""), (2, "b.org", "ais", json.dumps({"vessel_name": "sea  star"}), ""), (3, "c.org", "web", "{}", "mail X@Y.org now")]
    df = spark.createDataFrame(rows, "observation_id long, source_domain string, layer_key string, content_json string, content_text string")
    got = entities.resolve(entities.signals(df)).collect()
    assert len(got) == 1 and (got[0].observation_count, got[0].signal_count, got[0].canonical_name) == (2, 2, "Sea Star")
    assert abs(got[0].confidence - 0.98) < 1e-9


def test_merge_decisions(spark):
    def c(i, ids, names, ctx, domains, kind="vessel"):
        return (i, kind, names, ids, ctx, domains, True, 0.8)

    rows = [c(1, {"imo": "1"}, ["a"], {}, ["x"]), c(2, {"imo": "1"}, ["b"], {}, ["y"]), c(3, {"imo": "2"}, ["a"], {}, ["y"]), c(4, {}, ["a"], {"k": "1", "l": "2"}, ["z"]), c(5, {}, ["a"], {"k": "1", "l": "2"}, ["w"])]
    df = spark.createDataFrame(rows, "candidate_id long, entity_type string, names array<string>, ids map<string,string>, context map<string,string>, domains array<string>, cited boolean, reliability double")
    got = {(r.left_id, r.right_id): r.decision for r in entities.merge_pairs(df).collect()}
    assert got[(1, 2)] == "merge" and got[(1, 3)] == "do_not_merge" and got[(4, 5)] == "merge" and got[(1, 4)] == "ambiguous" and (2, 3) not in got
    many = df.union(spark.range(100, 400).crossJoin(df.filter("candidate_id = 4").drop("candidate_id")))
    pairs = {(r.left_id, r.right_id): (r.left_count, r.right_count, r.decision) for r in entities.merge_pairs(many).collect()}
    assert set(pairs) - set(got) == {(4, 4)} and pairs[(4, 5)] == (301, 1, "merge") and pairs[(4, 4)] == (301, 301, "ambiguous")
    assert {r.class_id for r in entities.evidence_classes(many).filter("candidate_id >= 100").collect()} == {4}


def test_claims(spark):
    rows = [(1, 1, "supports", "o", 0.9, 0.0), (1, 2, "supports", "o", 0.9, 0.0), (2, 3, "supports", "a", 0.9, 0.0), (2, 4, "contradicts", "b", 0.3, 0.0), (3, 5, "context", "c", 0.9, 0.0)]
    df = spark.createDataFrame(rows, "claim_id long, evidence_id long, relation string, independence_key string, source_trust double, age_days double").withColumn("fit", F.lit(1.0)).withColumn("completeness", F.lit(1.0))
    got = {r.claim_id: (r.support_count, r.status) for r in evidence.assess_claims(df).collect()}
    assert got == {1: (1, "supported"), 2: (1, "contested"), 3: (0, "insufficient_evidence")}


def test_materiality(spark):
    base = dict(evidence_version="1", claim_id="c", claim_version="1", claim_relation="supports", visual_change=False, previous_status=None, status=None, confidence=0.9, previous_confidence=None, claim_impact=1.0, temporal_relevance=1.0, geographic_relevance=1.0, event_id="e", citation_ids=["x"])
    rows = [base | dict(seq=1, evidence_id="a", content_hash="h1", source_independence_key="s1"), base | dict(seq=2, evidence_id="b", content_hash="h1", source_independence_key="s1"), base | dict(seq=3, evidence_id="c", content_hash="h2", source_independence_key="s2"), base | dict(seq=4, evidence_id="d", content_hash="h3", source_independence_key="s3", claim_relation="contradicts", confidence=0.75), base | dict(seq=5, evidence_id="e", content_hash="h4", source_independence_key="s4", confidence=0.25)]
    schema = "seq long, evidence_id string, evidence_version string, claim_id string, claim_version string, content_hash string, source_independence_key string, claim_relation string, visual_change boolean, previous_status string, status string, confidence double, previous_confidence double, claim_impact double, temporal_relevance double, geographic_relevance double, event_id string, citation_ids array<string>"
    got = {r.seq: (r.update_type, r.alert, r.reviewable) for r in evidence.materiality(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("new_fact", True, False), 2: ("no_material_change", False, False), 3: ("corroboration", True, False), 4: ("contradiction", True, False), 5: ("corroboration", False, True)}


def test_visual_change(spark):
    o = dict(o_artifact_id="o", o_exact_hash="1", o_perceptual_hash="ff00", o_site_id="s", o_named_locations=[], o_target_location_names=[], o_geospatial_match=1.0, o_scene_embedding=[1.0, 0.0], o_object_labels=["crane", "steel"], o_ocr_text="new", o_source_credibility=1.0, o_capture_time="t", o_source_excerpt="x")
    b = dict(b_artifact_id="b", b_exact_hash="2", b_perceptual_hash="00ff", b_scene_embedding=[-1.0, 0.0], b_object_labels=[], b_ocr_text="old")
    rows = [o | b, o | b | dict(b_perceptual_hash="ff01"), o | b | dict(o_site_id=None, o_geospatial_match=0.0), o | {k: None for k in b}]
    schema = ", ".join(f"{k} {'array<double>' if 'embedding' in k else 'array<string>' if 'labels' in k or 'locations' in k or 'names' in k else 'double' if 'match' in k or 'credibility' in k else 'string'}" for k in [*o, *b])
    got = [r.classification for r in evidence.visual_change(spark.createDataFrame([tuple(r[k] for k in [*o, *b]) for r in rows], schema)).collect()]
    assert got == ["material_change_candidate", "duplicate", "irrelevant", "insufficient_context"]


def test_near_duplicate_hashes(spark):
    a = "01" * 32
    rows = [(1, a), (2, a[:60] + "1010"), (3, "1" * 64)]
    got = {r.id: (r.nearest, r.distance) for r in evidence.near_duplicate_hashes(spark.createDataFrame(rows, "id long, bits string")).collect()}
    assert got == {1: (2, 4), 2: (1, 4)}


def test_graph(spark):
    a = spark.createDataFrame([(1, 1, 2, 0.9, "US-MN", None, None), (2, 2, 3, 0.9, "US-MN", None, None), (3, 3, 4, 0.9, "US-MN", None, None), (4, 1, 3, 0.2, "FR", None, None)], "assertion_id long, subject_entity_id long, object_entity_id long, confidence_score double, jurisdiction string, valid_from timestamp, valid_to timestamp")
    c = spark.createDataFrame([(1, "u", "high"), (2, "u", "low"), (3, "v", "low")], "assertion_id long, source_uri string, source_reliability string")
    e = graph.eligible(a, c, jurisdiction="US-MN")
    nodes, edges = graph.network_slice(e, c, F.lit(1).cast("long"), 2)
    assert {(r.node, r.depth) for r in nodes.collect()} == {(1, 0), (2, 1), (3, 2)} and {r.assertion_id for r in edges.collect()} == {1, 2}
    assert graph.eligible(a, c, jurisdiction="FR").count() == 0


def test_component_labels(spark):
    pairs = [(i, i // 2) for i in range(40)] + [(i, 1000 + (i + 1) // 2) for i in range(40)] + [(99, 7777)]
    got = {r.item: r.label for r in components.min_labels(spark.createDataFrame(pairs, "item long, grp long"), "item", "grp").collect()}
    assert set(got.values()) == {0, 99} and got[39] == 0


def test_camera_upsert(spark):
    cols = "camera_key string, name string, source_domain string, provider string, status string, image_url string, stream_url string, page_url string"
    old = spark.createDataFrame([("a", "n", "d", "p", "ok", None, None, None), ("b", "n", "d", "p", "ok", None, None, None)], cols)
    new = spark.createDataFrame([("b", "n", "d", "p", "down", None, None, None), ("c", "n", "d", "p", "ok", None, None, None)], cols)
    got = {r.camera_key: (r.action, r.changed) for r in cameras.upsert(old, new).collect()}
    assert got == {"a": ("kept", []), "b": ("updated", ["status"]), "c": ("created", [])}


def test_research_plan_caps(spark):
    r = random.Random(1)
    rows = [(q, i, r.choice("abc"), r.choice("xyz"), r.randint(0, 3), r.random()) for q in (1, 2) for i in range(30)]
    got = planning.research_plan(spark.createDataFrame(rows, "question_id long, source_id long, source_class string, domain string, relevance long, trust double"), 3, 2, 5).collect()
    for q in (1, 2):
        picked = []
        for _, i, c, d, *_ in sorted((x for x in rows if x[0] == q), key=lambda x: (-x[4], -x[5], x[2], x[3], x[1])):
            if len(picked) < 5 and sum(p[1] == c for p in picked) < 3 and sum(p[2] == d for p in picked) < 2:
                picked.append((i, c, d))
        assert {x.source_id for x in got if x.question_id == q} == {p[0] for p in picked}


def test_records_and_rules(spark):
    rows = [(json.dumps({"title": "A", "url": "https://www.x.org/1", "lat": 30, "lon": "-95", "observed_at": 1700000000, "ground_truth": "yes"}),), (json.dumps({"text": "", "lat": 95, "lon": 0}),), ("not json",)]
    got = observations.normalize_records(spark.createDataFrame(rows, "payload string"), "payload", "news").collect()
    assert (got[0].source_domain, got[0].lon, got[0].lat, got[0].ground_truth, got[0].content_text) == ("x.org", -95.0, 30.0, True, "A")
    assert got[1].lon is None and got[1].ground_truth is False and got[2].raw_hash
    twice = spark.createDataFrame(rows + rows[:1], "payload string")
    n = observations.normalize_records(twice, "payload", "news")
    assert observations.dedupe(n).count() == 3 and observations.dedupe(n, n).count() == 0
    assert watches.compile_instruction('Watch "new pier" near Port Alpha')["rule"] == {"phrases": ["new pier"], "location": "Port Alpha"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n[1]\nbad\n{"b": 2}\n')
    (tmp_path / "b.json").write_text('{"items": [{"a": 1}, 3, {"a": 2}]}')
    (tmp_path / "c.txt").write_text("  one \n\n two\n")
    (tmp_path / "d.csv").write_bytes(b"\xef\xbb\xbfid,name\n1,x\n2,\n")
    (tmp_path / "f.xml").write_text('<?xml version="1.0"?><rss><channel><title>T</title><item><title>A</title><link>l1</link><pubDate>d1</pubDate></item><item><title>B</title><link>l2</link><pubDate>d2</pubDate></item></channel></rss>')
    with sqlite3.connect(tmp_path / "e.db") as c:
        c.execute("create table t (a int, b text)")
        c.execute("insert into t values (1, 'x')")
    p = lambda n: f"{tmp_path}/{n}"
    assert readers.read(spark, p("a.jsonl")).count() == 2 and readers.read(spark, p("b.json")).count() == 2
    assert [r.content_text for r in readers.read(spark, p("c.txt")).collect()] == ["one", "two"]
    assert [(r.id, r.record_title) for r in readers.csv_records(spark, p("d.csv")).collect()] == [("1", "x"), ("2", "2")]
    assert [(r.feed_title, r.title, r.link) for r in readers.feed(spark, p("f.xml")).collect()] == [("T", "A", "l1"), ("T", "B", "l2")]
    assert [(r.table_name, json.loads(r.payload)) for r in readers.read(spark, p("e.db")).collect()] == [("t", {"a": 1, "b": "x"})]
    arc = json.dumps({"spatialReference": {"wkid": 102100}, "features": [{"attributes": {"n": "x"}, "geometry": {"x": 111319.49079327358, "y": 0.0}}]})
    assert abs(readers.arcgis_features(spark.createDataFrame([(arc,)], "payload string")).first().lon - 1.0) < 1e-9
    shapes = [{"points": [[1, 2], [None, 1]]}, {"paths": [[[1, 2], [3, 4]]]}, {"paths": [[[1, 2]], [], [[3, 4]]]}, {"rings": [[[0, 0], [1, 0], [0, 1]]]}, {"rings": [[]]}, None, {"x": 1.5, "y": "bad"}]
    text = json.dumps({"features": [{"attributes": {"n": str(i)}, "geometry": g} for i, g in enumerate(shapes)]})
    made = [r.geometry and json.loads(r.geometry) for r in readers.arcgis_features(spark.createDataFrame([(text,)], "payload string")).collect()]
    assert [m and m["type"] for m in made] == ["MultiPoint", "LineString", "MultiLineString", "Polygon", None, None, None]
    assert made[0]["coordinates"] == [[1.0, 2.0]] and made[2]["coordinates"] == [[[1.0, 2.0]], [[3.0, 4.0]]]
    polygons = F.from_json(F.lit("[[[[0,0],[1,0.5],[0,0]]],[[]],[]]"), "array<array<array<array<double>>>>")
    assert one(spark, geo.multipolygon_wkt(polygons)) == "MULTIPOLYGON (((0 0, 1 0.5, 0 0)))" and one(spark, geo.multipolygon_wkt(F.slice(polygons, 2, 2))) is None


def test_watches_on_sources_and_images(spark):
    w = spark.createDataFrame([(1, 1, "source_delta"), (2, 2, "source_health"), (3, 3, "investigation_watch"), (4, None, "source_delta"), (5, 2, "source_delta"), (6, 9, "source_health")], "watch_id long, source_id long, watch_type string")
    sources = spark.createDataFrame([(1, False), (2, True), (3, False)], "source_id long, enabled boolean")
    runs = spark.createDataFrame([(1, 1, "completed", "a"), (1, 2, "failed", None), (3, 3, "completed", "c")], "source_id long, source_run_id long, status string, payload_sha256 string")
    got = {r.watch_id: (r.fingerprint, r.error) for r in watches.source_watches(w, sources, runs).collect()}
    assert got == {1: ("2", None), 2: ("never_run", None), 3: (None, "source is missing or disabled"), 4: (None, "no source"), 5: (None, "source has no run"), 6: ("disabled", None)}
    images = spark.createDataFrame([(1, "Image/PNG; q=1", b"x"), (2, "text/html", b"x"), (3, None, b"x")], "watch_id long, media_type string, content binary")
    assert {r.watch_id: (r.fingerprint is not None, r.error) for r in watches.image_watches(images).collect()} == {1: (True, None), 2: (False, "unsupported media type"), 3: (False, "unsupported media type")}


def test_archive_versions(spark, tmp_path):
    rows = [(1, "a/b", "2024-01-05 00:00:00", "2024-01-06 00:00:00", "old"), (1, "a/b", "2024-01-05 00:00:00", "2024-01-07 00:00:00", "new"), (2, "c", "2024-02-01 00:00:00", "2024-02-01 00:00:00", "x")]
    df = spark.createDataFrame(rows, "observation_id long, layer_key string, o string, u string, content_text string").select("observation_id", "layer_key", F.to_timestamp("o").alias("observed_at"), F.to_timestamp("u").alias("updated_at"), "content_text")
    archive.write_facts(df, f"{tmp_path}/f")
    assert {r.content_text for r in archive.read_facts(spark, f"{tmp_path}/f").collect()} == {"new", "x"}
    archive.export(df, f"{tmp_path}/a")
    assert archive.read_archive(spark, f"{tmp_path}/a", "a/b").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(w, i, f"f{(i * 7 + w) % 3}", "completed" if i % 4 else "failed") for w in range(3) for i in range(20)]
    df = spark.createDataFrame([(w, i * 3 + w, f, s) for w, i, f, s in rows], "watch_id long, watch_run_id long, fingerprint string, status string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = watch.run_available(watch.watch_outcomes(watch.landing_zone(spark, f"{tmp_path}/in", df.schema)), f"{tmp_path}/out", f"{tmp_path}/cp")
    key = lambda d: {(r.watch_run_id, r.outcome) for r in d.collect()}
    assert key(got) == key(watches.outcomes(df))


def test_text_and_json_signals(spark):
    t = F.lit("lat: 10.5, lng=20 and longitude: -30 then latitude=95; State Route 7, I-95, Pacific Line on 2024-01-02T03:04Z see HTTPS://x.org/a?b.")
    assert [tuple(p) for p in one(spark, signals.text_points(t))] == [(10.5, 20.0)]
    assert one(spark, signals.routes(t))[:2] == ["State Route 7", "I-95"] and one(spark, signals.dates(t)) == ["2024-01-02T03:04Z"]
    long = F.lit("near Route 10000, State Route-123456, Highway 98765; I-95 and Route x")
    assert one(spark, signals.routes(long)) == ["Route 10000", "State Route-123456", "Highway 98765", "I-95"]
    assert one(spark, signals.web_addresses(t)) == ["HTTPS://x.org/a?b."]
    stamp = lambda *a: one(spark, signals.compact_timestamp(*[F.lit(x).cast("string") for x in a]))
    assert stamp("20240102", "0304", None) == "2024-01-02T03:04:00" and stamp("2024", "1", "Z") == "2024T1" and stamp("20240102", "030405", "+0100") == "2024-01-02T03:04:05+01:00"
    when = lambda v: str(one(spark, signals.document_time(F.lit(v)).cast("string")))
    assert when("Tue, 02 Jan 2024 03:04:05 GMT") == when("2024-01-02T03:04:05Z") == "2024-01-02 03:04:05" and when("2024-01-02 odd") == "2024-01-02 00:00:00" and when("x") == "None"
    labels = lambda *xs: F.array(*[F.lit(x) for x in xs])
    assert one(spark, signals.label_overlap(labels("houston", "x"), labels("houston port"), 100.0, 60.0)) == 60.0
    df = spark.createDataFrame([('{"a": [{"id": 5}], "id": {"id": " z "}}',), ("bad",), (None,)], "p string")
    assert [r.v for r in df.select(signals.nested_value(F.col("p"), "id").alias("v")).collect()] == ["5", None, None]
    same = spark.createDataFrame([('{"b": [1, "x", 2], "a": null}',), ('{"a": null, "b": ["y", 3]}',), ("bad",)], "p string")
    marks = [r.v for r in same.select(signals.json_fingerprint(F.col("p")).alias("v")).collect()]
    assert marks[0] == marks[1] is not None and marks[2] is None


def test_lifecycle(spark):
    c = spark.createDataFrame([(1, "suppressed", None), (2, "candidate", None), (3, "candidate", "2024-02-01"), (4, None, "2023-01-01")], "candidate_id long, status string, n string").withColumn("next_revisit_at", F.to_timestamp("n"))
    now = F.lit("2024-01-01").cast("timestamp")
    assert {r.candidate_id for r in lifecycle.revisit_plan(c, now).collect()} == {2, 4} and lifecycle.revisit_plan(c, now, force=True).count() == 3
    a = spark.createDataFrame([(1, '{"watch_id": 5}'), (2, '{"watch_id": 6}'), (3, "bad"), (4, None)], "alert_id long, trigger_basis_json string")
    assert [r.alert_id for r in lifecycle.watch_alerts(a, 5).collect()] == [1]
    h = spark.createDataFrame([(True, "healthy"), (True, "changed"), (False, None)], "reachable boolean, result string")
    assert tuple(lifecycle.scan_totals(h).first()) == (3, 2, 1, 1)
    p = spark.createDataFrame([("public_dataset", True), ("established_news", False)], "source_kind string, enabled boolean")
    assert {r.source_kind for r in lifecycle.kind_gaps(p, ["public_dataset", "established_news", "official_public_record"]).collect()} == {"established_news", "official_public_record"}


def test_planning_rules(spark):
    p = spark.createDataFrame([(1, "official_public_record", True, "free", True, ["en"], ["search", "dataset"]), (2, "news", True, "disabled", True, ["en"], ["dataset"])], "provider_id long, source_kind string, enabled boolean, cost string, robots_supported boolean, languages array<string>, capabilities array<string>")
    got = {r.provider_id: (r.reason, r.task_id, r.priority) for r in planning.fleet_plan(p, "q", (" EN ", "de")).collect()}
    assert got == {1: ("planned", "fleet-" + hashlib.sha256(b"1\0dataset\0q\0en").hexdigest()[:20], 1100), 2: ("provider_disabled", None, None)}
    policy = lambda url, kind="news", public=True: one(spark, planning.source_policy(F.lit(url).cast("string"), F.lit(kind), F.lit(public).cast("boolean"), F.lit(False), F.lit(False), F.lit(False), F.lit(True)))
    assert policy("https://a.org/x") is None and "credential-free" in policy("https://u:p@a.org/x") and "credential-free" in policy(None)
    assert "private" in policy("http://192.168.1.4:80/") and "private" in policy("http://x.local") and "type" in policy("https://a.org", "blog") and "legally" in policy("https://a.org", public=None)
    under = lambda u, o: one(spark, planning.under_origin(F.lit(u), F.lit(o)))
    assert under("https://X.org/a/b", "https://x.org/a/") and not under("https://x.org/ab", "https://x.org/a") and under("https://x.org/z", "https://x.org") and not under("http://x.org/a", "https://x.org/a")


def test_geo_relevance(spark):
    words = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    none, at = F.array().cast("array<struct<lat:double,lon:double>>"), F.array(F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")))
    score = lambda points, kind, target, places=(), roads=(): one(spark, signals.geo_relevance(points, words(*places), words(), words(*roads), F.lit(kind), target))
    assert [score(at, "point", None), score(none, "x", None, ["A"]), score(none, "global", None), score(none, "x", None)] == [65.0, 45.0, 30.0, 20.0]
    area = {"polygon": [(0, 0), (4, 0), (4, 4), (0, 4)], "places": ["Port Alpha"], "routes": ["I-95"]}
    assert [score(at, "point", area), score(none, "x", area, ["port  ALPHA"], ["i 95"]), score(none, "x", area, ["alpha"])] == [100.0, 99.0, 72.0]
    assert [score(none, "nationwide", area), score(none, "global", area), score(none, "x", area, ["zz"]), score(none, "x", area)] == [45.0, 30.0, 8.0, 0.0]
    assert score(at, "point", {"points": [(2, 1)]}) == 95.0
    kind = lambda points, places, text: one(spark, signals.footprint(points, words(*places), words(), words(), F.lit(text)))
    assert [kind(at, [], ""), kind(none, [], "Nationwide"), kind(none, ["a"], ""), kind(none, [], "")] == ["point", "nationwide", "local_area", "unknown"]


def test_registered_canonical_form_is_the_whole_one(spark, tmp_path):
    from evifuse.plans import registry

    given = {
        "http://a.org/x/../y": "http://a.org/y", "http://a.org/x/./y": "http://a.org/x/y", "http://a.org/%7eb": "http://a.org/~b", "http://a.org./p": "http://a.org/p",
        "http://a.org?b": "http://a.org/?b=", "http://a.org/?q=a b": "http://a.org/?q=a%20b", "http://a.org/?b=1&A=2": "http://a.org/?A=2&b=1", "a.org": "https://a.org/",
        "wss://a.org:443/s": "wss://a.org/s", "HTTP://A.org:80//x": "http://a.org/x", "http://a.org/plain/p": "http://a.org/plain/p",
    }
    spark.createDataFrame([(i, u, "") for i, u in enumerate(given)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.canonical_url for r in registry.queries()["canonical_urls"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(given))] == list(given.values())


def test_nested_value_of_any_depth(spark):
    from evifuse.functions import signals

    deep = lambda n, inner: '{"a":[' * n + inner + "]}" * n
    rows = [(0, deep(100_000, '{"k": "v, \\"]}"}')), (1, deep(900, '{"k": 7}')), (2, deep(100_000, "1")[:-1]), (3, '{"x": {"k": 1}, "k": " "}'), (4, None), (5, "]")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.v for r in df.select("i", signals.nested_value(F.col("t"), "k").alias("v")).collect()}
    assert got == {0: 'v, "]}', 1: "7", 2: None, 3: "1", 4: None, 5: None}
