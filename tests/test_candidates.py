"""Candidate merge: order of campaigns, sticky states, collisions, replayed and broken batches, reading back."""

from __future__ import annotations

import datetime
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evifuse.functions import urls
from evifuse.operators import candidates, links

SCHEMA = "url_hash string, canonical_url string, campaign_id long, run_id long, observed_at timestamp, score double, trust_level string, content_hash string, schema_hash string"


def seen(key, campaign, run, score, content="c", trust=None, url=None):
    at = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=run)
    return (key, url or f"https://h/{key}", campaign, run, at, score, trust, content, "s")


def plain(rows):
    """(score, owner, revisions) by key, one observation after the other."""
    state = {}
    for key, _, campaign, _, _, score, *_ in sorted(rows, key=lambda r: (r[0], r[3])):
        old = state.get(key)
        take = old is None or old[1] == campaign or score >= old[0]
        state[key] = ((score, campaign) if take else old[:2]) + ((old[2] if old else 0) + 1,)
    return state


def test_batches_equal_the_plain_fold(spark, tmp_path):
    r = random.Random(3)
    rows = [seen(f"k{r.randint(0, 20)}" if r.random() < 0.6 else "hot", r.randint(1, 4), run, float(r.randint(0, 100)), r.choice("ab")) for run in range(400)]
    root = str(tmp_path)
    for b, (lo, hi) in enumerate([(0, 150), (150, 151), (151, 400)]):
        assert candidates.apply_batch(spark, root, b, spark.createDataFrame(rows[lo:hi], SCHEMA).repartition(3))
    got = {x.url_hash: (x.score, x.owner_campaign_id, x.revisions) for x in candidates.states(spark, root).collect()}
    assert got == plain(rows)
    log = candidates.revisions(spark, root).collect()
    assert len(log) == 400
    for key in got:
        own = sorted((x.revision_number, x.run_id, x.changed, x.content_hash) for x in log if x.url_hash == key)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1] for x in own] == sorted(x[1] for x in own)
        assert [x[2] for x in own] == [True] + [a[3] != b[3] for a, b in zip(own, own[1:])]
    early = {x.url_hash: x.revisions for x in candidates.states(spark, root, as_of=0).collect()}
    assert early == {k: v[2] for k, v in plain(rows[:150]).items()}


def test_replayed_and_broken_batches(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([seen("a", 1, 1, 80.0), seen("b", 1, 2, 40.0)], SCHEMA)
    assert candidates.apply_batch(spark, root, 1, first)
    assert not candidates.apply_batch(spark, root, 1, first)
    second = spark.createDataFrame([seen("a", 2, 3, 10.0)], SCHEMA)
    assert candidates.apply_batch(spark, root, 2, second)
    # a job that died before its commit leaves files that do not count; the next try replaces them
    os.remove(f"{root}/batch=2/_SUCCESS")
    assert candidates.revisions(spark, root).count() == 2
    assert {x.url_hash: x.revisions for x in candidates.states(spark, root).collect()} == {"a": 1, "b": 1}
    assert candidates.apply_batch(spark, root, 2, second)
    assert candidates.revisions(spark, root).count() == 3
    assert candidates.states(spark, root).filter("url_hash = 'a'").first().score == 80.0
    with pytest.raises(ValueError):
        candidates.apply_batch(spark, root, 0, first)


def test_sticky_states_collisions_and_gaps(spark, tmp_path):
    root = str(tmp_path)
    rows = [seen("a", 1, 1, 90.0), seen("a", 1, 2, 90.0, url="https://other/"), seen("q", 1, 1, 90.0, trust="blocked"), seen("low", 1, 1, 10.0), (None, "x", 1, 1, None, 1.0, None, None, None), seen("none", 1, 1, None)]
    candidates.apply_batch(spark, root, 0, spark.createDataFrame(rows, SCHEMA))
    assert {x.url_hash: x.status for x in candidates.states(spark, root).collect()} == {"a": "candidate", "q": "quarantined", "low": "ignored"}
    assert [(x.url_hash, x.canonical_url) for x in candidates.collisions(spark, root).collect()] == [("a", "https://other/")]
    held = candidates.states(spark, root).withColumn("status", F.lit("suppressed"))
    after = candidates.merge(held, spark.createDataFrame([seen("a", 1, 5, 20.0)], SCHEMA)).filter("kind = 'state'").collect()
    assert [(x.url_hash, x.status, x.score) for x in after] == [("a", "suppressed", 20.0)]
    assert candidates.states(spark, f"{root}/none").collect() == []


LINKS = "parent_id long, position int, parent_url string, url string, relation string, link_source string, link_format string, same_domain boolean, depth int, search_page boolean, parent_type string"


def link(i, url, relation="link", near=True, depth=0, search=False, fmt=None, source=None, parent="page"):
    return (1, i, "https://h.org/p/", url, relation, source, fmt, near, depth, search, parent)


def test_links_get_the_first_reason_that_holds(spark):
    rows = [
        link(0, "/a"), link(1, "/a#x"), link(2, "b.CSV?x=1"), link(3, "/c", depth=2), link(4, ""), link(5, None), link(6, "https://far.org/", near=False), link(7, "https://far.org/s", near=False, search=True),
        link(8, "/map", source="xml_loc", parent="sitemap"), link(9, "/feed", "feed"), link(10, "mailto:x@y.org"), link(11, "/old"), link(12, "/no/x"), link(13, "https://sub.stop.org/", search=True), link(14, "https://late.org/", search=True), link(15, "/d", "stream", fmt="csv"),
    ]
    campaign = links.Campaign(modes=("neighborhood", "format_targeted"), max_depth=2, format_targets=("csv",), denied_paths=("/no/*",))
    frontier = spark.createDataFrame([("https://h.org/old",)], "u string").select(urls.url_hash(F.col("u")).alias("url_hash"))
    stop = spark.createDataFrame([("domain", "stop.org", None), ("domain", "late.org", datetime.datetime(2020, 1, 1))], "scope string, value string, expires_at timestamp")
    run = lambda c, r: links.admit(spark.createDataFrame(r, LINKS), frontier, c, stop, F.lit("2024-01-01").cast("timestamp")).collect()
    got = run(campaign, rows)
    assert {(x.canonical_url, x.method, x.priority, x.depth) for x in got if x.state == "queued"} == {
        ("https://h.org/a", "neighborhood", 50.0, 1), ("https://h.org/p/b.CSV?x=1", "format_targeted", 75.0, 1), ("https://far.org/s", "query_result", 85.0, 1), ("https://late.org/", "query_result", 85.0, 1), ("https://h.org/d", "format_targeted", 75.0, 1)}
    assert {(x.state, x.canonical_url, x.reason, x.links) for x in got if x.state in ("blocked", "known", "repeated")} == {
        ("blocked", "https://h.org/no/x", "path_denied", 1), ("blocked", "https://sub.stop.org/", "active_suppression", 1), ("known", "https://h.org/old", "known", 1), ("repeated", "https://h.org/a", "repeated", 1)}
    skipped = {}
    for x in got:
        if x.state == "skipped":
            skipped[x.reason] = skipped.get(x.reason, 0) + x.links
    assert skipped == {"max_depth": 1, "no_url": 2, "cross_domain": 1, "mode_off": 1, "format_not_targeted": 1, "invalid_url": 1}
    assert sum(x.links for x in got) == len(rows)
    assert [x.reason for x in run(links.Campaign(modes=("query",)), rows[:1])] == ["mode_off"]
    assert run(campaign, []) == []


def test_fold_holds_few_rows_at_a_time():
    row = dict.fromkeys([*candidates._STATE, *candidates._REVISION, "trust_level"]) | {"from_state": False, "canonical_url": "u", "campaign_id": 1, "observed_score": 1.0, "observed_bucket": "ignore"}
    rows = pd.DataFrame([row | {"url_hash": f"h{i // 2:05d}", "run_id": i} for i in range(9_000)], dtype=object)
    frames = list(candidates._fold([rows]))
    assert max(map(len, frames)) <= 2 * candidates.PART + 1
    out = pd.concat(frames)
    assert out.kind.value_counts().to_dict() == {"revision": 9_000, "state": 4_500} and set(out[out.kind == "state"].revisions) == {2}
