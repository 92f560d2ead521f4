"""Every corpus query and pipeline stage on nulls in any column, empty and very long texts, repeated rows, clashing names and empty tables."""

from __future__ import annotations

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evifuse.llm import queries, vectors
from tests.llm.test_ops import corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the tables.
CLASH = "row string, t int, base string, spans string, found int, fp long, m int, n int, key string, matches string, component_id long, p double, s string, asked int, data binary, bucket int, held_out int, toxic string, score double"
VALUES = ("r", 1, "b", "s", 2, 3, 4, 5, "k", "m", 6, 0.5, "s", 7, b"d", 8, 9, "x", 0.25)
TABLES = {
    "documents": f"{DOCS}, {CLASH}",
    "labels": "doc_id long, quality int, toxic int, text string, n int",
    "benchmark": "item_id long, text string, m int, key string",
    "pages": "page_id long, url string, html string, host string, path string, n int, run string, w string, c long, z long",
    "embeddings": "vec_id long, embedding array<double>, label int, rep long, v string, leaf int, n int, links int",
}


def awkward():
    docs = [(i, t, lang, s, n) for i, t, lang, s, n, _, _ in corpus()]
    docs += [(500, None, None, None, None), (None, "the er on ti without an id, a@b.org", "en", "s", 1), (None, None, None, None, None)] * 2
    docs += [(501, "the er on an item of the test set to be found here and there " + "word " * 400_000, "en", "s", 9), (502, docs[5][1], None, "s", None)]
    docs += docs[5:8] + [(503, "One Text", "en", "a", 1), (503, "Another text", "en", "a", 1)]
    docs = [(*d, *VALUES) for d in docs] + [(504, "nulls beside", None, None, None, *[None] * len(VALUES))]
    labels = [(d[0], 1, i % 2, "clash", 1) for i, d in enumerate(docs)] + [(None, None, None, None, None), (0, None, 1, None, 1)]
    bench = [(1, "an item of the test set to be found here and there", 1, "k"), (1, "an item of the test set to be found here and there", 1, "k"), (None, "no id", 1, None), (2, None, None, None), (3, "", 1, "k")]
    r = np.random.RandomState(2)
    vecs = [(i, [float(x) for x in v], i % 2, 1, "v", 2, 3, 4) for i, v in enumerate(r.normal(size=(40, 6)))]
    vecs += vecs[:3] + [(60, vecs[0][1], 0, None, None, None, None, None), (61, None, 0, 1, "v", 1, 1, 1), (62, [], 0, 1, "v", 1, 1, 1), (63, [1.0] * 9, 0, 1, "v", 1, 1, 1), (None, vecs[1][1], 1, 1, "v", 1, 1, 1), (64, vecs[1][1], None, 1, "v", 1, 1, 1)]
    pages = [(i, u, "h", "clash", "clash", 1, "x", "y", 2, 3) for i, u in enumerate([None, "", "no scheme", "http://cheap-pills.info/free", "http://" + "cheappills" * 5_000 + ".org/" + "x" * 50_000, "http://cheap-pills.info/free"])]
    return {"documents": docs, "labels": labels, "benchmark": bench, "pages": [*pages, (None, "http://a.com/en/", *[None] * 8), pages[3]], "embeddings": vecs}


def write(spark, folder, tables):
    for name, schema in TABLES.items():
        spark.createDataFrame(tables.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables():
    return awkward()


@pytest.fixture(scope="module")
def full(spark, tables, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("full"), tables)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), {})


ALL = queries.QUERIES | {"pipeline": corpus_pipeline.run}
NUMBER = {f.split("_")[0]: f for f in ALL}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, none, full, name):
    assert ALL[name](spark, none).collect() == []


@pytest.mark.parametrize("name", sorted(set(ALL) - {"pipeline", *(NUMBER[k] for k in ("op2", "op10", "op11", "op12"))}))
def test_one_row_per_row_and_equal_rows_alike(spark, full, tables, name):
    source = {"op6": "pages", "op8": "embeddings"}.get(name.split("_")[0], "documents")
    got = [tuple(r) for r in ALL[name](spark, full).collect()]
    assert sorted((r[0] for r in got), key=str) == sorted((r[0] for r in tables[source]), key=str)
    if name.split("_")[0] != "op4":  # of repeated rows the op4 result is that of the document, see its tests
        rows = {}
        for r in tables[source]:
            rows.setdefault(r[0], set()).add(str(r[1]))
        by_id = {}
        for r in got:
            by_id.setdefault(r[0], set()).add(r)
        assert all(len(by_id[i]) <= len(texts) for i, texts in rows.items())


def test_defined_results(spark, full):
    get = lambda n: {r.doc_id: r for r in ALL[NUMBER[n]](spark, full).filter("doc_id in (500, 501, 502, 503)").collect()}
    assert get("op9")[500].lang_pred == "und" and get("op5")[500].spans == "" == get("op7")[500].spans
    assert get("op3")[500].fingerprint == "0" * 16
    assert get("op10").keys() == {501} and [r.item_id for r in ALL[NUMBER["op10"]](spark, full).collect()] == [1, 1]
    packed = ALL[NUMBER["op2"]](spark, full)
    assert packed.filter("doc_id = 500").agg(F.sum("length")).first()[0] == 2 and packed.filter("doc_id = 501").agg(F.sum("length")).first()[0] > 400_000
    links = {r.vec_id: r for r in vectors.op8_embedding_dedup(spark, full).collect()}
    assert links[60].n_links == 2 and links[60].component_id == 0 and links[64].n_links == links[61].n_links == links[62].n_links == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_all_columns(spark, full, none, stage):
    docs = spark.read.parquet(f"{full}/documents.parquet")
    out = stage(spark, docs, full)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    before, after = docs.collect(), out.collect()
    same = lambda r: tuple(v for c, v in r.asDict().items() if c not in ("text", "n_chars"))
    assert 0 < len(after) <= len(before) and {same(r) for r in after} <= {same(r) for r in before}
    if "lang" not in stage.__module__:
        # other columns play no part: with nothing but id and text it decides alike
        bare = stage(spark, docs.select("doc_id", "text"), full)
        assert sorted(((r.doc_id, r.text) for r in bare.collect()), key=str) == sorted(((r.doc_id, r.text) for r in after), key=str)
    assert stage(spark, spark.read.parquet(f"{none}/documents.parquet"), none).collect() == []


def test_pipeline_whole(spark, full):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    old = set(glob.glob(f"{folder}/corpus-pipeline-*/*"))
    got = corpus_pipeline.run(spark, full)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert None in ids and 503 in ids and not ids & {500, 501, 502}
    assert len(set(glob.glob(f"{folder}/corpus-pipeline-*/*")) - old) == 1
