"""The pipeline's stages one by one against brute force, and the whole on the smallest tables."""

import os
from collections import Counter

import brute
import corpus_pipeline
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_columns_with_the_stages_own_names_stay(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 5 = 0")
    named = docs.selectExpr("doc_id", "'a' AS Score", "text", "lang", "source", "n_chars", "doc_id AS shard", "'c' AS slot")
    out = stage[1](spark, named, FOLDER)
    assert out.columns == named.columns and out.schema["Score"].dataType == named.schema["Score"].dataType
    rows = out.collect()
    assert rows and all((r.Score, r.shard, r.slot) == ("a", r.doc_id, "c") for r in rows)


def test_filters_take_the_right_rows(spark, steps):
    rows = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in steps[:4]]
    assert set(rows[1]) <= set(rows[0])
    groups = {}
    for (key, _), (_, _, component) in zip(rows[1], brute.jaccard_components(rows[1]), strict=True):
        groups.setdefault(component, []).append(key)
    assert {k for k, _ in rows[2]} == {min(g) for g in groups.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {k for k, _ in rows[3]} == {w[0] for w in brute.contamination(rows[2], items) if not w[2]}


def test_mix_and_shards(steps):
    words = lambda s: sum(len(brute.words(r.text)) for r in s.collect())
    assert words(steps[4]) == pytest.approx(1.5 * words(steps[3]), abs=20)
    whole = {r.doc_id: " ".join(brute.words(r.text)) for r in steps[3].collect()}
    assert all(" ".join(brute.words(r.text)) in whole[r.doc_id] for r in steps[4].collect())
    last = steps[5].collect()
    assert Counter((r.doc_id, r.text) for r in last) == Counter((r.doc_id, r.text) for r in steps[4].collect())
    for shard in range(8):
        assert sorted(r.slot for r in last if r.shard == shard) == list(range(sum(r.shard == shard for r in last)))


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, steps[-1].collect()))


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_queries_run(spark, name):
    out = entry.queries()[name](spark, FOLDER)
    assert out.count() > 0 and len(set(out.columns)) == len(out.columns)
