"""The pipeline: what stages keep, and that each stage's decisions take effect."""

import re

import pytest

import corpus_pipeline
from scorewatch.llm import language_id, ngram_join, quality_divergence

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], FOLDER).cache())
    return out


def test_columns(steps):
    assert [s.columns for s in steps[:-1]] == [steps[0].columns] * 5
    assert "sequence_id" in steps[-1].columns


def test_filters(spark, steps):
    ids = [sorted(r["doc_id"] for r in s.select("doc_id").collect()) for s in steps[:-1]]
    judged = quality_divergence.judge(steps[0], quality_divergence.learn_references(steps[0]))
    assert ids[1] == sorted(r["doc_id"] for r in judged.filter("kept").collect())
    known = language_id.identify(steps[1], language_id.learn(steps[1]))
    assert ids[2] == sorted(r["doc_id"] for r in known.filter("not rejected").collect())
    joined = ngram_join.jaccard_join(steps[2])
    assert ids[3] == sorted(r["doc_id"] for r in joined.filter("doc_id = component_id").collect())
    assert ids[4] == ids[3]


def test_no_passage_is_left_twice(steps):
    before = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    after = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for d in sorted(before):
        w = words(before[d])
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i:i + 50]), d)
    for d, text in before.items():
        w, gone = words(text), set()
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < d:
                gone |= set(range(i, i + 50))
        assert words(after[d]) == [x for i, x in enumerate(w) if i not in gone]


def test_every_document_is_packed(steps):
    packed = {r["doc_id"] for r in steps[5].collect()}
    assert packed == {r["doc_id"] for r in steps[4].collect()}


def test_run(spark, steps):
    assert sorted(corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(
        steps[5].select("doc_id", "piece", "length", "ids_crc32").collect())
