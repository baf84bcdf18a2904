"""The pipeline's stages against plain versions of what they keep."""

import corpus_pipeline
from factloom.llm import neardup, quality, toxicity
from factloom.llm.common import table

from .test_neardup import brute


def test_stages_take_effect(spark, small):
    docs = table(spark, small, "documents")
    labels = table(spark, small, "labels")
    first = corpus_pipeline.quality_stage(spark, docs, small)
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == good

    second = corpus_pipeline.toxicity_stage(spark, first, small)
    clean = {r.doc_id for r in toxicity.score(first, labels).where("predicted = 0").collect()}
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == clean

    third = corpus_pipeline.neardup_stage(spark, second, small)
    kept = {i for i, _, _, k in brute([(r.doc_id, r.text) for r in second.select("doc_id", "text").collect()]) if k}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == kept

    pieces = corpus_pipeline.packing_stage(spark, third, small)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept


def test_the_whole_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_messy_documents(spark, messy, nothing, small):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).count()
        assert stage(spark, nothing.select(docs.columns), small).count() == 0
    assert neardup.keep_one(docs).columns == docs.columns
