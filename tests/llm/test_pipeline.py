"""The corpus pipeline end to end: columns, and what each stage may drop."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricewell.llm.quality import quality
from pricewell.llm.queries import PIECE_BPE


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, sf)
    assert first.columns == docs.columns
    kept = {r["doc_id"] for r in quality(docs, PIECE_BPE).where("kept").collect()}
    assert {r["doc_id"] for r in first.select("doc_id").collect()} == kept
    out = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert ids and ids <= kept
    fills = out.groupBy("sequence_id").agg({"length": "sum", "sequence_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(sequence_tokens)"] for r in fills)


GOOD = "When the rain had passed over the northern hills, {0} walked down to the old harbour and watched how the fishing boats came back with what they had caught during the night. Nobody spoke much, because the wind was still cold and the work was not done. Later {0} bought bread, two pears and a newspaper, and read about the election until the tea went cold beside the window of the quiet kitchen."


@pytest.fixture(scope="module")
def rows(spark):
    """Nulls, empty texts, repeated rows and ids, a copy, extra columns with names that the stages use."""
    texts = [(1, GOOD.format("Anna")), (2, GOOD.format("Anna")), (3, None), (4, ""), (5, "few words"), (None, GOOD.format("Boris")), (7, GOOD.format("Clara") + " one"), (7, GOOD.format("Clara") + " one"), (7, GOOD.format("Clara"))]
    extra = [(i, t, "en", "s", 0 if t is None else len(t), "x", 1, "y") for i, t in texts]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars int, spans string, component_id int, count string").repartition(2)


def test_stage_rows(spark, rows):
    sf = "/root/testdata/sf0.001"
    first = corpus_pipeline.quality_rules(spark, rows, sf)
    assert first.columns == rows.columns and sorted(r["doc_id"] for r in first.collect()) == [1, 2, 7, 7, 7]
    second = corpus_pipeline.near_duplicates(spark, rows.where("doc_id is not null"), sf)
    kept = {r["doc_id"]: r["text"] for r in second.collect()}
    assert second.columns == rows.columns and second.count() == len(kept) and set(kept) == {1, 3, 4, 5, 7} and kept[7] == GOOD.format("Clara")
    unique = rows.where("doc_id in (1, 2, 3, 4, 5)")
    third = corpus_pipeline.repeated_passages(spark, unique, sf)
    assert third.columns == rows.columns and sorted(r["doc_id"] for r in third.collect()) == [1, 3, 4, 5]
    assert third.where("text is not null and n_chars != length(text)").count() == 0
    fourth = corpus_pipeline.benchmark_leaks(spark, unique, sf)
    assert fourth.columns == rows.columns and fourth.count() == 5
    fifth = corpus_pipeline.packing(spark, unique, sf)
    assert {r["doc_id"]: r["n"] for r in fifth.groupBy("doc_id").agg(F.sum("length").alias("n")).collect() if r["doc_id"] in (3, 4)} == {3: 1, 4: 1}


def test_stages_of_nothing(spark, rows):
    docs = rows.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0
