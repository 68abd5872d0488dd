"""The sets that operator 5 compares go through no shuffle unless a doc_id repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm import jaccard

LONG = " ".join(f"w{i}" for i in range(60))
NEAR = LONG.replace("w30 ", "x ")
ROWS = [(1, LONG), (2, NEAR), (3, "other words " + " ".join(f"v{i}" for i in range(40)))]


def components(df: DataFrame) -> list[tuple]:
    return sorted((r["doc_id"], r["component_id"]) for r in jaccard.join(df, 4, 80).collect())


def test_sets_are_not_shuffled(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(DataFrame, "dropDuplicates", lambda self, *a, f=type(spark.range(1)).dropDuplicates: asked.append(a) or f(self, *a))
    monkeypatch.setattr(type(spark.range(1)), "dropDuplicates", DataFrame.dropDuplicates)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert components(docs) == [(1, 1), (2, 1), (3, 3)] and not asked
    assert components(docs.unionByName(docs).unionByName(docs.where("doc_id = 1"))) == [(1, 1)] * 3 + [(2, 1)] * 2 + [(3, 3)] * 2 and asked


def test_each_pair_once(spark):
    docs = spark.createDataFrame(ROWS + ROWS, "doc_id long, text string").repartition(4)
    run = jaccard.Join(docs, 4, 80)
    keys = sorted(r["key"] for r in run.classes.where("doc_id < 3").collect())
    pairs = spark.createDataFrame([tuple(keys)], "a long, b long")
    assert [tuple(r) for r in run.verified(pairs).collect()] == [tuple(keys)]
    assert run.sets(run.classes.select(F.col("key"))).count() == 3
