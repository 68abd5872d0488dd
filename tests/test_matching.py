"""Both matching signals against plain versions: full lexical scans, exact neighbours, fusion by text, sizes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewell.operators import matching, semantic, verifier
from pricewell.plans import matching as plans
from pricewell.plans.frames import UNITS

SF = "/root/testdata/sf0.001"


def plain_search(texts, variants, limit):
    out = set()
    for t in {t for t in texts if t}:
        best: dict = {}
        for item, v in variants:
            key = (-matching.token_set_score(t, v), v)
            best[item] = min(best.get(item, (1, "")), key)
        out |= {(t, item, round(-s, 9), v) for s, item, v in sorted((s, item, v) for item, (s, v) in best.items())[:limit] if s < 0}
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_lexical_search_equals_a_full_scan(spark, monkeypatch, block):
    """Also for texts of one or two letters, and with variants in several blocks."""
    monkeypatch.setattr(matching, "BLOCK", block)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdeort") for _ in range(rng.randrange(1, 7)))
    variants = [(rng.randrange(30), " ".join(word() for _ in range(rng.randrange(1, 4)))) for _ in range(80)] + [(31, "tea"), (32, "ab"), (33, "rice")]
    texts = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["te", "ax", "rce", "", "z", "tea tea"]
    got = matching.lexical_search(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), spark.createDataFrame(variants, "item long, variant string"), 4)
    assert {(r["text"], r["item"], round(r["score"], 9), r["variant"]) for r in got.collect()} == plain_search(texts, variants, 4)


def test_search_of_nothing(spark):
    texts, none = spark.createDataFrame([("rice",)], "text string"), spark.createDataFrame([], "item long, variant string")
    assert matching.lexical_search(texts, none).count() == 0 and semantic.search(texts, none, 3).count() == 0
    assert semantic.search(texts.where("false"), spark.createDataFrame([(1, "rice")], "item long, variant string"), 3).count() == 0


def test_fuse_by_text(spark):
    """A text without semantic rows keeps its lexical score; an item without one counts 0."""
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 1, 1.0), ("y", 2, 0.5)], "text string, item long, score double")
    b = spark.createDataFrame([("y", 1, 0.5), ("y", 3, 1.0)], "text string, item long, score double")
    got = {(r["text"], r["item"]): round(r["fused"], 6) for r in matching.fuse(a, b, ["text", "item"], query=["text"]).collect()}
    assert got == {("x", 1): 1.0, ("y", 1): 0.7, ("y", 2): 0.2, ("y", 3): 0.6}
    one = a.where("text = 'x'").select("item", "score")
    assert [r["fused"] for r in matching.fuse(one, b.where("false").select("item", "score"), ["item"]).collect()] == [1.0]


def test_a_close_second_goes_to_review(spark):
    rows = [("a", 1, 0.90, 0.95), ("a", 2, 0.86, 0.95), ("b", 1, 0.95, 0.9), ("b", 2, 0.80, 0.8), ("c", 1, 0.6, 0.6), ("d", 1, 0.3, 0.4)]
    got = {r["t"]: r["action"] for r in matching.decide(spark.createDataFrame(rows, "t string, item long, fused double, confidence double"), "t").collect()}
    assert got == {"a": "review", "b": "auto_resolve", "c": "review", "d": "reject"}


def test_sizes_move_the_scores(spark):
    variants = spark.createDataFrame([(1, "flour sack"), (2, "flour bag")], "item long, variant string")
    packs = spark.createDataFrame([(1, 50_000.0, "g"), (2, 1_000.0, "g")], "item long, quantity double, unit string")
    texts = spark.createDataFrame([("flour 50kg",)], "text string")
    got = {r["item"]: (round(r["fused"], 6), r["rank"]) for r in matching.candidates(texts, variants, 5, None, packs, UNITS).collect()}
    plain = {r["item"]: r["fused"] for r in matching.candidates(texts, variants, 5).collect()}
    assert got[1] == (round(plain[1] + 0.05, 6), 1) and got[2] == (round(plain[2] - 0.12, 6), 2)


def test_aliases_are_normalised(spark):
    units = [("kg", "g", 1000.0, ["كِيلُو", "KILO"]), ("l", "ml", 1000.0, ["c.l+"])]
    df = spark.createDataFrame([("أرز 5 كيلو",), ("rice 2 kilo",), ("milk 3l",)], "t string").select(matching.parse_sizes(F.col("t"), units).alias("s"))
    assert [[(s["quantity"], s["unit"]) for s in r["s"]] for r in df.collect()] == [[(5000.0, "g")], [(2000.0, "g")], [(3000.0, "ml")]]


def test_vectors_of_texts(spark):
    rows = spark.createDataFrame([("White  RICE",), ("white rice",), ("rice white",), ("",), (None,), ("زيت",)], "text string")
    got = [(r["text"], np.array(r["vector"])) for r in semantic.embed(rows).collect()]
    by = {t: v for t, v in got}
    assert np.allclose(by["White  RICE"], by["white rice"]) and np.allclose(by["white rice"], by["rice white"], atol=1e-6)
    assert not by[""].any() and not by[None].any() and np.linalg.norm(by["زيت"]) == pytest.approx(1.0, abs=1e-5)
    assert float(by["white rice"] @ semantic.vector_of("white rce")) > 0.5 > float(by["white rice"] @ semantic.vector_of("olive oil"))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (12, 16))
    data = centres[np.minimum(rng.integers(0, 18, 2000), 11)] + rng.normal(0, 0.6, (2000, 16))  # one cluster holds a third
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(5000, None), (5001, [0.0] * 16), (None, [1.0] * 16)]
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)


def test_index_finds_the_neighbours(spark, vectors, monkeypatch):
    monkeypatch.setattr(semantic, "BLOCK", 100)
    queries = vectors.where("id % 50 = 0 and id < 5000")
    exact = {(r["query_id"], r["id"]): r["score"] for r in matching.vector_knn(queries, vectors, 10).collect()}
    found = {(r["query_id"], r["id"]): r["score"] for r in semantic.nearest(queries, vectors, 10).collect()}
    assert len(found) == len(exact) == 400 and len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(found[k] == pytest.approx(exact[k], abs=1e-5) for k in exact.keys() & found.keys())
    centres, probes = semantic.fit_cells(vectors)
    assert probes < len(centres) / 2
    every = {(r["query_id"], r["id"]) for r in semantic.nearest(queries, vectors, 10, (centres, len(centres))).collect()}
    assert len(every & exact.keys()) >= 0.995 * len(exact)  # all cells: exact but for ties at single precision
    assert semantic.nearest(queries, vectors.where("false"), 3).count() == 0


def test_sampled_centres_index_every_row(spark, vectors):
    centres, _ = semantic.fit_cells(vectors, sample=300, cells=9)
    assert len(centres) == 9
    got = semantic.nearest(vectors.where("id < 2000"), vectors, 1, (centres, 9))
    assert got.select("query_id").distinct().count() == 2000


def test_index_recall_on_the_given_vectors(spark):
    (row,) = plans.recall(spark, "/root/testdata/sf0.01").collect()
    assert row["recall"] >= 0.9


def test_match_metrics(spark):
    got = {r["slip"]: r for r in plans.metrics(spark, SF).collect()}
    assert set(got) == {*plans.SLIPS, "all"} and got["exact"]["top1"] == got["shouted"]["auto_precision"] == 1.0
    assert got["letter_lost"]["top3"] >= 0.9 and got["all"]["top1"] <= got["all"]["top3"] <= got["all"]["top5"] and got["all"]["auto_precision"] >= 0.9
    assert got["all"]["n"] == sum(got[s]["n"] for s in plans.SLIPS)


def test_match_many_by_both_signals(spark):
    variants = spark.createDataFrame([(1, "white rice"), (2, "sunflower oil"), (3, "olive oil")], "item long, variant string")
    texts = spark.createDataFrame([("WHITE RICE",), ("sunflwr oil",), ("te",), ("",), (None,)], "text string")
    got = {r["text"]: (r["item"], r["action"]) for r in matching.match_many(texts, variants, search=semantic.search).collect()}
    assert got["WHITE RICE"] == (1, "auto_resolve") and got["sunflwr oil"][0] == 2 and got["te"][1] == "reject" and got[""] == got[None] == (None, "reject")


def test_verifier_features_by_hand(spark):
    variants = spark.createDataFrame([(1, "white rice 5 kg"), (1, "basmati"), (2, "olive oil")], "item long, variant string")
    found = spark.createDataFrame([("rice 25 kg sack", 1, 0.8, 0.5, 0.7, 1), ("rice 25 kg sack", 2, 0.1, 0.1, 0.2, 2), ("oil", 2, 1.0, 0.0, 1.0, 1)], "text string, item long, lexical double, semantic double, fused double, rank int")
    got = {r["text"]: [round(r[c], 6) for c in verifier.FEATURES] for r in verifier.features(found, variants).collect()}
    assert got["rice 25 kg sack"] == [0.8, 0.5, 0.7, 0.5, 0.5, 0.5, 2.0, 0.0, 1.0, 1.0, 0.5, 0.5]
    assert got["oil"] == [1.0, 0.0, 1.0, 1.0, 1.0, 0.5, 0.0, 1.0, 0.0, round(3 / 9, 6), 0.0, 0.0]


def test_verifier_is_judged_out_of_fold(spark):
    rng = np.random.default_rng(9)
    rows = [(f"t{i}", 1, *(float(x) for x in rng.normal(2.0 * (i % 2), 1, 12)), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "text string, item long, " + ", ".join(f"{c} double" for c in verifier.FEATURES) + ", correct int")
    scored = verifier.cross_validated(df)
    (row,) = verifier.judged(scored).collect()
    assert row["n"] == 600 and row["auc"] > 0.97 and row["recall"] >= 0.95 and row["prec"] > 0.9
    pure = rng.permutation(np.repeat([0, 1], 300)).tolist()
    noise = [(*r[:2], *(float(x) for x in rng.normal(0, 1, 12)), y) for r, y in zip(rows, pure, strict=True)]
    (row,) = verifier.judged(verifier.cross_validated(spark.createDataFrame(noise, df.schema))).collect()
    assert abs(row["auc"] - 0.5) < 0.1  # nothing learned in one fold shows in another
    assert verifier.judged(scored.where("correct = 1")).count() == 0


def test_verifier_query(spark):
    (row,) = plans.verified(spark, SF).collect()
    assert row["auc"] > 0.8 and row["recall"] >= 0.95 and 0 < row["kept"] < 1
