"""Scores of operator 9 against a plain model of all pairs, those that occur once included."""

from __future__ import annotations

import collections
import math

import pytest
from pyspark.sql import functions as F

from pricewell.llm import lm

# Pairs that occur once in training rows (ids below 10), of known and unknown words in the others, words that occur once, equal and empty texts.
TEXTS = {0: "a b c d a b", 1: "b d e f", 2: "a c", 3: None, 4: "a b a b g", 10: "b d e f", 11: "d c a x a b", 12: "", 13: "f e d g g"}


@pytest.mark.parametrize("bits", [1 << 29, 0])
def test_pairs_that_occur_once_count(spark, monkeypatch, bits):
    monkeypatch.setattr(lm, "MOST_BITS", bits)
    grams = {i: [*zip(["<s>", *(words := (t or "").split())], [*words, "</s>"], strict=True)] for i, t in TEXTS.items()}
    pairs = collections.Counter(g for i, own in grams.items() if i < 10 for g in own)
    singles = collections.Counter()
    for (_, word), k in pairs.items():
        singles[word] += k
    texts = sum(i < 10 for i in TEXTS)
    scale = singles.total() + 0.5 * (len(singles) + 1)
    level = lambda n: lm.COUNTS[math.floor(math.log(n) / math.log(lm.RATIO) + 1e-9) + 1] if n else 0.0

    def p(before: str, word: str) -> float:
        ratio = min(level(pairs[before, word]) / max(texts if before == "<s>" else level(singles[before]), 1.0), 1.0)
        return math.log10((1 - lm.PAIR_WEIGHT) * (level(singles[word]) + 0.5) / scale + lm.PAIR_WEIGHT * ratio)

    docs = spark.createDataFrame([*TEXTS.items()], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["score"] for r in lm.score(docs, F.col("doc_id") < 10).collect()}
    assert out == pytest.approx({i: sum(p(*g) for g in own) for i, own in grams.items()}, rel=1e-9)
