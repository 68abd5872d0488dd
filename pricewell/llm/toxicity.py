"""Operator 3: toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding undoes homoglyphs and digit substitutions. The lexicon's words, word
beginnings, weights and exception phrases are learned from labelled rows; a
text's matched weight is normalised by its length, and a logistic curve over
both makes the score. Fitting reads a bounded sample of labelled rows
(SAMPLE_ROWS of each label, by hash of the id); scoring is one pass over all
whole texts without a shuffle, with the lexicon (MAX_TERMS at most) in each task.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 10_000
MAX_TERMS = 100_000
#: A term of the lexicon has so many different neighbourhoods in toxic texts; copies of one text have the same ones.
LEAST_CONTEXTS = 5
#: And is so many times likelier in toxic texts.
LEAST_RATIO = 6.0
STEM = 5
BINS = 48

# Letters of other scripts and digits or signs that stand for Latin letters.
_HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ⅰ": "i", "ⅼ": "l", "ℓ": "l"}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
# Signs that join or hide letters without being any.
_NOTHING = "​‌‍⁠﻿­"


class _Fold(dict):
    """A table for str.translate: fills itself for characters it hasn't met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in _NOTHING:
            out = ""
        else:
            c = c.lower()
            full = chr(code - 0xFEE0).lower() if 0xFF01 <= code <= 0xFF5E else c
            out = _HOMOGLYPHS.get(full) or _DIGITS.get(full) or (full if full.isalpha() else " ")
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words, each between single or more blanks; a closing sign of a sentence is none of a word."""
    plain = (text or "").replace("! ", "  ").replace("!\n", "  ").replace("!!", "  ")
    return f" {plain.rstrip('!').translate(_FOLD)} "


class Model(NamedTuple):
    terms: dict[str, float]  # " word " or " begin" -> weight
    exceptions: frozenset[str]  # "word word"
    curve: tuple[float, float, float]


class Matcher:
    def __init__(self, terms: dict[str, float], exceptions: frozenset[str]) -> None:
        import ahocorasick

        self.exceptions, self.automaton = exceptions, ahocorasick.Automaton()
        for term, weight in terms.items():
            self.automaton.add_word(term, (len(term), weight))
        self.empty = not terms
        if terms:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Weight by the place of the blank before each matched word; words of exception phrases are left out."""
        found: dict[int, float] = {}
        if self.empty:
            return found
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight > found.get(start, 0.0):
                found[start] = weight
        if found and self.exceptions:
            found = {s: w for s, w in found.items() if self.exceptions.isdisjoint(phrases(folded, s))}
        return found

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        weight = sum(self.hits(folded).values())
        if not weight:
            return 0.0, 0.0
        return math.log1p(weight), math.log1p(1000.0 * weight / (folded.count(" ") + 20))


def phrases(folded: str, start: int) -> list[str]:
    """The word that begins after start with the word before it, and with the word after it."""
    end = folded.index(" ", start + 1)
    word, before, after = folded[start + 1 : end], folded[max(0, start - 80) : start].split(), folded[end : end + 80].split()
    return ([f"{before[-1]} {word}"] if before else []) + ([f"{word} {after[0]}"] if after else [])


def _terms(word: str) -> tuple[str, ...]:
    return (f" {word} ", f" {word[:STEM]}") if len(word) >= STEM else (f" {word} ",) if len(word) > 2 else ()


def _toxic_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, context: what stands around a term, once a batch."""
    for batch in batches:
        seen = set()
        for text in batch.column(1).to_pylist():
            words = ["", *fold(text).split(), ""]
            for i in range(1, len(words) - 1):
                for term in _terms(words[i]):
                    seen.add((term, f"{words[i - 1]} {words[i]} {words[i + 1]}"))
        yield pa.record_batch([pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.string())], names=["term", "context"])


def _collected(rows: DataFrame) -> list:
    """Rows on the driver; the caller has bounded them."""
    return rows.collect()


def fit(labelled: DataFrame, seed: int = 0) -> Model:
    """labelled: doc_id, text, toxic (1 or 0; rows with another or a null label are left out).

    Without toxic rows the lexicon is empty and every score is the share of
    toxic rows, which is then near 0.
    """
    rows = labelled.where("toxic in (0, 1)").select("doc_id", F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
    candidates = rows.where("toxic = 1").select("doc_id", "text").mapInArrow(_toxic_terms, "term string, context string")
    candidates = candidates.groupBy("term", "context").agg(F.lit(1).alias("one")).groupBy("term").count().where(F.col("count") >= LEAST_CONTEXTS)
    terms = {r["term"] for r in _collected(candidates.orderBy(F.desc("count"), "term").limit(MAX_TERMS))}

    def by_label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n.update((t, toxic) for t in {t for w in set(fold(text).split()) for t in _terms(w)} & terms)
                n[("", toxic)] += 1
        yield pa.record_batch([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["term", "toxic", "n"])

    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in _collected(rows.mapInArrow(by_label, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))):
        counts[r["term"]][r["toxic"]] = r["n"]
    clean, toxic = counts.pop("", [0, 0])
    odds = {t: math.log((b + 0.5) / (toxic + 1)) - math.log((a + 0.5) / (clean + 1)) for t, (a, b) in counts.items() if b}
    lexicon = {t: w for t, w in odds.items() if w >= math.log(LEAST_RATIO)}

    def found_phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, n = Matcher(lexicon, frozenset()), Counter()
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                folded = fold(text)
                n.update((p, label) for p in {p for s in matcher.hits(folded) for p in phrases(folded, s)})
        yield pa.record_batch([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["phrase", "toxic", "n"])

    by_phrase = rows.mapInArrow(found_phrases, "phrase string, toxic int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("b"))
    exceptions = frozenset(r["phrase"] for r in _collected(by_phrase.where("a >= 3 and a > 4 * b").orderBy(F.desc("a"), "phrase").limit(MAX_TERMS)))

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, n = Matcher(lexicon, exceptions), Counter()
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, y = matcher.features(text)
                n[(min(int(x * 8), BINS), min(int(y * 8), BINS), label)] += 1
        yield pa.record_batch([pa.array([k[i] for k in n], pa.int32()) for i in range(3)] + [pa.array(list(n.values()), pa.int64())], names=["x", "y", "toxic", "n"])

    bins = _collected(rows.mapInArrow(binned, "x int, y int, toxic int, n long").groupBy("x", "y", "toxic").agg(F.sum("n").alias("n")))
    return Model(lexicon, exceptions, _logistic(bins))


def _logistic(bins: list) -> tuple[float, float, float]:
    """Newton steps with a ridge; both labels weigh the same."""
    if not bins:
        return -4.0, 0.0, 0.0
    x = np.array([[1.0, (r["x"] + 0.5 * (r["x"] > 0)) / 8, (r["y"] + 0.5 * (r["y"] > 0)) / 8] for r in bins])
    y = np.array([r["toxic"] for r in bins], float)
    n = np.array([r["n"] for r in bins], float)
    for label in (0, 1):
        n[y == label] *= 1000.0 / max(n[y == label].sum(), 1.0)
    w, ridge = np.zeros(3), np.diag([0.01, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def sample(docs: DataFrame, labels: DataFrame, in_training: Column) -> DataFrame:
    """doc_id, text, toxic of at most SAMPLE_ROWS labelled rows of each label, the first by hash of the id."""
    chosen = labels.where(in_training & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    parts = [chosen.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for t in (0, 1)]
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row a row of docs.

    A null text is an empty one and gets the score of a text without a match.
    A null doc_id stays null, equal rows are scored each, an empty table gives no
    rows; other columns are ignored.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms, model.exceptions)
        for batch in batches:
            f = np.array([(1.0, *matcher.features(text)) for text in batch.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(f @ np.array(model.curve), -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, score double")
