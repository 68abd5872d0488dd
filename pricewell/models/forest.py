"""Isolation forest: trees of random cuts, each grown on a bounded sample of its own; rows that few cuts set apart are unusual.

Rows choose their trees by a hash of their values, so a sample doesn't depend on
partitions. A tree's sample is one small group, its tree one row of arrays; all
trees together are bounded by ``TREES`` and ``SAMPLE`` and are broadcast to score
every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.models.quantiles import exact_quantile
from pricewell.sources.scratch import released, stored

TREES, SAMPLE, CONTAMINATION, LEAST_ROWS = 200, 256, 0.05, 50
#: A row chooses each of its trees by itself up to so many times the rows that all trees need; beyond it takes one tree at most.
DENSE = 16


def expected_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth at which a search in a random binary tree of n rows ends without a hit."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 3.0)
    return np.where(n > 2, 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe, np.where(n == 2, 1.0, 0.0))


class Tree(NamedTuple):
    """A whole binary tree in level order: children of i are 2 i + 1 and 2 i + 2. feature -1: a leaf, of path length ``path``."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray


class Forest(NamedTuple):
    features: list[str]
    trees: list[Tree]
    depth: int
    sample: int
    offset: float  # of the plain score; below it a row is unusual
    rows: int  # it was fitted on


def grow(x: np.ndarray, depth: int, seed: int) -> Tree:
    """A tree of random cuts of random columns over the rows of x."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (depth + 1) - 1
    feature, cut, path = np.full(nodes, -1, np.int8), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        node, level, rows = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        wide = np.flatnonzero(high > low)
        if level == depth or len(rows) < 2 or not len(wide):
            path[node] = level + expected_depth(len(rows))
            continue
        f = rng.choice(wide)
        at = rng.uniform(low[f], high[f])
        right = x[rows, f] > at
        if right.all() or not right.any():  # a cut at the very edge
            at, right = low[f], x[rows, f] > low[f]
        feature[node], cut[node] = f, at
        todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return Tree(feature, cut, path)


def plain_score(forest: Forest, x: np.ndarray) -> np.ndarray:
    """-1 (set apart at once) to 0, of every row of x."""
    total = np.zeros(len(x))
    every = np.arange(len(x))
    for tree in forest.trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(forest.depth):
            f = tree.feature[node]
            inner = f >= 0
            node = np.where(inner, 2 * node + 1 + (x[every, np.maximum(f, 0)] > tree.cut[node]), node)
        total += tree.path[node]
    return -(2.0 ** (-total / len(forest.trees) / max(float(expected_depth(forest.sample)), 1e-12)))


def _samples(rows: DataFrame, features: list[str], n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """tree, order and the features: of each tree's rows at least ``sample``, as far as there are, and not many more."""
    share = min(1.0, (sample + 6.0 * math.sqrt(sample)) / n)
    unit = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 11) / F.lit(float(2**53))
    own = F.xxhash64(*features, F.lit(seed))
    if n <= DENSE * trees * sample:
        chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: unit(own, t) < share)
    else:
        tree = F.floor(unit(own, F.lit(-1)) / F.lit(share)).cast("int")
        chosen = F.when(tree < trees, F.array(tree)).otherwise(F.array().cast("array<int>"))
    picked = rows.select(*features, own.alias("_own"), F.explode(chosen).alias("tree"))
    return picked.select("tree", F.xxhash64("_own", "tree", F.lit(1)).alias("order"), *features)


def fit(rows: DataFrame, features: list[str], trees: int = TREES, sample: int = SAMPLE, contamination: float = CONTAMINATION, seed: int = 7) -> Forest | None:
    """A forest over the rows, or None with under ``LEAST_ROWS`` rows.

    features: numeric columns; a null counts as 0. Of all rows ``contamination``
    lie below the forest's offset, which is the exact quantile of all scores.
    Equal rows hash alike, so they are in the same trees.
    """
    rows = rows.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    n = rows.count()
    if n < LEAST_ROWS:
        return None
    size = min(sample, n)
    depth = math.ceil(math.log2(max(size, 2)))

    def grown(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", *features], kind="stable").head(size)
        tree = grow(part[features].to_numpy(), depth, seed * 1_000_003 + int(part["tree"].iloc[0]))
        return pd.DataFrame({"tree": part["tree"].iloc[:1], "feature": [tree.feature.tobytes()], "cut": [tree.cut.tobytes()], "path": [tree.path.tobytes()]})

    made = _samples(rows, features, n, trees, size, seed).groupBy("tree").applyInPandas(grown, "tree int, feature binary, cut binary, path binary")
    found = [Tree(np.frombuffer(r["feature"], np.int8), np.frombuffer(r["cut"]), np.frombuffer(r["path"])) for r in sorted(made.collect(), key=lambda r: r["tree"])]
    forest = Forest(features, found, depth, size, 0.0, n)
    scores = stored(score(rows, forest, plain=True).select("forest"), "forest-scores")
    offset = exact_quantile(scores, "forest", contamination)
    released(scores)
    return forest._replace(offset=offset)


def score(rows: DataFrame, forest: Forest | None, plain: bool = False) -> DataFrame:
    """rows with ``forest``: 0 for usual rows, up to 1 for those far below the offset; 0 without a forest. plain: the score as it is."""
    if forest is None:
        return rows.withColumn("forest", F.lit(0.0))
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    numbers = [f"_x{i}" for i in range(len(forest.features))]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in numbers])
            s = plain_score(shared.value, x) if len(x) else np.zeros(0)
            if not plain:
                s = np.where(s < shared.value.offset, np.minimum(1.0, (shared.value.offset - s) * 4.0), 0.0)
            kept = batch.drop_columns(numbers)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(s)], names=[*kept.schema.names, "forest"])

    rows = rows.drop("forest")
    schema = T.StructType([*rows.schema.fields, T.StructField("forest", T.DoubleType())])
    made = {x: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for x, c in zip(numbers, forest.features, strict=True)}
    return rows.withColumns(made).mapInArrow(task, schema)
