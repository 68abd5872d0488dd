"""Gradient boosting of quantiles on histograms that Spark sums.

Rows are cut into bins once and kept as blocks in the shared folder. Each level
of a round's trees is one pass: tasks count, per node, feature and bin, the rows
and those whose target lies above the current estimate, Spark adds the counts up,
and the driver, which sees bounded histograms alone, picks the splits of all
quantiles' trees. The pinball loss has only two gradients, so these two counts
are exact sums of it in any order. A last pass of a round counts residuals per
leaf, and a leaf's value is their quantile. Every ``REFRESH`` rounds the blocks
are written anew with the estimates so far, which bounds what a pass recomputes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.sources.scratch import released, stored

ROUNDS, DEPTH, RATE, LEAST_LEAF, LEAST_ROWS, BINS, REFRESH = 40, 4, 0.15, 20, 200, 64, 10
#: Residuals' bins on each side of 0, even in the inverse hyperbolic sine, so a bin's width follows the residual's size.
RESIDUALS, STEP, FINEST = 1024, 0.019, 1e-8
BLOCK_ROWS = 16_384


class Tree(NamedTuple):
    """A whole binary tree in level order. feature -1: a leaf; a row whose bin is at most ``bin`` goes left, to 2 i + 1."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray


class Model(NamedTuple):
    features: list[str]
    quantiles: list[float]
    cuts: list[list[float]]  # of each feature; a value's bin is the number of cuts below it
    start: list[float]
    trees: list[list[Tree]]  # rounds, each with a tree a quantile
    rows: int  # it was fitted on


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    return np.column_stack([np.searchsorted(np.asarray(c, float), x[:, i], "left") for i, c in enumerate(cuts)]).astype(np.uint8)


def node_of(tree: Tree, x: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row of bins has reached after so many levels."""
    node, every = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        f = tree.feature[node]
        inner = f >= 0
        node = np.where(inner, 2 * node + 1 + (x[every, np.maximum(f, 0)] > tree.bin[node]), node)
    return node


def estimates(model_start: list[float], trees: list[list[Tree]], x: np.ndarray, margin: np.ndarray | None = None) -> np.ndarray:
    """A column a quantile, from the margin on or from the start."""
    out = np.tile(np.asarray(model_start, float), (len(x), 1)) if margin is None else margin.copy()
    for row in trees:
        for q, tree in enumerate(row):
            depth = (len(tree.feature) + 1).bit_length() - 2
            out[:, q] += tree.value[node_of(tree, x, depth)]
    return out


def best_split(n: np.ndarray, above: np.ndarray, quantile: float, least: int) -> tuple[int, int] | None:
    """(feature, bin) that lowers the pinball loss's second-order model most. n, above: rows, and those above the estimate, by feature and bin."""
    gradient = (n - above) * (1.0 - quantile) - above * quantile
    left_n, left_g = np.cumsum(n, axis=1)[:, :-1], np.cumsum(gradient, axis=1)[:, :-1]
    total_n, total_g = n.sum(axis=1)[:, None], gradient.sum(axis=1)[:, None]
    right_n, right_g = total_n - left_n, total_g - left_g
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / left_n + right_g**2 / right_n - total_g**2 / total_n
    gain = np.where((left_n >= least) & (right_n >= least), gain, -np.inf)
    at = int(np.argmax(gain))  # of equals the first feature and bin
    if not gain.size or not gain.flat[at] > 1e-9:
        return None
    return divmod(at, gain.shape[1])


def _residual_bin(r: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(np.arcsinh(r / scale) / STEP), -RESIDUALS, RESIDUALS - 1).astype(np.int64) + RESIDUALS


def residual_quantile(counts: np.ndarray, quantile: float, scale: float) -> float:
    """The quantile of residuals that are counted in bins, even inside a bin."""
    total = np.cumsum(counts)
    if not total[-1]:
        return 0.0
    want = quantile * total[-1]
    at = min(int(np.searchsorted(total, want, "left")), len(counts) - 1)
    inside = (want - (total[at] - counts[at])) / counts[at] if counts[at] else 0.0
    return float(np.sinh((at - RESIDUALS + inside) * STEP) * scale)


def _blocks(rows: DataFrame, features: list[str], target: str, cuts: list[list[float]]) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = binned(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]), cuts) if batch.num_rows else np.zeros((0, len(features)), np.uint8)
            y = batch.column(len(features)).to_numpy(zero_copy_only=False).astype(float)
            for i in range(0, len(y), BLOCK_ROWS):
                part = slice(i, i + BLOCK_ROWS)
                yield pa.record_batch([pa.array([x[part].tobytes()]), pa.array([y[part].tobytes()]), pa.array([None], pa.binary())], names=["x", "y", "margin"])

    columns = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features]
    return stored(rows.select(*(c.alias(f"x{i}") for i, c in enumerate(columns)), F.col(f"`{target}`").cast("double").alias("y")).mapInArrow(task, "x binary, y binary, margin binary"), "boosting-blocks")


def _each(batches: Iterable[pa.RecordBatch], start: list[float], trees: list[list[Tree]], n_features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each block's bins, targets and estimates."""
    for batch in batches:
        for x, y, margin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(x, np.uint8).reshape(-1, n_features)
            held = None if margin is None else np.frombuffer(margin).reshape(len(x), -1)
            yield x, np.frombuffer(y), estimates(start, trees, x, held)


def _counted(blocks: DataFrame, size: int, count: Callable, start: list[float], trees: list[list[Tree]], n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums over all blocks of two arrays of ``size`` counts. count: bins, targets, estimates -> positions, and which of them count in the second."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, above = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for block in _each(batches, start, trees, n_features):
            for positions, chosen in count(*block):
                n += np.bincount(positions, minlength=size)
                above += np.bincount(positions[chosen], minlength=size)
        at = np.flatnonzero(n)
        if len(at):
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(above[at])], names=["cell", "n", "above"])

    sums = blocks.mapInArrow(task, "cell int, n long, above long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("above").alias("above")).toArrow()
    n, above = np.zeros(size, np.int64), np.zeros(size, np.int64)
    cell = sums.column("cell").to_numpy()
    n[cell], above[cell] = sums.column("n").to_numpy(), sums.column("above").to_numpy()
    return n, above


def _refreshed(blocks: DataFrame, start: list[float], trees: list[list[Tree]], n_features: int) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, margin in _each(batches, start, trees, n_features):
            yield pa.record_batch([pa.array([x.tobytes()]), pa.array([y.tobytes()]), pa.array([margin.tobytes()])], names=["x", "y", "margin"])

    out = stored(blocks.mapInArrow(task, "x binary, y binary, margin binary"), "boosting-blocks")
    released(blocks)
    return out


def fit(rows: DataFrame, features: list[str], target: str, quantiles: list[float], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, least_leaf: int = LEAST_LEAF, least_rows: int = LEAST_ROWS) -> Model | None:
    """A model of the target's quantiles, or None with under ``least_rows`` rows.

    features: numeric columns, a null counts as 0; rows with a null target are
    left out. Cuts and starting values are approximate quantiles of all rows (to
    1 in 10,000).
    """
    rows = rows.where(F.col(f"`{target}`").isNotNull())
    shares = [i / BINS for i in range(1, BINS)]
    numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features]
    y = F.col(f"`{target}`").cast("double")
    facts = rows.agg(F.count("*"), F.percentile_approx(y, list(quantiles), 10_000), F.min(y), F.max(y), *(F.percentile_approx(c, shares, 10_000) for c in numbers)).first()
    n, start, low, high, *cuts = facts
    if n < least_rows:
        return None
    cuts = [sorted(set(c)) for c in cuts]
    k, width, scale = len(features), len(quantiles), max(high - low, 1e-300) * FINEST
    blocks, trees, done = _blocks(rows, features, target, cuts), [], 0  # done: rounds inside the blocks' estimates
    nodes = 2 ** (depth + 1) - 1
    for number in range(rounds):
        grown = [Tree(np.full(nodes, -1, np.int8), np.zeros(nodes, np.uint8), np.zeros(nodes)) for _ in quantiles]
        for level in range(depth):
            first, many = 2**level - 1, 2**level

            def split_counts(x: np.ndarray, y: np.ndarray, now: np.ndarray, level=level, first=first, many=many, grown=grown):
                for q in range(width):
                    node = node_of(grown[q], x, level) - first
                    here = node >= 0  # others have ended in a leaf above
                    base = ((q * many + node[here])[:, None] * k + np.arange(k)) * BINS + x[here]
                    over = (y > now[:, q])[here]
                    yield base.ravel(), np.repeat(over, k)

            n_, above = _counted(blocks, width * many * k * BINS, split_counts, start, trees[done:], k)
            shape = (width, many, k, BINS)
            n_, above = n_.reshape(shape), above.reshape(shape)
            for q in range(width):
                for i in range(many):
                    if n_[q, i].any() and (found := best_split(n_[q, i], above[q, i], quantiles[q], least_leaf)):
                        grown[q].feature[first + i], grown[q].bin[first + i] = found

        def leaf_counts(x: np.ndarray, y: np.ndarray, now: np.ndarray, grown=grown):
            for q in range(width):
                leaf = node_of(grown[q], x, depth)
                yield (q * nodes + leaf) * 2 * RESIDUALS + _residual_bin(y - now[:, q], scale), np.zeros(len(y), bool)

        held, _ = _counted(blocks, width * nodes * 2 * RESIDUALS, leaf_counts, start, trees[done:], k)
        held = held.reshape(width, nodes, 2 * RESIDUALS)
        for q, tree in enumerate(grown):
            for leaf in np.flatnonzero(held[q].any(axis=1)):
                tree.value[leaf] = rate * residual_quantile(held[q, leaf], quantiles[q], scale)
        trees.append(grown)
        if len(trees) - done == REFRESH and number < rounds - 1:
            blocks, done = _refreshed(blocks, start, trees[done:], k), len(trees)
    released(blocks)
    return Model(list(features), list(quantiles), cuts, list(start), trees, n)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """rows with ``quantiles``, an array of the model's estimates in ascending order: those of trees fitted apart can cross. A feature that is null counts as 0."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    numbers = [f"_x{i}" for i in range(len(model.features))]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in numbers])
            out = np.sort(estimates(m.start, m.trees, binned(x, m.cuts)), axis=1) if len(x) else np.zeros((0, len(m.quantiles)))
            bounds = np.arange(len(x) + 1, dtype=np.int32) * len(m.quantiles)
            kept = batch.drop_columns(numbers)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(out.ravel()))], names=[*kept.schema.names, "quantiles"])

    rows = rows.drop("quantiles")
    schema = T.StructType([*rows.schema.fields, T.StructField("quantiles", T.ArrayType(T.DoubleType()))])
    made = {x: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for x, c in zip(numbers, model.features, strict=True)}
    return rows.withColumns(made).mapInArrow(task, schema)


def parts(spark: SparkSession, model: Model) -> tuple[dict, DataFrame]:
    """What the model store keeps: facts that JSON can hold, and a row a tree."""
    facts = {"kind": "quantile boosting", "features": model.features, "quantiles": model.quantiles, "cuts": model.cuts, "start": model.start, "rows": model.rows}
    rows = [(i, q, t.feature.tobytes(), t.bin.tobytes(), t.value.tobytes()) for i, row in enumerate(model.trees) for q, t in enumerate(row)]
    return json.loads(json.dumps(facts)), spark.createDataFrame(rows, "round int, quantile int, feature binary, bin binary, value binary")


def from_parts(facts: dict, rows: DataFrame) -> Model:
    held = sorted(rows.collect(), key=lambda r: (r["round"], r["quantile"]))
    trees = [Tree(np.frombuffer(r["feature"], np.int8), np.frombuffer(r["bin"], np.uint8), np.frombuffer(r["value"])) for r in held]
    width = len(facts["quantiles"])
    return Model(facts["features"], facts["quantiles"], facts["cuts"], facts["start"], [trees[i : i + width] for i in range(0, len(trees), width)], facts["rows"])


def pinball(y: float, estimate: float, quantile: float) -> float:
    return max(quantile * (y - estimate), (quantile - 1.0) * (y - estimate))


assert math.sinh(RESIDUALS * STEP) * FINEST > 1.0  # the outer bins lie beyond the target's range
