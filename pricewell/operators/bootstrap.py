"""Bootstrap estimates of weighted medians, and intervals of basket costs from them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWS = 500


def resampled(values: np.ndarray, weights: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Weighted medians of ``draws`` resamples of n out of n, drawn in proportion to the weights, which weigh again in the median."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    picks = np.sort(np.random.default_rng(seed).choice(len(values), (draws, len(values)), p=weights / weights.sum()), axis=1)
    running = weights[picks].cumsum(axis=1)
    half = running[:, -1:] / 2.0
    over = np.argmax(running > half, axis=1)
    at_half = np.abs(running - half) < 1e-12
    some = at_half[:, :-1].any(axis=1)
    rows, first = np.arange(draws), np.argmax(at_half, axis=1)
    out = values[picks[rows, over]]
    following = np.minimum(first + 1, len(values) - 1)
    return np.where(some, (values[picks[rows, first]] + values[picks[rows, following]]) / 2.0, out)


def bootstrap(cells: DataFrame, draws: int = DRAWS) -> DataFrame:
    """location_id, item, as_of, samples: one row a cell of observations (location_id, item, as_of, unit_price, weight).

    Observations whose price or weight isn't positive are left out. The seed is
    the CRC-32 of the cell's name, so a cell computed again has the same samples.
    """
    keys = ["location_id", "item", "as_of"]
    pairs = F.sort_array(F.collect_list(F.struct("unit_price", "weight")))  # a cell: one item and place in a few days
    rows = cells.where("unit_price > 0 and weight > 0").groupBy(*keys).agg(pairs.alias("p")).select(*keys, F.concat_ws(":", F.col("location_id").cast("string"), "item", F.col("as_of").cast("string")).alias("name"), F.col("p.unit_price").alias("v"), F.col("p.weight").alias("w"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            samples = [resampled(np.asarray(v), np.asarray(w), draws, zlib.crc32(n.encode())) for n, v, w in zip(f["name"], f["v"], f["w"], strict=True)]
            yield f[keys].assign(samples=samples)

    return rows.mapInPandas(task, "location_id long, item string, as_of date, samples array<double>")


def basket_interval(components: DataFrame, keys: list[str], draws: int = DRAWS) -> DataFrame:
    """keys, lo, hi: 2.5 and 97.5 percentiles of the basket's cost over the draws.

    components: keys, quantity, samples; draw k takes sample k modulo their
    number, so an imputed item may give its low, middle and high price. One of
    no samples is left out, as a basket without any component is.
    """
    part = F.struct("quantity", "samples")
    baskets = components.where(F.size("samples") > 0).groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("parts"))  # a basket's items
    total = lambda k: F.aggregate("parts", F.lit(0.0), lambda sum_, p: sum_ + p["quantity"] * F.element_at(p["samples"], (k % F.size(p["samples"]) + 1).cast("int")))
    totals = baskets.select(*keys, F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), total)).alias("_t"))

    def at(share: float):
        place = share * (draws - 1)
        low, high = int(place), min(int(place) + 1, draws - 1)
        return F.col("_t")[low] + (F.col("_t")[high] - F.col("_t")[low]) * F.lit(place - low)

    return totals.select(*keys, at(0.025).alias("lo"), at(0.975).alias("hi"))
