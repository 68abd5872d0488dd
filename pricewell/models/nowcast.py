"""Imputed prices with their interval and method: quantile boosting of the ratio to the national median, else a plain fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.models import boosting, store
from pricewell.operators.nowcast import FEATURES

# Quantiles fitted, what the interval claims to hold, the fallbacks' spreads, method names.
QUANTILES, NOMINAL = [0.05, 0.5, 0.95], 0.8
NEAR_SPREAD, NATIONAL_SPREAD = 0.30, 0.45
MODEL, NEAR, NATIONAL = "quantile_boosting", "fallback_local_median", "fallback_national_median"


def train(rows: DataFrame, **parameters) -> boosting.Model | None:
    """A model from rows with ``FEATURES`` and price. The target is the price's ratio to the national median, so one model serves all items; rows without one, or without a price, are left out."""
    usable = rows.where((F.col("national_median") > 0) & F.col("price").isNotNull())
    return boosting.fit(usable.withColumn("_ratio", F.col("price") / F.col("national_median")), FEATURES, "_ratio", QUANTILES, **parameters)


def save(spark: SparkSession, folder: str, country: str, model: boosting.Model) -> int:
    return store.save(spark, folder, f"nowcast-{country}", *boosting.parts(spark, model))


def load(spark: SparkSession, folder: str, country: str, version: int | None = None) -> boosting.Model:
    """The stored model; refuses one of other features or quantiles."""
    return boosting.from_parts(*store.load(spark, folder, f"nowcast-{country}", {"features": FEATURES, "quantiles": QUANTILES}, version))


def impute(rows: DataFrame, model: boosting.Model | None) -> DataFrame:
    """rows with value, lower, upper, method: the model's where there is one and a national median, else the neighbours', else the national median, by the place's price level.

    A lower bound is 0 at least. A row with neither median has no imputation and
    is left out.
    """
    anchor, near = F.col("national_median"), F.col("neighbour_median")
    if model is None:
        rows = rows.withColumn("quantiles", F.lit(None).cast("array<double>"))
    else:
        rows = boosting.predict(rows, model)
    by_model = F.col("quantiles").isNotNull() & (anchor > 0)
    level = F.when(F.col("location_price_level") > 0, F.col("location_price_level")).otherwise(1.0)
    plain = F.when(near > 0, near).otherwise(anchor) * level
    spread = F.when(near > 0, NEAR_SPREAD).otherwise(NATIONAL_SPREAD)
    at = lambda i: F.col("quantiles")[i] * anchor
    made = {
        "value": F.when(by_model, at(1)).otherwise(plain),
        "lower": F.when(by_model, F.greatest(F.lit(0.0), at(0))).otherwise(plain * (1 - spread)),
        "upper": F.when(by_model, at(2)).otherwise(plain * (1 + spread)),
        "method": F.when(by_model, MODEL).when(near > 0, NEAR).otherwise(NATIONAL),
    }
    out = rows.where((anchor > 0) | (near > 0)).withColumns(made).drop("quantiles")
    return out.withColumns({c: F.round(c, 6) for c in ("value", "lower", "upper")})


def evaluate(rows: DataFrame) -> DataFrame:
    """One row of figures over imputed rows with price and national_median: errors, pinball loss of the three quantiles, coverage, width, share of fallbacks, and the national median's own error. Prices of 0 or less are left out."""
    price, value, lower, upper = (F.col(c) for c in ("price", "value", "lower", "upper"))
    loss = lambda e, q: F.greatest(q * (price - e), (q - 1.0) * (price - e))
    losses = sum(loss(e, q) for e, q in zip((lower, value, upper), QUANTILES, strict=True)) / len(QUANTILES)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.where(price > 0).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(value - price)).alias("mae"),
        F.avg(F.abs(value - price) / price).alias("mape"),
        F.percentile_approx(F.abs(value - price) / price, 0.5, 10_000).alias("median_ape"),
        F.avg(losses).alias("pinball"),
        share(price.between(lower, upper)).alias("coverage"),
        F.avg(F.when(value > 0, (upper - lower) / value).otherwise(0.0)).alias("width"),
        share(F.col("method") != MODEL).alias("fallback_share"),
        F.avg(F.when(F.col("national_median") > 0, F.abs(F.col("national_median") - price) / price)).alias("baseline_mape"),
    )
