"""Anomaly layers over price observations: what one price is held against, hard bounds, robust outliers, and the verdict of all layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.operators.medians import sliding_median
from pricewell.operators.windows import peers
from pricewell.sources.scratch import stored

#: Days of peers at the same place, and of an item's reference at all places.
PEER_DAYS, REFERENCE_DAYS = 7, 90
# The layers' constants and the verdict's cuts.
BOUND_FACTOR, MAD_TO_SIGMA, THRESHOLD, LEAST_PEERS = 4.0, 0.6745, 3.5, 4
REJECTED, SUSPECT = 0.85, 0.45
ROUND = ((100.0, 1.0), (50.0, 0.9), (10.0, 0.7), (5.0, 0.5), (1.0, 0.3))

FEATURES = ["to_local", "to_national", "from_trend", "reporter_deviation", "submission_rate", "roundness", "hour_of_day", "days_since"]

_CELL = ["location_id", "item"]


def context(observations: DataFrame) -> DataFrame:
    """Each observation with n_peers, local_median, mad and reference.

    observations: location_id, item, observed_on date, unit_price, reporter_id,
    is_valid, which must be set; other columns are ignored. Peers are the valid
    observations of the place and item in the ``PEER_DAYS`` days before and the
    day itself, but not the observation, of which an equal twin is another one;
    local_median and mad (of distances to it) are theirs, null without peers.
    reference is the item's median of valid prices over ``REFERENCE_DAYS`` days, the
    observation included. An empty table gives no rows, an observation without place, item or day
    has no peers. No observation meets its peers: medians come from places in
    sorted windows.
    """
    rows = stored(observations.select(*_CELL, "observed_on", "reporter_id", "unit_price", "is_valid"), "observations")  # read by both steps
    reference = sliding_median(rows.where("is_valid"), ["item"], "observed_on", "unit_price", REFERENCE_DAYS).select("item", F.col("as_of").alias("observed_on"), F.col("median").alias("reference"))
    return peers(rows, PEER_DAYS).join(reference, ["item", "observed_on"], "left").select(*_CELL, "observed_on", "reporter_id", "unit_price", "is_valid", "n_peers", "local_median", "mad", "reference")


def bounds(price: Column, reference: Column) -> Column:
    """1 where the price is beyond ``BOUND_FACTOR`` times its reference, either way; 0 without one."""
    known = reference.isNotNull() & (reference > 0)
    return F.when(known & ((price > reference * BOUND_FACTOR) | (price < reference / BOUND_FACTOR)), 1.0).otherwise(0.0)


def robust(price: Column, n_peers: Column, median: Column, mad: Column) -> Column:
    """0 to 1 by the distance from the peers' median in robust deviations; 0 with under ``LEAST_PEERS`` peers. Where all peers are equal, 0.6 beyond half their price."""
    z = F.abs(F.lit(MAD_TO_SIGMA) * (price - median) / mad)
    flat = F.when((median > 0) & (F.abs(price - median) / median > 0.5), 0.6).otherwise(0.0)
    scaled = F.when(z < THRESHOLD, 0.0).otherwise(F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * (z - F.lit(THRESHOLD))))
    return F.when(n_peers < LEAST_PEERS, 0.0).when(mad <= 0, flat).otherwise(scaled)


def roundness(price: Column) -> Column:
    """How round a price is, 0 to 1."""
    out = F.when(price <= 0, 0.0)
    for divisor, value in ROUND:
        out = out.when(F.abs(price / divisor - F.round(price / divisor)) < 1e-9, value)
    return out.otherwise(0.0)


def _ratio(price: Column, reference: Column) -> Column:
    """1 where the reference isn't known, so that it never looks extreme."""
    return F.when(reference.isNotNull() & (reference > 0), price / reference).otherwise(1.0)


def features(rows: DataFrame) -> DataFrame:
    """rows of ``context`` with reputation, with the forest's columns ``FEATURES``. Rate, hour and days since the last report have no source here: they are constant, as prices carry a day alone."""
    price, reference = F.col("unit_price"), F.col("reference")
    one = F.lit(1.0)
    made = [_ratio(price, F.col("local_median")), _ratio(price, reference), _ratio(price, reference) - 1.0, one - F.col("reputation"), one, roundness(price), F.lit(0.0), one]
    return rows.withColumns(dict(zip(FEATURES, made, strict=True)))


def verdict(score: Column) -> Column:
    return F.when(score >= REJECTED, "rejected").when(score >= SUSPECT, "suspect").otherwise("clean")
