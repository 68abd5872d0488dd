"""Anchors of an index whose basket is revised: each version's level carries on where the one before it stood."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.sources.scratch import stored

#: Days from a place's first observation in which its base period is looked for.
SEARCH_DAYS = 45
# How an anchor came about.
BASE, CHAINED, BORROWED = "base_period", "chained", "chained_country_fallback"

ANCHORS = "location_id long, version int, link_date date, reference_cost double, link_factor double, method string, previous_cost double, linked_cost double"


class Basket(NamedTuple):
    version: int
    effective_from: object  # a date


def _base(locations: DataFrame, basket: Basket, cost: Callable, first_days: DataFrame, base_date) -> tuple[DataFrame, DataFrame]:
    """The first version's anchors, at the base date or the first day that prices the whole basket, and what was skipped."""
    if base_date is not None:
        cells = locations.withColumn("as_of", F.lit(base_date).cast("date"))
    else:
        cells = first_days.select("location_id", F.explode(F.sequence("first", F.date_add("first", SEARCH_DAYS))).alias("as_of"))
    priced = cost(basket.version, cells).where("is_complete")
    first = priced.groupBy("location_id").agg(F.min(F.struct("as_of", "cost")).alias("f")).select("location_id", "f.as_of", "f.cost")
    none = F.lit(None).cast("double")
    anchors = first.select("location_id", F.lit(basket.version).alias("version"), F.col("as_of").alias("link_date"), F.col("cost").alias("reference_cost"), none.alias("link_factor"), F.lit(BASE).alias("method"), none.alias("previous_cost"), F.col("cost").alias("linked_cost"))
    reason = "no day in the series prices the whole basket" if base_date is None else "the basket is not fully priced on the base date"
    return anchors, locations.join(first, "location_id", "left_anti").select("location_id", F.lit(basket.version).alias("version"), F.lit(reason).alias("reason"))


def _next(locations: DataFrame, basket: Basket, before: DataFrame, old: int, cost: Callable) -> tuple[DataFrame, DataFrame]:
    """A later version's anchors: both baskets are priced on the last day of the old one, the only day on which they compare."""
    link = F.date_sub(F.lit(basket.effective_from).cast("date"), 1)
    cells = locations.withColumn("as_of", link)
    side = lambda v, name: cost(v, cells).where("is_complete").select("location_id", F.col("cost").alias(name))
    rows = locations.join(before.select("location_id", F.col("reference_cost").alias("reference")), "location_id", "left").join(side(old, "previous_cost"), "location_id", "left").join(side(basket.version, "linked_cost"), "location_id", "left")
    own = F.when(F.col("reference").isNotNull() & (F.col("previous_cost") > 0), F.col("linked_cost") / F.col("previous_cost"))
    rows = stored(rows.withColumn("own", own), "chain-link")
    country = rows.agg(F.percentile("own", 0.5).alias("country"))
    rows = rows.crossJoin(F.broadcast(country))  # one row
    factor = F.coalesce("own", "country")
    measured: Column = F.col("own").isNotNull()
    kept = rows.where(F.col("reference").isNotNull() & factor.isNotNull())
    anchors = kept.select(
        "location_id", F.lit(basket.version).alias("version"), link.alias("link_date"), F.round(F.col("reference") * factor, 4).alias("reference_cost"), F.round(factor, 6).alias("link_factor"),
        F.when(measured, CHAINED).otherwise(BORROWED).alias("method"), F.when(measured, F.col("previous_cost")).alias("previous_cost"), F.when(measured, F.col("linked_cost")).alias("linked_cost"),
    )
    reason = F.when(F.col("reference").isNull(), f"version {old} has no anchor here to chain from").otherwise("both baskets could not be fully priced on the link date")
    return anchors, rows.where(F.col("reference").isNull() | factor.isNull()).select("location_id", F.lit(basket.version).alias("version"), reason.alias("reason"))


def chain(baskets: list[Basket], locations: DataFrame, cost: Callable[[int, DataFrame], DataFrame], first_days: DataFrame, known: DataFrame | None = None, force: bool = False, base_date=None) -> tuple[DataFrame, DataFrame]:
    """Every version's anchors at every place, and (location_id, version, reason) where there is none.

    baskets: a country's revisions, a few; they are chained one after the other,
    from the lowest version. locations: location_id. cost: (version, cells of
    location_id and as_of) -> the cells with cost and is_complete. first_days:
    location_id, first, the day of a place's first observation. The first
    version's reference is its cost in the base period. A later version's is the
    one before's times what the new basket costs of the old one on the link date;
    a place that can't measure that takes the median of the places that can.
    known: anchors that stand; they are kept as they are, and chained from,
    unless force is set. No places or baskets give no rows.
    """
    locations = locations.select("location_id").distinct()
    spark = locations.sparkSession
    held, skipped = spark.createDataFrame([], ANCHORS), spark.createDataFrame([], "location_id long, version int, reason string")
    before, old = None, None
    for basket in sorted(baskets):
        made, missing = _base(locations, basket, cost, first_days, base_date) if old is None else _next(locations, basket, before, old, cost)
        if known is not None and not force:
            standing = known.where(F.col("version") == basket.version).select(*held.columns)
            made = standing.unionByName(made.join(standing.select("location_id"), "location_id", "left_anti").select(*held.columns))
            missing = missing.join(standing.select("location_id"), "location_id", "left_anti")
        before, old = stored(made.select(*held.columns), "anchors"), basket.version
        held, skipped = held.unionByName(before), skipped.unionByName(missing)
    return held, skipped
