"""Features for imputing a missing price: what is known of an item at a place on a day, from other places, other items and earlier days alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.operators.matching import vector_knn
from pricewell.operators.medians import without_own
from pricewell.operators.windows import place_medians
from pricewell.sources.scratch import stored

# Windows in days, neighbours taken, and what stands for a place that never reported the item.
CONTEXT_DAYS, LEVEL_DAYS, CHANGE_DAYS, NEIGHBOURS, NO_HISTORY_DAYS = 7, 30, 30, 5, 60.0
EARTH_KM = 6371.0088
#: Nearest places looked at first; where too few of them reported, eight times as many, and so on.
NEAR = 32

FEATURES = ["national_median", "neighbour_median", "neighbour_weighted", "neighbour_count", "nearest_neighbour_km", "last_local_price", "days_since_local", "national_trend", "fx_change_30d", "location_price_level", "day_of_week"]

_CELL = ["location_id", "item", "as_of"]


def _rounded(c: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5001) / scale


def km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def nearest_places(locations: DataFrame, k: int) -> DataFrame:
    """location_id, other, km: the k nearest other places of each place with coordinates; places are compared in blocks, as points of the sphere."""
    known = locations.where("latitude is not null and longitude is not null").select("location_id", "latitude", "longitude")
    lat, lon = F.radians("latitude"), F.radians("longitude")
    points = known.select(F.col("location_id").alias("id"), F.array(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)).alias("vector"))
    pairs = vector_knn(points, points, k).select(F.col("query_id").alias("location_id"), F.col("id").alias("other"))
    there = known.select(F.col("location_id").alias("other"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    return pairs.join(known, "location_id").join(there, "other").select("location_id", "other", km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon")).alias("km"))


def _around(cells: DataFrame, reports: DataFrame, locations: DataFrame) -> DataFrame:
    """Cells with the nearest ``NEIGHBOURS`` places that reported; one without any located reporter takes all reporters, unweighted, if there are some."""
    places, rows, k = locations.count(), [], NEAR
    there = reports.select(F.col("location_id").alias("other"), "item", "as_of", F.col("median").alias("price"))
    by_distance = Window.partitionBy(*_CELL).orderBy("km", "other")
    todo = cells
    while True:
        near = nearest_places(locations, k)
        met = todo.join(near, "location_id").join(there, ["other", "item", "as_of"])
        met = met.withColumn("_k", F.row_number().over(by_distance)).where(F.col("_k") <= NEIGHBOURS)
        weight = 1.0 / (1.0 + F.col("km"))
        found = met.groupBy(*_CELL).agg(F.percentile("price", 0.5).alias("median"), (F.sum(weight * F.col("price")) / F.sum(weight)).alias("weighted"), F.count("*").alias("n"), F.min("km").alias("km"))
        if k >= places - 1:
            rows.append(found)
            break
        found = stored(found, "neighbours")
        rows.append(found.where(F.col("n") == NEIGHBOURS))
        todo, k = todo.join(rows[-1], _CELL, "left_anti"), k * 8
        if todo.isEmpty():
            break
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    if locations.where("latitude is null or longitude is null").isEmpty():
        return out
    bare = cells.join(out, _CELL, "left_anti")
    others = without_own(reports, ["item", "as_of"], ["location_id"], "median", bare).where("n > 0").select(*_CELL, F.col("n").alias("_n"), F.col("median").alias("_median"))
    total = reports.groupBy("item", "as_of").agg(F.sum("median").alias("_sum"))
    own = reports.select(*_CELL, F.col("median").alias("_own"))
    bare = others.join(total, ["item", "as_of"]).join(own, _CELL, "left")
    weighted = (F.col("_sum") - F.coalesce("_own", F.lit(0.0))) / F.col("_n")
    return out.unionByName(bare.select(*_CELL, F.col("_median").alias("median"), weighted.alias("weighted"), F.col("_n").alias("n"), F.lit(0.0).alias("km")))


def _last(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells with the place's own newest price strictly before the day; of one day's prices that of the greatest reporter."""
    daily = rows.groupBy("location_id", "item", F.col("observed_on").alias("as_of")).agg(F.max(F.struct("reporter_id", "unit_price"))["unit_price"].alias("price"))
    line = cells.withColumns({"price": F.lit(None).cast("double"), "wanted": F.lit(True)}).unionByName(daily.withColumn("wanted", F.lit(False)))
    line = line.withColumns({"day": F.datediff("as_of", F.lit("1970-01-01").cast("date")), "known": F.when(F.col("price").isNotNull(), F.struct("price", "as_of"))})
    earlier = Window.partitionBy("location_id", "item").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return line.withColumn("last", F.last("known", ignorenulls=True).over(earlier)).where("wanted").select(*_CELL, F.col("last.price").alias("last_price"), F.datediff("as_of", "last.as_of").cast("double").alias("age"))


def _rate_change(days: DataFrame, rates: DataFrame) -> DataFrame:
    """as_of, change: the newest rate over the newest one 30 days earlier; one window over the calendar."""
    asked = days.select(F.col("as_of").alias("day")).union(days.select(F.date_sub("as_of", CHANGE_DAYS))).distinct().withColumns({"rate": F.lit(None).cast("double"), "asked": F.lit(True)})
    line = rates.select(F.col("rate_date").alias("day"), "rate", F.lit(False).alias("asked")).unionByName(asked)
    newest = Window.orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = line.withColumn("r", F.last(F.when(~F.col("asked"), F.struct("rate")), ignorenulls=True).over(newest)["rate"]).where("asked").select("day", F.col("r").alias("rate"))
    before = at.select(F.date_add("day", CHANGE_DAYS).alias("as_of"), F.col("rate").alias("_before"))
    now = days.join(at.withColumnRenamed("day", "as_of"), "as_of", "left").join(before, "as_of", "left")
    return now.select("as_of", F.coalesce(F.when(F.col("_before") > 0, _rounded(F.col("rate") / F.col("_before"), 6)), F.lit(1.0)).alias("change"))


def features(cells: DataFrame, observations: DataFrame, locations: DataFrame, rates: DataFrame) -> DataFrame:
    """The cells with ``FEATURES``, every cell once.

    cells: location_id, item, as_of; observations: location_id, item, observed_on,
    unit_price, reporter_id, is_valid; locations: location_id, latitude,
    longitude; rates: rate_date, rate, one a day. Only valid observations count.
    The national median, its trend (this week over the one before) and the
    neighbours leave out the cell's own place; the price level (the median ratio
    of the place's items to their national medians over 30 days) leaves out the
    cell's item; the last local price is from before the day. So neither the
    price that a cell stands for nor any later row moves a feature. What isn't
    known is 0, a trend, change or level 1, the age of no price 60 days. Empty
    tables give such values, no cells no rows.
    """
    cells = stored(cells.select(*_CELL).distinct(), "cells")
    valid = stored(observations.where("is_valid").select("location_id", "item", "observed_on", "unit_price", "reporter_id"), "valid")
    item_day, zero, one = ["item", "as_of"], F.lit(0.0), F.lit(1.0)
    spans = {"week": (0, CONTEXT_DAYS), "earlier": (CONTEXT_DAYS + 1, 2 * CONTEXT_DAYS + 1), "month": (0, LEVEL_DAYS)}
    priced = valid.where("location_id is not null and item is not null and unit_price is not null")
    medians = stored(place_medians(priced, spans).join(cells.select("as_of").distinct(), "as_of", "left_semi"), "place-medians")  # as many as days, places and items allow
    plain = medians.where("location_id is null").select(*item_day, F.col("week_others").alias("week_all"), F.col("earlier_others").alias("earlier_all"))
    placed = medians.where("location_id is not null")
    side = cells.join(placed.select(*_CELL, "week_others", "earlier_others", F.lit(True).alias("is_seen")), _CELL, "left").join(plain, item_day, "left")
    national = side.select(*_CELL, *(F.coalesce(F.when(F.col("is_seen"), F.col(f"{s}_others")).otherwise(F.col(f"{s}_all")), zero).alias(name) for s, name in (("week", "now"), ("earlier", "before"))))
    reports = placed.where("week_own is not null").select(*_CELL, F.col("week_own").alias("median"))
    around = _around(cells, reports, locations).select(*_CELL, F.col("median").alias("near_median"), F.col("weighted").alias("near_weighted"), F.col("n").alias("near_n"), "km")
    local = placed.where("month_own is not null").select(*_CELL, F.col("month_own").alias("local"), F.col("month_others").alias("abroad"))
    local = local.join(cells.select("location_id", "as_of").distinct(), ["location_id", "as_of"], "left_semi")
    ratios = local.where("abroad > 0").withColumn("ratio", F.col("local") / F.col("abroad"))
    level = without_own(ratios, ["location_id", "as_of"], ["item"], "ratio", cells).select(*_CELL, F.col("median").alias("level"))
    changes = _rate_change(cells.select("as_of").distinct(), rates)
    out = cells
    for side in (national, around, _last(cells, valid), level):
        out = out.join(side, _CELL, "left")
    out = out.join(changes, "as_of", "left")
    known = (F.col("now") > 0) & (F.col("before") > 0)
    made = {
        "national_median": F.coalesce("now", zero),
        "neighbour_median": F.coalesce("near_median", zero),
        "neighbour_weighted": F.coalesce("near_weighted", zero),
        "neighbour_count": F.coalesce("near_n", F.lit(0)).cast("double"),
        "nearest_neighbour_km": F.coalesce(_rounded(F.col("km"), 3), zero),
        "last_local_price": F.coalesce("last_price", zero),
        "days_since_local": F.coalesce("age", F.lit(NO_HISTORY_DAYS)),
        "national_trend": F.when(known, _rounded(F.col("now") / F.col("before"), 6)).otherwise(one),
        "fx_change_30d": F.coalesce("change", one),
        "location_price_level": F.coalesce(_rounded(F.col("level"), 6), one),
        "day_of_week": (F.dayofweek("as_of") - 1).cast("double"),
    }
    return out.select(*_CELL, *(c.alias(n) for n, c in made.items()))
