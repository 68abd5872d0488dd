"""Exact medians that don't compare all pairs: without a member's own values, and over sliding windows of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.sources.scratch import stored

#: Ranges of value into which a key's rows fall, and how often the ranges that hold a median are cut again.
RANGES, LEVELS = 16, 3


def _middle(n: Column) -> tuple[Column, Column]:
    """Places, from 0, of the one or two middle values of n."""
    return F.floor((n - 1) / 2).cast("long"), F.floor(n / 2).cast("long")


def without_own(rows: DataFrame, group: list[str], member: list[str], value: str, cells: DataFrame | None = None) -> DataFrame:
    """group, member, n, median: count and median of the group's values without the member's own.

    cells: the group and member columns that are wanted, each once; all pairs in
    rows if none are given. A member without rows in the group gets the plain
    median; a cell whose group has no other value has n 0 and a null median. Null
    values are left out. A group is sorted once: the k-th value without a
    member's own lies so many places further as own values stand before it, and
    that number comes from the own values' places alone. No value meets another,
    so the work is that of a sort, however large a group is.
    """
    of_group, of_member = Window.partitionBy(*group), Window.partitionBy(*group, *member)
    placed = rows.where(F.col(value).isNotNull()).select(*group, *member, F.col(value).alias("_v"))
    placed = placed.withColumns({"_p": F.row_number().over(of_group.orderBy("_v", *member)) - 1, "_n": F.count("*").over(of_group)})
    own = placed.withColumns({"_j": F.row_number().over(of_member.orderBy("_p")) - 1, "_m": F.count("*").over(of_member)})
    low, high = _middle(F.col("_n") - F.col("_m"))
    before = F.col("_p") - F.col("_j")
    shifted = own.groupBy(*group, *member).agg(F.max("_m").alias("_m"), F.count_if(before <= low).alias("_low"), F.count_if(before <= high).alias("_high"))
    if cells is None:
        cells = shifted.select(*group, *member)
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("_n"))
    zero = F.lit(0)
    cells = cells.join(sizes, group, "left").join(shifted, [*group, *member], "left")
    n = F.coalesce("_n", zero) - F.coalesce("_m", zero)
    low, high = _middle(n)
    cells = cells.select(*group, *member, n.alias("n"), F.explode_outer(F.when(n > 0, F.array(low + F.coalesce("_low", zero), high + F.coalesce("_high", zero)))).alias("_p"))
    found = cells.join(placed.select(*group, "_p", "_v"), [*group, "_p"], "left")
    return found.groupBy(*group, *member, "n").agg(F.avg("_v").alias("median"))


def _slid(counts: DataFrame, group: list[str], back: int) -> DataFrame:
    """group, as_of, _c: the sums of counts (group, _day, _c) over the days from as_of - back to as_of, where they aren't 0."""
    ends = counts.groupBy(*group).agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    grid = ends.select(*group, F.explode(F.sequence("_first", F.date_add("_last", back))).alias("_day"))
    series = Window.partitionBy(*group).orderBy("_day")
    total = F.sum(F.coalesce("_c", F.lit(0))).over(series.rowsBetween(-back, Window.currentRow))
    return grid.join(counts, [*group, "_day"], "left").select(*group, F.col("_day").alias("as_of"), total.alias("_c")).where("_c > 0")


def sliding_median(rows: DataFrame, key: list[str], day: str, value: str, back: int) -> DataFrame:
    """key, as_of, n, median over each key's values of the days from as_of - back to as_of, for every day that has some.

    Approximate quantiles cut a key's values into ``RANGES`` ranges, and counts by
    day and range, as many as the calendar and the keys give, find the range that
    holds the median of each window; such ranges are cut again, ``LEVELS`` times
    in all. Only rows of the last ranges are repeated for the days that see them,
    equal ones of a day together, and the exact values are picked among them. The
    cuts change the work, not the result, as long as all steps see the same ones:
    they are stored, since they come out otherwise when computed again in another
    order. Null values and days are left out.
    """
    rows = rows.where(F.col(value).isNotNull() & F.col(day).isNotNull()).select(*key, F.col(day).alias("_day"), F.col(value).alias("_v"))
    low, high = _middle(F.col("_c"))
    totals = _slid(rows.groupBy(*key, "_day").agg(F.count("*").alias("_c")), key, back)
    wanted = totals.select(*key, "as_of", F.col("_c").alias("n"), F.explode(F.array(low, high)).alias("_at")).distinct()
    group = list(key)
    for level in range(LEVELS):
        cuts = stored(rows.groupBy(*group).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts")), "cuts")
        range_ = f"_range{level}"
        rows = rows.join(cuts, group).select(*group, F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias(range_), "_day", "_v")
        seen = _slid(rows.groupBy(*group, range_, "_day").agg(F.count("*").alias("_c")), [*group, range_], back)
        of_day = Window.partitionBy(*group, "as_of").orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
        seen = seen.withColumn("_before", F.coalesce(F.sum("_c").over(of_day), F.lit(0)))
        held = wanted.join(seen, [*group, "as_of"]).where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_c")))
        group.append(range_)
        wanted = stored(held.select(*group, "as_of", "n", (F.col("_at") - F.col("_before")).alias("_at")), "sought")
        rows = stored(rows.join(wanted.select(*group).distinct(), group, "left_semi"), "ranges")
    equal = rows.groupBy(*group, "_day", "_v").agg(F.count("*").alias("_c"))
    repeated = equal.select(*group, "_v", "_c", F.explode(F.sequence("_day", F.date_add("_day", back))).alias("as_of"))
    met = repeated.join(wanted.select(*group, "as_of").distinct(), [*group, "as_of"], "left_semi").groupBy(*group, "as_of", "_v").agg(F.sum("_c").alias("_c"))
    end = F.sum("_c").over(Window.partitionBy(*group, "as_of").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = met.withColumn("_end", end).join(wanted, [*group, "as_of"]).where((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_c")))
    return picked.groupBy(*key, "as_of", "n").agg(F.avg("_v").alias("median"))


def median_of(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, n, median of each group's values; a group is sorted, not gathered. Null values are left out."""
    of_group = Window.partitionBy(*group)
    placed = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    placed = placed.withColumns({"_p": F.row_number().over(of_group.orderBy("_v")) - 1, "n": F.count("*").over(of_group)})
    low, high = _middle(F.col("n"))
    return placed.where((F.col("_p") == low) | (F.col("_p") == high)).groupBy(*group, "n").agg(F.avg("_v").alias("median"))
