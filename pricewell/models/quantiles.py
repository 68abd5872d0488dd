"""Exact quantiles of one column, in a few passes that each bring a bounded histogram to the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a pass, and passes; each pass looks at one or two bins of the one before.
BINS, PASSES = 4096, 12


def exact_quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The quantile at share (0 to 1) of the column's values, interpolated between neighbours; None without values.

    rows are read once a pass, so a stored table is wanted. Nulls and NaN are left out.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    place = share * (n - 1)
    first, second = math.floor(place), math.ceil(place)
    a = b = None
    before = 0
    for _ in range(PASSES):
        if low == high:
            a = b = low
            break
        inside = values.where(F.col("v").between(low, high))
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") - low) / F.lit((high - low) / BINS))).cast("int")
        held = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()
        ends, at = [], before
        for r in held:
            for rank in (first, second):
                if at <= rank < at + r["n"]:
                    ends.append((r, at))
            at += r["n"]
        (one, start), (other, _) = ends[0], ends[-1]
        if one is not other or one["low"] == one["high"]:  # neighbours on both sides of a bin's end, or one value
            a, b = one["high"], other["low"]
            break
        low, high, before = one["low"], one["high"], start
    else:
        raise ArithmeticError(f"{column} has values too close to tell apart")
    return a + (b - a) * (place - first)
