"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.shared import released, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) of every node that has a link to another.

    Each round links nodes to smaller ones by grouped minima, which are summed
    before the shuffle, and is written to the shared folder; the number of rounds
    is logarithmic in a component's size. Links hold longs.
    """
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    edges = links.where(F.col(a) != F.col(b)).select(pair(F.col(a), F.col(b)).alias("p")).select("p.*").distinct()
    edges = stored(edges, "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, stored(small.where("u != v").distinct(), "links")
        released(before)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % F.lit(1 << 30)), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
