"""Weighted-median estimates and as-of rates as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lower_bound(alpha: Column, beta: Column) -> Column:
    """Mean less one deviation of a Beta posterior, 0 at least."""
    n = alpha + beta
    return F.greatest(F.lit(0.0), alpha / n - F.sqrt(alpha * beta / (n * n * (n + 1.0))))


def recency(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age / F.lit(half_life)) if half_life > 0 else F.lit(1.0)


def as_of_days(observations: DataFrame, days: DataFrame, window: int) -> DataFrame:
    """Each observation once for every day that sees it (window + 1 days): an equi-join, where a range join would compare all pairs.

    days: as_of; it is a calendar, so its size doesn't follow the observations'.
    """
    seen = F.explode(F.sequence("observed_on", F.date_add("observed_on", window)))
    return observations.withColumn("as_of", seen).join(days, "as_of")


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str, ties: list[str]) -> DataFrame:
    """keys, n, value: the first value whose cumulative weight passes half; at half exactly the middle of it and the next.

    Rows whose weight or value isn't positive are left out. One shuffle on the
    keys serves all window functions and the final minimum.
    """
    rows = rows.where((F.col(weight) > 0) & (F.col(value) > 0))
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(value, *ties)
    running = F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select(*keys, value, F.sum(weight).over(group).alias("total"), running.alias("cumulative"), F.lead(value).over(ordered).alias("following"))
    half = F.col("total") / 2.0
    pick = F.when(F.abs(F.col("cumulative") - half) <= 1e-12, (F.col(value) + F.coalesce("following", value)) / 2.0).when(F.col("cumulative") > half, F.col(value))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(pick).alias("value"))


def as_of(days: DataFrame, rates: DataFrame, tolerance: int) -> DataFrame:
    """For each day the newest rate of that day or the tolerance before it, and whether it is older than the day.

    Rates are repeated for the days they serve and joined by equality.
    """
    served = rates.withColumn("as_of", F.explode(F.sequence("rate_date", F.date_add("rate_date", tolerance))))
    newest = served.groupBy("as_of").agg(F.max_by(F.struct("rate_date", "rate"), "rate_date").alias("r"))
    out = days.join(newest, "as_of", "left")
    return out.select("as_of", F.col("r.rate_date").alias("rate_date"), F.col("r.rate").alias("rate"), (F.col("r.rate_date") < F.col("as_of")).alias("is_stale"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("observed_on"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), "l_returnflag")
    parts, suppliers = read("part").select("p_partkey", F.col("p_type").alias("item")), read("supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    return rows.select(F.col("s_nationkey").cast("bigint").alias("location_id"), "item", F.col("l_suppkey").cast("bigint").alias("reporter_id"), "observed_on", "unit_price", (F.col("l_returnflag") != "R").alias("is_valid"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted-median estimate per shipping day, location and item, over the trailing 7 days."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    count = lambda flag: F.sum((F.col("l_returnflag") == flag).cast("int")) + 2.0
    reporters = lines.groupBy(F.col("l_suppkey").cast("bigint").alias("reporter_id")).agg(count("A").alias("alpha"), count("R").alias("beta"))
    days = lines.select(F.col("l_shipdate").cast("date").alias("as_of")).distinct()
    seen = _observations(spark, sf_dir).where("is_valid")
    rows = as_of_days(seen, days, 7).join(reporters, "reporter_id")
    weight = recency(F.datediff("as_of", "observed_on"), 3.0) * F.greatest(F.lit(0.25), lower_bound(F.col("alpha"), F.col("beta")))
    out = weighted_median(rows.withColumn("weight", weight), ["as_of", "location_id", "item"], "unit_price", "weight", ["observed_on", "reporter_id", "weight"])
    return out.select("as_of", "location_id", "item", "n", "value")


def fx_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricewell.sources.adapters import with_views

    rates = spark.sql(with_views("SELECT rate_date, rate FROM v_rates", True, sf_dir))
    days = spark.sql(with_views("SELECT as_of FROM v_days", True, sf_dir))
    return as_of(days, rates, 7).withColumn("rate", F.floor(F.col("rate") * 1e4 + 0.5001) / 1e4)


FRAMES = {
    "flagship": (flagship, "SELECT as_of, location_id, item, n, value FROM v_estimates"),
    "c4_fx_as_of": (
        fx_as_of,
        """SELECT as_of, rate_date, R4(rate) AS rate, rate_date < as_of AS is_stale FROM (
            SELECT d.as_of, r.rate_date, r.rate, row_number() OVER (PARTITION BY d.as_of ORDER BY r.rate_date DESC) AS k
            FROM v_days d LEFT JOIN v_rates r ON r.rate_date BETWEEN d.as_of - 7 AND d.as_of) x
        WHERE k = 1""",
    ),
}
