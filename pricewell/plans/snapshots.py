"""Stored snapshots: the index's figures are computed once a day and place, and views read them from the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewell.sources.adapters import with_views
from pricewell.sources.keyed_store import KeyedStore
from pricewell.sources.scratch import stored

TABLES = {
    "snapshots": "SELECT as_of, location_id, version, cost_local, coverage_pct, imputed_share FROM v_snapshots",
    "snapshot_items": "SELECT as_of, location_id, version, item, quantity, price, is_imputed, n FROM v_filled",
}


def _table(spark: SparkSession, store: str, name: str) -> KeyedStore:
    return KeyedStore(spark, f"{store}/{name}", "month")


def replace(rows: DataFrame, store: str, name: str, keys: tuple[str, ...] = ("as_of",)) -> int:
    """Puts rows in the place of stored ones with the same keys: whole days, or with (as_of, location_id, version) single snapshots or their items alone.

    Readers see the state before or after. The version of the new state.
    """
    return _table(rows.sparkSession, store, name).replace(rows.withColumn("month", F.date_format("as_of", "yyyy-MM")), list(keys))


def publish(spark: SparkSession, sf_dir: str, store: str, since: str | None = None, until: str | None = None) -> None:
    """Computes the snapshots and their items of all days, or of the months from ``since`` to ``until`` (yyyy-MM), and stores them; items first, so no snapshot is without its own."""
    for name in ("snapshot_items", "snapshots"):
        rows, month = spark.sql(with_views(TABLES[name], True, sf_dir)), F.date_format("as_of", "yyyy-MM")
        rows = rows.where(month >= since) if since else rows
        replace(stored(rows.where(month <= until) if until else rows, name), store, name)


def read(spark: SparkSession, store: str, name: str = "snapshots", since: str | None = None) -> DataFrame:
    """The newest state, or its months from ``since`` (yyyy-MM) on, whose folders alone are opened."""
    rows = _table(spark, store, name).read(wanted=lambda month: since is None or month >= since)
    if rows is None:
        raise FileNotFoundError(f"no {name} in {store}")
    return rows.drop("month")


def latest_per_location(snapshots: DataFrame) -> DataFrame:
    """location_id, as_of, version, cost_local of each place's newest day, of its highest basket version."""
    newest = F.max(F.struct("as_of", "version", "cost_local"))
    return snapshots.groupBy("location_id").agg(newest.alias("s")).select("location_id", "s.*")


def national_series(snapshots: DataFrame, days: int = 90) -> DataFrame:
    """as_of, n, median_cost over complete snapshots of the newest ``days`` days."""
    last = snapshots.agg(F.max("as_of").alias("last"))
    rows = snapshots.join(F.broadcast(last), F.col("as_of") >= F.date_add("last", -days))  # one row
    return rows.where("coverage_pct >= 1").groupBy("as_of").agg(F.count("*").alias("n"), F.percentile("cost_local", 0.5).alias("median_cost"))


def export(snapshots: DataFrame, locations: DataFrame, path: str, tags: dict[str, str] | None = None) -> None:
    """One CSV file, a row a place and day by the highest basket version; tags: a row of column tags under the header."""
    newest = Window.partitionBy("as_of", "location_id").orderBy(F.desc("version"))
    rows = snapshots.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k").join(locations.select("location_id", "name"), "location_id")
    rows = rows.select("as_of", "location_id", "name", "version", "cost_local", "coverage_pct", "imputed_share")
    texts = rows.select(F.lit(1).alias("_row"), *(F.col(c).cast("string") for c in rows.columns))
    if tags:
        texts = texts.unionByName(rows.sparkSession.range(1).select(F.lit(0).alias("_row"), *(F.lit(tags.get(c, "")).alias(c) for c in rows.columns)))
    texts.coalesce(1).sortWithinPartitions("_row", "as_of", "location_id").drop("_row").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
