"""The index over three basket versions, with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators.chaining import Basket, chain
from pricewell.sources.adapters import with_views
from pricewell.sources.scratch import stored


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(with_views(sql, True, sf_dir))


def linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Anchors of three versions: the two baskets, and from the calendar's last third on a third one, which takes twice the first's quantities less the second's, at least one."""
    first, last = _view(spark, sf_dir, "SELECT min(as_of) AS a, max(as_of) AS b FROM v_days").first()
    third = (last - first) / 3
    baskets = [Basket(1, first), Basket(2, first + third), Basket(3, first + 2 * third)]
    prices = stored(_view(spark, sf_dir, "SELECT DISTINCT as_of, location_id, item, price FROM v_filled"), "prices")
    items = _view(spark, sf_dir, "SELECT version, item, quantity FROM v_basket_items")
    both = items.where("version = 1").join(items.where("version = 2").select("item", F.col("quantity").alias("_q")), "item")
    items = F.broadcast(items.unionByName(both.select(F.lit(3).alias("version"), "item", F.greatest(F.lit(1.0), 2 * F.col("quantity") - F.col("_q")).alias("quantity"))))  # a basket

    def cost(version: int, cells: DataFrame) -> DataFrame:
        wanted = cells.crossJoin(items.where(F.col("version") == version).drop("version"))  # a basket's items
        rows = wanted.join(prices, ["as_of", "location_id", "item"], "left")
        return rows.groupBy("location_id", "as_of").agg(F.sum(F.col("quantity") * F.col("price")).alias("cost"), (F.count("price") == F.count("*")).alias("is_complete"))

    seen = _view(spark, sf_dir, "SELECT location_id, min(observed_on) AS first FROM v_obs WHERE is_valid GROUP BY location_id")
    return chain(baskets, _view(spark, sf_dir, "SELECT location_id FROM v_locations"), cost, seen)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r4 = lambda c, d=1e4: (F.floor(F.col(c) * d + 0.5001) / d).alias(c)
    return linked(spark, sf_dir)[0].select("location_id", "version", "link_date", r4("reference_cost", 1e2), r4("link_factor"), "method")


_SQL = """
WITH span AS (SELECT min(as_of) AS a, max(as_of) AS b FROM v_days),
dates AS (SELECT 1 AS version, a AS d FROM span UNION ALL SELECT 2, CAST(a + to_microseconds(((b - a) * 86400000000) // 3) AS DATE) FROM span UNION ALL SELECT 3, CAST(a + to_microseconds(((b - a) * 86400000000) // 3 * 2) AS DATE) FROM span),
items AS (SELECT version, item, quantity FROM v_basket_items UNION ALL SELECT 3, x.item, greatest(1, 2 * x.quantity - y.quantity) FROM v_basket_items x JOIN v_basket_items y ON y.item = x.item WHERE x.version = 1 AND y.version = 2),
prices AS MATERIALIZED (SELECT DISTINCT as_of, location_id, item, price FROM v_filled),
costs AS MATERIALIZED (
    SELECT p.as_of, p.location_id, i.version, sum(i.quantity * p.price) AS cost FROM prices p JOIN items i ON i.item = p.item
    GROUP BY ALL HAVING count(p.price) = (SELECT count(DISTINCT item) FROM items)),
base AS (
    SELECT l.location_id, min(c.as_of) AS d, arg_min(c.cost, c.as_of) AS cost FROM v_locations l JOIN (SELECT location_id, min(observed_on) AS first FROM v_obs WHERE is_valid GROUP BY location_id) f ON f.location_id = l.location_id
    JOIN costs c ON c.location_id = l.location_id AND c.version = 1 AND c.as_of BETWEEN f.first AND f.first + 45 GROUP BY l.location_id),
two AS (SELECT l.location_id, b.cost AS reference, n.cost / o.cost AS own FROM v_locations l LEFT JOIN base b USING (location_id)
    LEFT JOIN costs o ON o.location_id = l.location_id AND o.version = 1 AND o.as_of = (SELECT d - 1 FROM dates WHERE version = 2) LEFT JOIN costs n ON n.location_id = l.location_id AND n.version = 2 AND n.as_of = (SELECT d - 1 FROM dates WHERE version = 2)),
second AS (SELECT location_id, coalesce(own, m) AS factor, round(reference * coalesce(own, m), 4) AS reference, own IS NOT NULL AS mine FROM two, (SELECT quantile_cont(own, 0.5) AS m FROM two WHERE reference IS NOT NULL) q WHERE reference IS NOT NULL AND coalesce(own, m) IS NOT NULL),
three AS (SELECT l.location_id, b.reference, n.cost / o.cost AS own FROM v_locations l LEFT JOIN second b USING (location_id)
    LEFT JOIN costs o ON o.location_id = l.location_id AND o.version = 2 AND o.as_of = (SELECT d - 1 FROM dates WHERE version = 3) LEFT JOIN costs n ON n.location_id = l.location_id AND n.version = 3 AND n.as_of = (SELECT d - 1 FROM dates WHERE version = 3)),
last AS (SELECT location_id, coalesce(own, m) AS factor, round(reference * coalesce(own, m), 4) AS reference, own IS NOT NULL AS mine FROM three, (SELECT quantile_cont(own, 0.5) AS m FROM three WHERE reference IS NOT NULL) q WHERE reference IS NOT NULL AND coalesce(own, m) IS NOT NULL),
found AS (
    SELECT location_id, 1 AS version, d AS link_date, cost AS reference_cost, NULL::DOUBLE AS link_factor, 'base_period' AS method FROM base
    UNION ALL SELECT location_id, 2, (SELECT d - 1 FROM dates WHERE version = 2), reference, round(factor, 6), CASE WHEN mine THEN 'chained' ELSE 'chained_country_fallback' END FROM second
    UNION ALL SELECT location_id, 3, (SELECT d - 1 FROM dates WHERE version = 3), reference, round(factor, 6), CASE WHEN mine THEN 'chained' ELSE 'chained_country_fallback' END FROM last)
SELECT location_id, version, link_date, floor(reference_cost * 1e2 + 0.5001e0) / 1e2 AS reference_cost, floor(link_factor * 1e4 + 0.5001e0) / 1e4 AS link_factor, method FROM found"""

FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {"i36_chain_versions": (anchors, f"SELECT * FROM ({_SQL}) q")}
