"""Estimates for the queries over them: computed once a query and kept, as they are as many as days, places and items allow, whatever the observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricewell.operators import windows
from pricewell.sources.adapters import uses, with_views
from pricewell.sources.scratch import stored

# Fixed values of the view v_windowed: days before, and days in which a weight halves.
WINDOW, HALF_LIFE = 7, 3.0
#: Draws of ``d14_basket_interval``.
DRAWS = 20


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that count, with the reporter's part of their weight; as v_windowed, without its days."""
    sql = """SELECT o.location_id, o.item, o.observed_on, o.unit_price, greatest(0.25e0, greatest(0.0e0,
            r.alpha / (r.alpha + r.beta) - sqrt(r.alpha * r.beta / ((r.alpha + r.beta) * (r.alpha + r.beta) * (r.alpha + r.beta + 1.0e0))))) AS factor
        FROM v_obs o JOIN v_reporters r ON r.reporter_id = o.reporter_id WHERE o.is_valid AND o.unit_price > 0"""
    return spark.sql(with_views(sql, True, sf_dir))


def kept(spark: SparkSession, sf_dir: str, lowest: int = 0) -> dict[str, str]:
    """Where v_estimates is stored, for ``with_views``; lowest: as of ``weighted_medians``."""
    days = spark.sql(with_views("SELECT as_of FROM v_days", True, sf_dir))
    cells = windows.weighted_medians(weighed(spark, sf_dir), WINDOW, HALF_LIFE, lowest).join(days, "as_of", "left_semi")
    return {"v_estimates": stored(cells if lowest else cells.drop("lowest"), "estimates").stored_at}


def query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """The SQL as a query; what reads estimates finds them stored."""
    if not uses(sql, "v_estimates"):
        return lambda spark, sf_dir: spark.sql(with_views(sql, True, sf_dir))
    return lambda spark, sf_dir: spark.sql(with_views(sql, True, sf_dir, kept(spark, sf_dir)))


def basket_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``d14_basket_interval``: a draw takes a window's price at the draw's place, so the lowest ``DRAWS`` prices of each window are all it reads."""
    sql = f"""SELECT as_of, location_id, R4(Q(total, 0.025)) AS lo, R4(Q(total, 0.975)) AS hi FROM (
        SELECT f.as_of, f.location_id, k.draw, sum(f.quantity * CASE WHEN e.n IS NOT NULL THEN element_at(e.lowest, cast(k.draw % e.n AS int) + 1) ELSE f.price * (CASE k.draw % 3 WHEN 0 THEN 0.7e0 WHEN 1 THEN 1.0e0 ELSE 1.3e0 END) END) AS total
        FROM v_filled f LEFT JOIN v_estimates e ON e.as_of = f.as_of AND e.location_id = f.location_id AND e.item = f.item CROSS JOIN (SELECT draw FROM NUMBERS({DRAWS})) k
        WHERE f.price IS NOT NULL GROUP BY f.as_of, f.location_id, k.draw) x GROUP BY as_of, location_id"""
    return spark.sql(with_views(sql, True, sf_dir, kept(spark, sf_dir, DRAWS)))


#: Queries whose SQL is only the check.
PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"d14_basket_interval": basket_interval}
