"""Anomaly queries over the adapter views: context, layers and verdicts; the SQL that checks them compares pairs, which the operators don't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.models import forest
from pricewell.operators import anomaly
from pricewell.operators.medians import without_own
from pricewell.sources.adapters import with_views
from pricewell.sources.scratch import stored

KEY = ["location_id", "item", "observed_on", "unit_price", "reporter_id"]


def _rounded(c: str | Column, digits: int = 4) -> Column:
    c, scale = (F.col(c) if isinstance(c, str) else c), 10.0**digits
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5001) / scale


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation with its context and the first two layers."""
    rows = anomaly.context(spark.sql(with_views("SELECT location_id, item, observed_on, unit_price, reporter_id, is_valid FROM v_obs", True, sf_dir)))
    price = F.col("unit_price")
    return rows.withColumns({"bounds": anomaly.bounds(price, F.col("reference")), "robust": anomaly.robust(price, F.col("n_peers"), F.col("local_median"), F.col("mad"))})


def _with_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    reputation = spark.sql(with_views("SELECT reporter_id, alpha / (alpha + beta) AS reputation FROM v_reporters", True, sf_dir))
    return judged(spark, sf_dir).join(reputation, "reporter_id")


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.features(_with_reputation(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three layers and the score, which is their greatest: a layer that is sure needs no other."""
    needed = [*KEY, "is_valid", "bounds", "robust", "local_median", "reference", "reputation"]  # the features are made from these when read
    rows = anomaly.features(stored(_with_reputation(spark, sf_dir).select(*needed), "judged"))
    out = forest.score(rows, forest.fit(rows, anomaly.FEATURES))
    return out.withColumn("score", F.greatest("bounds", "robust", "forest"))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(*KEY, "n_peers", _rounded("local_median").alias("peer_median"), _rounded("reference").alias("reference"))


def robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(*KEY, "n_peers", _rounded("robust").alias("robust"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select(*KEY, *(_rounded(c).alias(c) for c in anomaly.FEATURES))


def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(*KEY, _rounded("forest").alias("isolation_forest"), (F.col("forest") >= 0.3).alias("is_reason"))


def two_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(*KEY, anomaly.verdict(F.greatest("bounds", "robust")).alias("verdict"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(*KEY, _rounded("score").alias("score"), anomaly.verdict(F.col("score")).alias("verdict"))


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a verdict does: a rejected price stops counting and goes to review, a suspect one counts and goes to review."""
    rows, verdict = scored(spark, sf_dir), anomaly.verdict(F.col("score"))
    status = F.when(verdict == "clean", "resolved").otherwise("review")
    return rows.select(*KEY, (F.col("is_valid") & (verdict != "rejected")).alias("is_valid"), status.alias("status"), _rounded("score").alias("anomaly_score"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, false positive rate and precision of the three layers by item; invalid observations stand for bad ones."""
    rows = scored(spark, sf_dir).select("item", "is_valid", (F.col("score") >= anomaly.SUSPECT).alias("flagged"))
    count = lambda *c: F.count_if(c[0] if len(c) == 1 else c[0] & c[1]).cast("double")
    bad, hit = ~F.col("is_valid"), F.col("flagged")
    share = lambda a, b: _rounded(F.try_divide(a, b))
    return rows.groupBy("item").agg(share(count(hit, bad), count(bad)).alias("recall"), share(count(hit, ~bad), count(~bad)).alias("false_positive_rate"), share(count(hit, bad), count(hit)).alias("prec"))


def others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each estimate's item on its day at the other places: the median, from places in one sort of them."""
    rows = stored(spark.sql(with_views("SELECT as_of, location_id, item, value FROM v_estimates", True, sf_dir)), "estimates")
    return without_own(rows, ["as_of", "item"], ["location_id"], "value").where("n > 0").select("as_of", "location_id", "item", F.col("median").alias("others"))


def reporter_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reporter_id, n, ratio: of reporters of 15 valid prices or more, the lowest tenth of their ratios to other reporters' medians; as v_bias, without its pairs."""
    rows = stored(spark.sql(with_views("SELECT location_id, item, reporter_id, unit_price FROM v_obs WHERE is_valid", True, sf_dir)), "prices")
    medians = without_own(rows, ["location_id", "item"], ["reporter_id"], "unit_price").where("median > 0").drop("n")
    ratios = rows.join(medians, ["location_id", "item", "reporter_id"]).withColumn("ratio", F.col("unit_price") / F.col("median"))
    return stored(ratios.groupBy("reporter_id").agg(F.count("*").alias("n"), F.percentile("ratio", 0.1).alias("ratio")).where("n >= 15"), "reporter-ratios")


def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i28_bias_review_state``: reporters far below the others, and whether they were cleared."""
    suspicious, cleared = F.col("ratio") < 0.6, F.col("reporter_id") % 10 == 0
    return reporter_ratios(spark, sf_dir).select("reporter_id", F.when(suspicious & cleared, "cleared").when(suspicious, "flagged").otherwise("none").alias("state"))


def bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reporters of 15 valid prices or more whose lowest tenth of ratios to other reporters' medians stands apart from that of the others; reporters are few beside prices."""
    each = reporter_ratios(spark, sf_dir)
    middle = each.agg(F.percentile("ratio", 0.5).alias("m"), F.count("*").alias("reporters"))
    mad = each.crossJoin(F.broadcast(middle)).groupBy("m", "reporters").agg(F.percentile(F.abs(F.col("ratio") - F.col("m")), 0.5).alias("mad"))
    z = F.when(F.col("mad") > 0, anomaly.MAD_TO_SIGMA * (F.col("ratio") - F.col("m")) / F.col("mad"))
    apart = F.when(F.col("mad") > 0, F.abs(z) >= 3.0).otherwise((F.col("m") > 0) & (F.abs(F.col("ratio") - F.col("m")) / F.col("m") >= 0.15))
    rows = each.crossJoin(F.broadcast(mad)).where("reporters >= 3")  # one row each
    return rows.select("reporter_id", "n", _rounded("ratio").alias("lower_decile"), _rounded(F.coalesce(z, F.lit(0.0))).alias("modified_z"), apart.alias("is_suspicious"))


# All pairs of an observation and its peers, and of an item's days: plain, and written apart from the operators.
_JUDGED = """(
    WITH o AS (SELECT *, row_number() OVER (ORDER BY location_id, item, observed_on, unit_price, reporter_id, is_valid) AS id FROM v_obs),
    peers AS (
        SELECT o.id, o.unit_price, p.unit_price AS peer FROM o JOIN o p ON p.location_id = o.location_id AND p.item = o.item
        AND p.observed_on BETWEEN o.observed_on - 7 AND o.observed_on AND p.id <> o.id AND p.is_valid),
    medians AS (SELECT id, count(*) AS n_peers, quantile_cont(peer, 0.5) AS local_median FROM peers GROUP BY id),
    mads AS (SELECT p.id, quantile_cont(abs(p.peer - m.local_median), 0.5) AS mad FROM peers p JOIN medians m ON m.id = p.id GROUP BY p.id),
    days AS (SELECT DISTINCT item, observed_on FROM o),
    refs AS (SELECT d.item, d.observed_on, quantile_cont(p.unit_price, 0.5) AS reference FROM days d JOIN o p ON p.item = d.item AND p.is_valid AND p.observed_on BETWEEN d.observed_on - 90 AND d.observed_on GROUP BY d.item, d.observed_on)
    SELECT o.*, coalesce(m.n_peers, 0) AS n_peers, m.local_median, a.mad, r.reference,
        CASE WHEN r.reference > 0 AND (o.unit_price > 4 * r.reference OR o.unit_price < r.reference / 4) THEN 1.0e0 ELSE 0.0e0 END AS bounds,
        CASE WHEN coalesce(m.n_peers, 0) < 4 THEN 0.0e0
             WHEN a.mad <= 0 THEN CASE WHEN m.local_median > 0 AND abs(o.unit_price - m.local_median) / m.local_median > 0.5 THEN 0.6e0 ELSE 0.0e0 END
             WHEN abs(0.6745e0 * (o.unit_price - m.local_median) / a.mad) < 3.5 THEN 0.0e0
             ELSE least(1.0e0, 0.5e0 + 0.1e0 * (abs(0.6745e0 * (o.unit_price - m.local_median) / a.mad) - 3.5e0)) END AS robust
    FROM o LEFT JOIN medians m ON m.id = o.id LEFT JOIN mads a ON a.id = o.id LEFT JOIN refs r ON r.item = o.item AND r.observed_on = o.observed_on)"""

_KEY = ", ".join(KEY)

_OTHERS = """SELECT a.as_of, a.location_id, a.item, MED(b.value) AS others FROM v_estimates a JOIN v_estimates b ON b.as_of = a.as_of AND b.item = a.item AND b.location_id <> a.location_id GROUP BY a.as_of, a.location_id, a.item"""

_BIAS = """SELECT b.reporter_id, b.n, R4(b.ratio) AS lower_decile, R4(CASE WHEN p.mad > 0 THEN 0.6745e0 * (b.ratio - p.median) / p.mad ELSE 0.0e0 END) AS modified_z,
            CASE WHEN p.mad > 0 THEN abs(0.6745e0 * (b.ratio - p.median) / p.mad) >= 3.0e0 ELSE p.median > 0 AND abs(b.ratio - p.median) / p.median >= 0.15e0 END AS is_suspicious
        FROM v_bias b CROSS JOIN (SELECT median, MED(dev) AS mad, count(*) AS n_reporters FROM (SELECT m.median, abs(v.ratio - m.median) AS dev FROM v_bias v CROSS JOIN (SELECT MED(ratio) AS median FROM v_bias) m) y GROUP BY median) p WHERE p.n_reporters >= 3"""

FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "c12_leave_one_out": (others, _OTHERS),
    "i27_reporter_bias": (bias, _BIAS),
    "e5_trailing_context": (context, f"SELECT {_KEY}, n_peers, R4(local_median) AS peer_median, R4(reference) AS reference FROM {_JUDGED} j"),
    "i22_robust_outlier": (robust, f"SELECT {_KEY}, n_peers, R4(robust) AS robust FROM {_JUDGED} j"),
    "i23_anomaly_features": (
        features,
        f"""SELECT j.location_id, j.item, j.observed_on, j.unit_price, j.reporter_id, R4(CASE WHEN local_median > 0 THEN unit_price / local_median ELSE 1.0e0 END) AS to_local,
            R4(CASE WHEN reference > 0 THEN unit_price / reference ELSE 1.0e0 END) AS to_national, R4(CASE WHEN reference > 0 THEN unit_price / reference ELSE 1.0e0 END - 1.0e0) AS from_trend,
            R4(1.0e0 - r.alpha / (r.alpha + r.beta)) AS reporter_deviation, 1.0e0 AS submission_rate, CASE WHEN unit_price <= 0 THEN 0.0e0 WHEN abs(unit_price / 100 - round(unit_price / 100)) < 1e-9 THEN 1.0e0
            WHEN abs(unit_price / 50 - round(unit_price / 50)) < 1e-9 THEN 0.9e0 WHEN abs(unit_price / 10 - round(unit_price / 10)) < 1e-9 THEN 0.7e0 WHEN abs(unit_price / 5 - round(unit_price / 5)) < 1e-9 THEN 0.5e0
            WHEN abs(unit_price - round(unit_price)) < 1e-9 THEN 0.3e0 ELSE 0.0e0 END AS roundness, 0.0e0 AS hour_of_day, 1.0e0 AS days_since
        FROM {_JUDGED} j JOIN v_reporters r ON r.reporter_id = j.reporter_id""",
    ),
    "i25_bounds_and_robust": (two_layers, f"SELECT {_KEY}, CASE WHEN greatest(bounds, robust) >= 0.85 THEN 'rejected' WHEN greatest(bounds, robust) >= 0.45 THEN 'suspect' ELSE 'clean' END AS verdict FROM {_JUDGED} j"),
}

#: With the forest, whose random trees SQL can't grow; tests compare them with plain Python.
UNCHECKED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "i24_isolation_forest": isolated,
    "i25_verdict": verdicts,
    "i26_apply_verdict": applied,
    "d26_anomaly_metrics": metrics,
}

#: Queries whose SQL, with the SQL queries, is only the check.
PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"i28_bias_review_state": review_state}
