"""Queries as SQL over the adapter views, named by the inventory's operator ids."""

from __future__ import annotations

SQL: dict[str, str] = {
    # -- filters and scalars
    "b1_valid_filter": "SELECT item, count(*) AS n FROM v_obs WHERE is_valid GROUP BY item",
    "b2_date_window": "SELECT location_id, item, count(*) AS n, min(unit_price) AS lowest, max(unit_price) AS highest FROM v_obs WHERE is_valid AND observed_on BETWEEN date '1998-03-08' AND date '1998-03-15' GROUP BY location_id, item",
    "b4_price_per_base_unit": "SELECT item, location_id, max(CASE WHEN quantity > 0 THEN price / (quantity * 0.001e0) END) AS highest, count(CASE WHEN quantity > 0 THEN 1 END) AS n FROM v_obs GROUP BY item, location_id",
    "b6_recency_weight": "SELECT DISTINCT as_of, observed_on, R6(pow(2.0e0, -DAYS(as_of, observed_on) / 3.0e0)) AS weight FROM v_windowed",
    "b8_reporter_posterior": """SELECT reporter_id, alpha, beta, alpha / (alpha + beta) AS mean, sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1.0e0))) AS deviation,
        greatest(0.25e0, alpha / (alpha + beta) - sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1.0e0)))) AS weight FROM v_reporters""",
    "b9_reputation_update": "SELECT cast(l_suppkey AS bigint) AS reporter_id, 2 + sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS alpha, 2 + sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS beta FROM lineitem GROUP BY l_suppkey",
    "b10_rate_for": "SELECT rate_date, is_manual, R4(coalesce(official_rate, parallel_rate)) AS official_first, R4(coalesce(parallel_rate, official_rate)) AS parallel_first FROM v_fx",
    "b11_parallel_premium": "SELECT rate_date, is_manual, CASE WHEN official_rate > 0 THEN R4((parallel_rate - official_rate) / official_rate) END AS premium FROM v_fx",
    "b12_quality_label": """SELECT as_of, location_id, CASE WHEN coverage_pct < 0.5 THEN 'low' WHEN greatest(0.0e0, 1.0e0 - coverage_pct - imputed_share) > 0.001 THEN 'moderate' WHEN imputed_share > 0.1 THEN 'moderate' ELSE 'good' END AS quality FROM v_snapshots""",
    "b13_comparable": "SELECT as_of, location_id, coverage_pct + imputed_share >= 0.999 AS comparable, R4(greatest(0.0e0, 1.0e0 - coverage_pct - imputed_share)) AS missing_share FROM v_snapshots",
    "b15_haversine": """SELECT a.location_id AS a, b.location_id AS b, R2(2 * 6371.0088e0 * asin(least(1.0e0, sqrt(
        pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))) AS km
        FROM v_locations a JOIN v_locations b ON a.admin1_id = b.admin1_id AND a.location_id < b.location_id""",
    "b17_intensity": """SELECT as_of, location_id, CASE WHEN hi > lo THEN R4((cost_local - lo) / (hi - lo)) END AS intensity
        FROM (SELECT *, min(cost_local) OVER (PARTITION BY as_of) AS lo, max(cost_local) OVER (PARTITION BY as_of) AS hi FROM v_snapshots WHERE coverage_pct + imputed_share >= 0.999) x""",
    "b18_roundness": """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_extendedprice % 100 = 0 THEN 1.0e0 WHEN l_extendedprice % 50 = 0 THEN 0.9e0 WHEN l_extendedprice % 10 = 0 THEN 0.7e0
        WHEN l_extendedprice % 5 = 0 THEN 0.5e0 WHEN l_extendedprice % 1 = 0 THEN 0.3e0 ELSE 0.0e0 END AS roundness FROM lineitem""",
    "b29_sync_lag": "SELECT submission_id, ((submission_id * 7919) % 5760) * 60 AS lag_seconds, (submission_id * 7919) % 5760 > 2880 AS is_late FROM v_submissions",
    "b33_contribution": "SELECT as_of, location_id, item, R4(quantity * price) AS contribution FROM v_filled WHERE price IS NOT NULL",
    "b37_bbox": "SELECT l.location_id FROM v_locations l CROSS JOIN (SELECT min(latitude) - 4 AS a, max(latitude) + 4 AS b, min(longitude) - 4 AS c, max(longitude) + 4 AS d FROM v_locations WHERE admin1_id = 1) x WHERE l.latitude BETWEEN a AND b AND l.longitude BETWEEN c AND d",
    # -- joins
    "c1_equi_inner": "SELECT b.version, b.item, v.effective_from, b.weight, b.quantity FROM v_basket_items b JOIN v_baskets v ON v.version = b.version",
    "c2_left_dims": "SELECT s.as_of, s.location_id, l.name, s.cost_local FROM v_snapshots s LEFT JOIN v_locations l ON l.location_id = s.location_id",
    "c3_window_join": "SELECT as_of, location_id, item, count(*) AS n, count(DISTINCT reporter_id) AS reporters FROM v_windowed GROUP BY as_of, location_id, item",
    "c5_last_local": """SELECT location_id, item, observed_on, previous_on, coalesce(DAYS(observed_on, previous_on), 60) AS age FROM (
        SELECT location_id, item, observed_on, lag(observed_on) OVER (PARTITION BY location_id, item ORDER BY observed_on) AS previous_on
        FROM (SELECT DISTINCT location_id, item, observed_on FROM v_obs WHERE is_valid) d) x""",
    "c6_effective_basket": "SELECT d.as_of, max(v.version) AS version FROM v_days d JOIN v_baskets v ON d.as_of BETWEEN v.effective_from AND coalesce(v.effective_to, date '9999-12-31') GROUP BY d.as_of",
    "c7_left_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "c8_left_semi": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM v_obs WHERE reporter_id = s_suppkey AND NOT is_valid AND quantity > 49)",
    "c9_duplicate_count": "SELECT event_id, count(*) OVER (PARTITION BY event_type, props) AS duplicate_count FROM events",
    "c10_newest_weight": "SELECT item, weight FROM (SELECT item, weight, row_number() OVER (PARTITION BY item ORDER BY version DESC) AS k FROM v_basket_items) x WHERE k = 1",
    "c11_nearest_locations": """SELECT a, b, R2(km) AS km, cast(k AS bigint) AS k FROM (SELECT a, b, km, row_number() OVER (PARTITION BY a ORDER BY km, b) AS k FROM (
        SELECT a.location_id AS a, b.location_id AS b, 2 * 6371.0088e0 * asin(least(1.0e0, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2)
            + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) AS km
        FROM v_locations a JOIN v_locations b ON a.location_id <> b.location_id) d) x WHERE k <= 5""",
    "c13_grid": "SELECT d.as_of, l.location_id, b.item FROM v_days d CROSS JOIN v_locations l CROSS JOIN (SELECT DISTINCT item FROM v_basket_items) b",
    "c19_anchor_lookup": """SELECT s.as_of, s.location_id, a.cost_local AS anchor, CASE WHEN a.cost_local > 0 THEN R4(100 * s.cost_local / a.cost_local) END AS index_level
        FROM v_snapshots s LEFT JOIN v_snapshots a ON a.location_id = s.location_id AND a.version = s.version AND a.as_of = CASE WHEN s.version = 1 THEN date '1998-03-01' ELSE date '1998-03-16' END""",
    # -- aggregates
    "d2_median": "SELECT MED(unit_price) AS median FROM v_obs WHERE is_valid",
    "d3_grouped_median": "SELECT location_id, item, MED(unit_price) AS median FROM v_obs WHERE is_valid GROUP BY location_id, item",
    "d5_basket_cost": "SELECT as_of, location_id, version, cost_local, n_items FROM v_snapshots",
    "d6_coverage": "SELECT as_of, location_id, coverage_pct, imputed_share FROM v_snapshots",
    "d7_filtered_count": "SELECT reporter_id, count(CASE WHEN is_valid THEN 1 END) AS valid, count(*) AS n, max(observed_on) AS latest FROM v_obs GROUP BY reporter_id",
    "d8_health": "SELECT event_type, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY event_type",
    "d9_low_quantile": "SELECT item, R4(Q(unit_price, 0.1)) AS low FROM v_obs WHERE is_valid GROUP BY item",
    "d10_mad": """SELECT o.item, MED(o.distance) AS mad FROM (SELECT v.item, abs(v.unit_price - m.median) AS distance FROM v_obs v
        JOIN (SELECT item, MED(unit_price) AS median FROM v_obs WHERE is_valid GROUP BY item) m ON m.item = v.item WHERE v.is_valid) o GROUP BY o.item""",
    # Where all places agree there is no scale; a price more than half away from theirs counts as far as the cut.
    "d11_modified_z": """SELECT x.location_id, x.item, x.as_of, CASE WHEN y.mad > 0 THEN R4(0.6745e0 * (x.value - y.median) / y.mad) END AS z,
        CASE WHEN y.mad > 0 THEN abs(0.6745e0 * (x.value - y.median) / y.mad) >= 3.5e0 ELSE y.median > 0 AND abs(x.value - y.median) / y.median > 0.5e0 END AS is_outlier FROM v_estimates x JOIN (
        SELECT e.as_of, e.item, m.median, MED(abs_e) AS mad FROM (SELECT e.as_of, e.item, abs(e.value - m.median) AS abs_e FROM v_estimates e
            JOIN (SELECT as_of, item, MED(value) AS median FROM v_estimates GROUP BY as_of, item) m ON m.as_of = e.as_of AND m.item = e.item) e
        JOIN (SELECT as_of, item, MED(value) AS median FROM v_estimates GROUP BY as_of, item) m ON m.as_of = e.as_of AND m.item = e.item GROUP BY e.as_of, e.item, m.median) y
        ON y.as_of = x.as_of AND y.item = x.item""",
    "d12_interval": "SELECT item, R4(Q(unit_price, 0.025)) AS lo, R4(Q(unit_price, 0.975)) AS hi FROM v_obs WHERE is_valid GROUP BY item",
    "d17_national_trend": """SELECT item, R6(this_week / last_week) AS trend FROM (
        SELECT item, MED(new_price) AS this_week, MED(old_price) AS last_week FROM (
            SELECT item, CASE WHEN observed_on BETWEEN date '1998-03-08' AND date '1998-03-15' THEN unit_price END AS new_price,
                CASE WHEN observed_on BETWEEN date '1998-02-28' AND date '1998-03-07' THEN unit_price END AS old_price
            FROM v_obs WHERE is_valid AND observed_on BETWEEN date '1998-02-28' AND date '1998-03-15') p GROUP BY item) x WHERE last_week > 0""",
    "d20_national_series": "SELECT as_of, count(*) AS n, MED(cost_local) AS median_cost FROM v_snapshots WHERE coverage_pct >= 1.0e0 AND as_of >= (SELECT ADD(latest, -90) FROM (SELECT max(as_of) AS latest FROM v_snapshots) m) GROUP BY as_of",
    "d21_headline": """SELECT h.as_of, n, upper_median, R4(upper_median / r.rate) AS upper_median_usd, lowest, highest, CASE WHEN lowest > 0 THEN R4(highest / lowest) END AS spread, coverage, imputed, cheapest, dearest FROM (
        SELECT as_of, count(*) AS n, max(CASE WHEN k = cast(floor(n / 2) AS bigint) + 1 THEN cost_local END) AS upper_median, min(cost_local) AS lowest, max(cost_local) AS highest, R4(avg(coverage_pct)) AS coverage, R4(avg(imputed_share)) AS imputed,
        max(CASE WHEN k = 1 THEN location_id END) AS cheapest, max(CASE WHEN k = n THEN location_id END) AS dearest FROM (
            SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY cost_local, location_id) AS k, count(*) OVER (PARTITION BY as_of) AS n FROM v_snapshots WHERE coverage_pct + imputed_share >= 0.999) x
        GROUP BY as_of) h LEFT JOIN (SELECT seen_on, max(rate_date) AS rate_date FROM SEENRATE(v_rates) q GROUP BY seen_on) d ON d.seen_on = h.as_of LEFT JOIN v_rates r ON r.rate_date = d.rate_date""",
    # Thirty days up to the newest one.
    "d22_coverage_report": """SELECT x.location_id, x.latest, DAYS(x.newest, x.latest) AS days_since, x.coverage, x.imputed, x.n FROM (
        SELECT s.location_id, m.newest, max(s.as_of) AS latest, R4(avg(s.coverage_pct)) AS coverage, R4(avg(s.imputed_share)) AS imputed, count(*) AS n FROM v_snapshots s
        CROSS JOIN (SELECT max(as_of) AS newest FROM v_days) m WHERE s.as_of > ADD(m.newest, -30) GROUP BY s.location_id, m.newest) x""",
    "d25_label_metrics": "SELECT source, count(*) AS n, R4(avg(cast(quality AS double))) AS quality, R4(avg(cast(toxic AS double))) AS toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY source",
    "d28_rank_auc": """SELECT R6((sum(CASE WHEN toxic = 1 THEN mid ELSE 0.0e0 END) - pos * (pos + 1) / 2.0e0) / (pos * (cast(n AS double) - pos))) AS auc FROM (
        SELECT toxic, r + (c - 1) / 2.0e0 AS mid, n, pos FROM (
            SELECT toxic, rank() OVER (ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY n_chars) AS c, count(*) OVER () AS n, cast(sum(toxic) OVER () AS double) AS pos
            FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x) y GROUP BY n, pos""",
    "d29_threshold_curve": """SELECT threshold, published, correct, R4(cast(published AS double) / total) AS coverage, CASE WHEN published > 0 THEN R4(cast(correct AS double) / published) END AS prec
        FROM (SELECT t.threshold, count(*) AS total, count(CASE WHEN x.score >= t.threshold THEN 1 END) AS published, count(CASE WHEN x.score >= t.threshold AND x.ok = 1 THEN 1 END) AS correct
        FROM (SELECT l_discount * 10 AS score, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS ok FROM lineitem) x
        CROSS JOIN (SELECT draw / 10.0e0 AS threshold FROM NUMBERS(11)) t GROUP BY t.threshold) c""",
    "d30_wilson": """SELECT item, R6((p + 1.9208e0 / n - 1.96e0 * sqrt(p * (1 - p) / n + 0.9604e0 / (n * n))) / (1 + 3.8416e0 / n)) AS lo, R6((p + 1.9208e0 / n + 1.96e0 * sqrt(p * (1 - p) / n + 0.9604e0 / (n * n))) / (1 + 3.8416e0 / n)) AS hi
        FROM (SELECT item, cast(count(*) AS double) AS n, cast(sum(CASE WHEN is_valid THEN 1 ELSE 0 END) AS double) / cast(count(*) AS double) AS p FROM v_obs GROUP BY item) x""",
    "d32_category_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "d33_basket_weight_check": "SELECT version, abs(sum(weight) - 1.0e0) <= 1e-6 AS is_complete FROM v_basket_items GROUP BY version",
    "d34_match_counters": "SELECT p_type AS variant, count(*) AS times_matched, max(cast(l_shipdate AS date)) AS last_matched FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type",
    # -- windows, ranking, limits
    "e1_latest_per_location": "SELECT location_id, as_of, cost_local FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY as_of DESC, version DESC) AS k FROM v_snapshots) x WHERE k = 1",
    "e2_latest_per_date": "SELECT as_of, location_id, version, cost_local FROM (SELECT *, row_number() OVER (PARTITION BY as_of, location_id ORDER BY version DESC) AS k FROM v_snapshots) x WHERE k = 1",
    # The newest rate of 21 days before, or the first one where there is none so old.
    "e6_lagged_rate": """SELECT r.rate_date, R4(r.rate) AS rate, R4(coalesce(p.rate, f.rate)) AS earlier FROM (
            SELECT a.rate_date, a.rate, max(b.rate_date) AS before FROM v_rates a LEFT JOIN v_rates b ON b.rate_date <= ADD(a.rate_date, -21) GROUP BY a.rate_date, a.rate) r
        LEFT JOIN v_rates p ON p.rate_date = r.before CROSS JOIN (SELECT rate FROM v_rates WHERE rate_date = (SELECT min(rate_date) FROM v_rates)) f""",
    "e7_first_complete_day": "SELECT s.location_id, min(s.as_of) AS first_complete FROM v_snapshots s JOIN (SELECT location_id, min(observed_on) AS earliest FROM v_obs WHERE is_valid GROUP BY location_id) f ON f.location_id = s.location_id WHERE s.coverage_pct >= 0.999e0 AND s.as_of <= ADD(f.earliest, 45) GROUP BY s.location_id",
    "e8_rank_of_correct": "SELECT item, location_id, cast(rank() OVER (PARTITION BY item ORDER BY value DESC) AS bigint) AS position FROM v_estimates WHERE as_of = date '1998-03-20'",
    "f4_topk_candidates": "SELECT item, reporter_id, n FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, reporter_id) AS k FROM (SELECT item, reporter_id, count(*) AS n FROM v_obs GROUP BY item, reporter_id) c) x WHERE k <= 5",
    "f6_top_locations": "SELECT s.location_id, s.as_of, s.cost_local FROM v_snapshots s JOIN (SELECT location_id FROM v_obs GROUP BY location_id ORDER BY count(*) DESC, location_id LIMIT 6) t ON t.location_id = s.location_id",
    "f7_top_outliers": "SELECT item, location_id, unit_price FROM (SELECT item, location_id, unit_price, row_number() OVER (PARTITION BY item ORDER BY unit_price DESC, location_id, reporter_id, observed_on) AS k FROM v_obs) x WHERE k <= 3",
    "f8_oldest_first": "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 500",
    # -- set operations, incremental work, anomaly and bias screens
    "g1_union_distinct": "SELECT location_id FROM v_locations UNION SELECT location_id FROM v_obs",
    "g2_except": "SELECT item FROM v_basket_items EXCEPT SELECT item FROM v_estimates WHERE as_of = date '1998-03-01'",
    "g3_intersect": "SELECT location_id, item FROM v_estimates WHERE as_of = date '1998-03-01' INTERSECT SELECT location_id, item FROM v_estimates WHERE as_of = date '1998-03-31'",
    "j3_dirty_cells": "SELECT DISTINCT o.location_id, d.as_of FROM (SELECT location_id, observed_on FROM v_obs WHERE NOT is_valid AND observed_on BETWEEN date '1998-03-01' AND date '1998-03-31') o JOIN v_days d ON d.as_of >= o.observed_on AND d.as_of <= ADD(o.observed_on, 7)",
    "d32_daily_submissions": "SELECT cast(observed_at AS date) AS day, item, count(*) AS n FROM v_submissions GROUP BY cast(observed_at AS date), item",
    "i21_decimal_error": """SELECT v.location_id, v.item, count(*) AS n FROM v_obs v JOIN (SELECT item, MED(unit_price) AS median FROM v_obs WHERE is_valid GROUP BY item) m ON m.item = v.item
        WHERE v.unit_price / m.median >= 8 OR v.unit_price / m.median <= 0.125 GROUP BY v.location_id, v.item""",
    "i27_median_bias": """SELECT x.reporter_id, count(*) AS n, R4(MED(ratio)) AS bias FROM (SELECT v.reporter_id, v.unit_price / m.median AS ratio FROM v_obs v
        JOIN (SELECT item, MED(unit_price) AS median FROM v_obs WHERE is_valid GROUP BY item) m ON m.item = v.item WHERE v.is_valid) x GROUP BY x.reporter_id HAVING count(*) >= 15""",
    "a8_external_id": "SELECT s_suppkey, SHA256(concat(s_name, '|', cast(s_nationkey AS CHARS))) AS external_id FROM supplier",
    "a18_upsert": """SELECT location_id, as_of, cost_local FROM v_snapshots WHERE as_of >= date '1998-03-16'
        UNION ALL SELECT o.location_id, o.as_of, o.cost_local FROM v_snapshots o WHERE o.as_of < date '1998-03-21' AND NOT EXISTS (SELECT 1 FROM v_snapshots n WHERE n.as_of >= date '1998-03-16' AND n.as_of = o.as_of AND n.location_id = o.location_id)""",
    "a20_export": "SELECT s.as_of, l.name, s.version, s.cost_local, s.coverage_pct, s.imputed_share FROM v_snapshots s JOIN v_locations l ON l.location_id = s.location_id",
    "a22_small_cells": "SELECT as_of, location_id, item, CASE WHEN n = 0 OR n >= 5 THEN n END AS observation_count FROM v_filled",
}
