"""Queries of the index's smaller rules: units, weights, ratios, features and keyed writes; SQL over the adapter views."""

from __future__ import annotations

SQL: dict[str, str] = {
    # -- scalars and filters
    "b5_base_quantity": """SELECT b.version, b.item, CASE WHEN u.factor IS NULL THEN FAIL('unknown unit') ELSE R6(b.quantity * u.factor) END AS base_quantity
        FROM v_basket_items b JOIN v_items i ON i.item = b.item LEFT JOIN v_units u ON u.unit = i.unit""",
    "b7_estimator_weight": "SELECT as_of, observed_on, location_id, item, reporter_id, R6(weight) AS weight FROM v_windowed",
    "b14_relative_width": """SELECT item, CASE WHEN mid > 0 THEN R4((hi - lo) / mid) END AS width
        FROM (SELECT item, Q(unit_price, 0.025) AS lo, Q(unit_price, 0.975) AS hi, MED(unit_price) AS mid FROM v_obs WHERE is_valid GROUP BY item) x""",
    "b19_safe_ratio": """SELECT v.location_id, v.item, v.reporter_id, R6(CASE WHEN m.median > 0 THEN v.unit_price / m.median ELSE 1.0e0 END) AS ratio
        FROM v_obs v LEFT JOIN (SELECT item, MED(unit_price) AS median FROM v_obs WHERE is_valid GROUP BY item) m ON m.item = v.item""",
    "b21_cost_usd": """SELECT s.as_of, s.location_id, CASE WHEN r.rate > 0 THEN R4(s.cost_local / r.rate) END AS cost_usd FROM v_snapshots s
        LEFT JOIN (SELECT d.as_of, max(r.rate_date) AS rate_date FROM v_days d JOIN v_rates r ON r.rate_date BETWEEN ADD(d.as_of, -7) AND d.as_of GROUP BY d.as_of) n ON n.as_of = s.as_of
        LEFT JOIN v_rates r ON r.rate_date = n.rate_date""",
    "b26_resolve_unit": """SELECT p.p_partkey, coalesce(u.unit, i.unit) AS unit FROM part p JOIN v_items i ON i.item = p.p_type
        LEFT JOIN v_units u ON u.unit = CASE WHEN p.p_size % 4 = 0 THEN lower(trim(' KG ')) WHEN p.p_size % 4 = 1 THEN 'crate' END""",
    "b27_locale_guess": "SELECT doc_id, CASE WHEN MATCHES(text, '[؀-ۿ]') THEN 'ar' ELSE 'en' END AS locale FROM documents",
    "b30_plausibility": """SELECT s.as_of, s.location_id, s.cost_local FROM v_snapshots s
        JOIN (SELECT version, Q(cost_local, 0.05) AS lo, Q(cost_local, 0.95) AS hi FROM v_snapshots GROUP BY version) b ON b.version = s.version WHERE s.cost_local NOT BETWEEN b.lo AND b.hi""",
    "b31_admin_list": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%00%1%' ORDER BY c_name, c_custkey LIMIT 25 OFFSET 25",
    "b34_raw_text": "SELECT s.submission_id, coalesce(nullif(trim(c.c_mktsegment), ''), s.item) AS raw_text FROM v_submissions s LEFT JOIN customer c ON c.c_custkey = s.reporter_id",
    "b36_imputed_scope": "SELECT as_of, location_id, item FROM v_filled WHERE is_imputed AND price IS NOT NULL",
    # -- joins
    "c14_exact_text": """SELECT p.p_partkey, v.item FROM part p
        JOIN (SELECT lower(trim(p_type)) AS variant, min(p_type) AS item FROM part GROUP BY lower(trim(p_type))) v ON v.variant = lower(trim(p.p_type))""",
    "c17_key_by": "SELECT d.doc_id, l.toxic, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
    "c18_get_or_create": """SELECT reporter_id, alpha, beta FROM v_reporters UNION ALL SELECT cast(n.reporter_id AS bigint) AS reporter_id, 2.0e0 AS alpha, 2.0e0 AS beta
        FROM (SELECT DISTINCT reporter_id FROM v_submissions WHERE reporter_id IS NOT NULL) n WHERE NOT EXISTS (SELECT 1 FROM v_reporters r WHERE r.reporter_id = n.reporter_id)""",
    # -- features of the imputation
    # Equal distances give means that end in exactly 5; 1e-9 more rounds them alike in whatever order they are summed.
    "d15_inverse_distance": """SELECT d.a AS location_id, e.as_of, e.item, R4(sum(e.value / (1.0e0 + d.km)) / sum(1.0e0 / (1.0e0 + d.km)) + 1e-9) AS value
        FROM v_distances d JOIN v_estimates e ON e.location_id = d.b GROUP BY d.a, e.as_of, e.item""",
    "d16_price_level": """SELECT a.location_id, a.item, R4(coalesce(MED(b.ratio), 1.0e0)) AS price_level FROM v_levels a
        LEFT JOIN v_levels b ON b.location_id = a.location_id AND b.item <> a.item GROUP BY a.location_id, a.item""",
    "d18_fx_change": """SELECT n.as_of, R6(CASE WHEN o.rate > 0 THEN n.rate / o.rate ELSE 1.0e0 END) AS fx_change
        FROM (SELECT d.as_of, max_by(r.rate, r.rate_date) AS rate FROM v_days d JOIN v_rates r ON r.rate_date <= d.as_of GROUP BY d.as_of) n
        LEFT JOIN (SELECT d.as_of, max_by(r.rate, r.rate_date) AS rate FROM v_days d JOIN v_rates r ON r.rate_date <= ADD(d.as_of, -30) GROUP BY d.as_of) o ON o.as_of = n.as_of""",
    "d19_link_factor": """SELECT R6(MED(factor)) AS factor FROM (SELECT n.cost_local / o.cost_local AS factor FROM v_snapshots n JOIN v_snapshots o ON o.location_id = n.location_id
        WHERE n.as_of = date '1998-03-16' AND o.as_of = date '1998-03-15' AND o.cost_local > 0) x""",
    # -- keyed writes: kept rows and the new ones, the new one of a key winning
    "a13_fx_store": """SELECT rate_date, is_manual, R4(parallel_rate) AS parallel_rate FROM v_fx WHERE rate_date >= date '1998-01-01'
        UNION ALL SELECT o.rate_date, o.is_manual, R4(o.parallel_rate) AS parallel_rate FROM v_fx o WHERE o.rate_date < date '1998-02-01'
            AND NOT EXISTS (SELECT 1 FROM v_fx n WHERE n.rate_date >= date '1998-01-01' AND n.rate_date = o.rate_date AND n.is_manual = o.is_manual)""",
    "a16_close_baskets": """SELECT version, effective_from, ADD(following, -1) AS effective_to FROM (
        SELECT version, effective_from, lead(effective_from) OVER (ORDER BY effective_from) AS following FROM v_baskets) x""",
    # -- screens, verdicts and fallbacks
    "i9_calibrate": "SELECT l_orderkey, l_linenumber, R4(least(1.0e0, greatest(0.0e0, 0.5e0 + 0.6e0 * (l_discount * 10 - 0.5e0)))) AS confidence FROM lineitem",
    "i12_decide": """SELECT item, CASE WHEN best >= 0.85 AND best - coalesce(second, 0.0e0) >= 0.05 THEN 'auto_resolve' WHEN best >= 0.55 THEN 'review' ELSE 'reject' END AS decision
        FROM (SELECT item, max(CASE WHEN k = 1 THEN share END) AS best, max(CASE WHEN k = 2 THEN share END) AS second FROM (
            SELECT item, share, row_number() OVER (PARTITION BY item ORDER BY share DESC, reporter_id) AS k FROM (
                SELECT item, reporter_id, avg(CASE WHEN is_valid THEN 1.0e0 ELSE 0.0e0 END) AS share FROM v_obs GROUP BY item, reporter_id) c) d GROUP BY item) x""",
    "i20_harvest_split": "SELECT p_partkey, CASE WHEN right(DIGEST(p_name), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'teach' ELSE 'test' END AS part FROM part",
    "i21_hard_bounds": """SELECT v.location_id, v.item, v.observed_on, v.reporter_id, v.unit_price, CASE WHEN m.median IS NULL OR m.median <= 0 THEN 0.0e0
            WHEN v.unit_price > 4 * m.median OR v.unit_price < m.median / 4 THEN 1.0e0 ELSE 0.0e0 END AS score
        FROM v_obs v LEFT JOIN (SELECT item, MED(unit_price) AS median FROM v_obs WHERE is_valid GROUP BY item) m ON m.item = v.item""",
    "i32_fallback": """SELECT as_of, location_id, item, R4(price) AS mid, R4(greatest(0.0e0, price * 0.55e0)) AS lo, R4(price * 1.45e0) AS hi FROM v_filled WHERE is_imputed AND price > 0""",
    "i37_publish_missing": """SELECT d.as_of, l.location_id FROM v_days d CROSS JOIN v_locations l
        WHERE NOT EXISTS (SELECT 1 FROM v_snapshots s WHERE s.as_of = d.as_of AND s.location_id = l.location_id)""",
    "i40_retention": "SELECT reporter_id, max(observed_on) AS last_seen, max(observed_on) < date '1998-06-01' AS is_dormant FROM v_obs GROUP BY reporter_id",
    "i46_stale_backlog": "SELECT event_type, count(*) AS pending, min(ts) AS oldest FROM events WHERE value < 1 GROUP BY event_type",
    # -- rankings, lists, late rows
    "d24_distinct_lists": "SELECT location_id, count(*) AS n_items FROM (SELECT DISTINCT location_id, item FROM v_obs WHERE is_valid) x GROUP BY location_id",
    "e10_mid_rank": "SELECT event_id, cast(rank() OVER (PARTITION BY event_type ORDER BY value) AS double) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0e0 AS mid FROM events",
    "f1_order_by": "SELECT as_of, location_id, cost_local FROM v_snapshots ORDER BY as_of DESC, location_id",
    "f2_limit": "SELECT submission_id, observed_at FROM v_submissions ORDER BY observed_at DESC, submission_id LIMIT 500",
    "f5_nearest_3": "SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY km, b) AS k FROM v_distances) x WHERE k <= 3",
    "j5_sweep": "SELECT event_id FROM events e WHERE value > 1 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.event_id)",
}
