"""Queries of matching, review, anomaly, chaining, health and incremental rules; SQL over the adapter views.

Where the star schema has no such table, a view stands for it: order priorities
are raw texts of submissions, order states their review verdicts.
"""

from __future__ import annotations

#: Views that only these queries use.
VIEWS: dict[str, str] = {
    "v_reviews": """
        SELECT cast(o_orderkey AS bigint) AS submission_id, cast(o_custkey AS bigint) AS reporter_id, lower(replace(o_orderpriority, '-', ' ')) AS raw_text,
            cast(o_orderdate AS date) AS observed_on, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'review' END AS verdict
        FROM orders""",
    "v_variants": "SELECT '1 urgent' AS variant, 'urgent' AS item UNION ALL SELECT '2 high' AS variant, 'high' AS item UNION ALL SELECT '3 medium' AS variant, 'medium' AS item",
    # Both baskets at the prices of the day before the second begins.
    "v_link_costs": """
        SELECT f.location_id, b.version, sum(b.quantity * f.price) AS cost, min(CASE WHEN f.is_imputed THEN 0 ELSE 1 END) AS is_complete
        FROM (SELECT DISTINCT location_id, item, price, is_imputed FROM v_filled WHERE as_of = date '1998-03-15') f
        JOIN v_basket_items b ON b.item = f.item WHERE f.price IS NOT NULL GROUP BY f.location_id, b.version""",
    "v_arrivals": "SELECT submission_id, reporter_id, item, observed_at, price, LATER(observed_at, (submission_id * 7919) % 5760) AS ingested_at FROM v_submissions",
}

SQL: dict[str, str] = {
    # -- scalars
    "b3_optional_filters": "SELECT as_of, location_id, version, cost_local FROM v_snapshots WHERE (cast(NULL AS bigint) IS NULL OR location_id = cast(NULL AS bigint)) AND (2 IS NULL OR version = 2)",
    "b16_map_projection": """SELECT location_id, R2((longitude - min_lon) * lon_scale * scale + (800 - span_x * scale) / 2.0e0) AS x, R2((max_lat - latitude) * scale + (500 - span_y * scale) / 2.0e0) AS y
        FROM (SELECT l.location_id, l.latitude, l.longitude, b.*, least(720.0e0 / b.span_x, 420.0e0 / b.span_y) AS scale FROM v_locations l CROSS JOIN (
            SELECT min_lon, max_lat, lon_scale, greatest((max_lon - min_lon) * lon_scale, 1e-9) AS span_x, greatest(max_lat - min_lat, 1e-9) AS span_y FROM (
                SELECT min(longitude) AS min_lon, max(longitude) AS max_lon, min(latitude) AS min_lat, max(latitude) AS max_lat, cos(radians((min(latitude) + max(latitude)) / 2.0e0)) AS lon_scale FROM v_locations) c) b) x""",
    "b22_json_path": "SELECT event_id, cast(JSON(props, '$.k') AS bigint) AS k, JSON(props, '$.none') AS missing FROM events",
    "b25_resolve_location": """SELECT t.c_custkey, coalesce(n.location_id, s.location_id) AS location_id FROM (
            SELECT c_custkey, lower(trim(CASE c_custkey % 3 WHEN 0 THEN concat('  ', upper(n_name)) WHEN 1 THEN lower(replace(n_name, ' ', '-')) ELSE concat(n_name, '?') END)) AS typed
            FROM customer JOIN nation ON n_nationkey = c_nationkey) t
        LEFT JOIN v_locations n ON lower(n.name) = t.typed LEFT JOIN v_locations s ON lower(replace(s.name, ' ', '-')) = t.typed""",
    "b28_local_today": "SELECT event_id, LOCALDAY(ts, 'Africa/Tripoli') AS local_day FROM events",
    "b35_config_merge": """SELECT n_nationkey, coalesce(own_window, 7) AS window_days, coalesce(own_half_life, 3.0e0) AS half_life, coalesce(own_rate, 'parallel') AS rate_type, coalesce(own_provider, 'manual') AS provider
        FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 14 END AS own_window, CASE WHEN n_nationkey % 3 = 0 THEN 5.0e0 END AS own_half_life,
            CASE WHEN n_nationkey % 5 = 0 THEN 'official' END AS own_rate, CASE WHEN n_nationkey % 7 = 0 THEN 'http_json' END AS own_provider FROM nation) c""",
    "b33_acceptance_rate": "SELECT reporter_id, count(*) AS n, R4(cast(count(CASE WHEN verdict = 'accepted' THEN 1 END) AS double) / nullif(cast(count(CASE WHEN verdict <> 'review' THEN 1 END) AS double), 0.0e0)) AS acceptance_rate FROM v_reviews GROUP BY reporter_id",
    # -- aggregates and windows
    "d14_basket_interval": """SELECT as_of, location_id, R4(Q(total, 0.025)) AS lo, R4(Q(total, 0.975)) AS hi FROM (
            SELECT f.as_of, f.location_id, k.draw, sum(f.quantity * CASE WHEN s.value IS NOT NULL THEN s.value ELSE f.price * (CASE k.draw % 3 WHEN 0 THEN 0.7e0 WHEN 1 THEN 1.0e0 ELSE 1.3e0 END) END) AS total
            FROM v_filled f CROSS JOIN (SELECT draw FROM NUMBERS(20)) k
            LEFT JOIN (SELECT as_of, location_id, item, unit_price AS value, row_number() OVER (PARTITION BY as_of, location_id, item ORDER BY unit_price, observed_on, reporter_id) - 1 AS place,
                count(*) OVER (PARTITION BY as_of, location_id, item) AS n FROM v_windowed) s
                ON s.as_of = f.as_of AND s.location_id = f.location_id AND s.item = f.item AND s.place = k.draw % s.n
            WHERE f.price IS NOT NULL GROUP BY f.as_of, f.location_id, k.draw) x GROUP BY as_of, location_id""",
    "d23_method_share": """SELECT count(*) AS sampled, R4(avg(CASE WHEN price IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END)) AS filled_share FROM (
        SELECT price FROM v_filled WHERE is_imputed ORDER BY as_of DESC, location_id, item LIMIT 200) x""",
    "d24_id_lists": "SELECT location_id, JOINED(reporter_id) AS reporters FROM (SELECT DISTINCT location_id, cast(reporter_id AS CHARS) AS reporter_id FROM v_obs) x GROUP BY location_id",
    "d27_interval_metrics": """SELECT count(*) AS n, R4(avg(abs(value - guess))) AS mae, R4(avg(abs(value - guess) / value)) AS mape, R4(MED(ape)) AS median_ape,
            R4(avg(CASE WHEN value BETWEEN 0.55e0 * guess AND 1.45e0 * guess THEN 1.0e0 ELSE 0.0e0 END)) AS coverage, R4(avg(0.9e0 * guess / value)) AS width,
            R4(avg(CASE WHEN value >= 0.55e0 * guess THEN 0.1e0 * (value - 0.55e0 * guess) ELSE 0.9e0 * (0.55e0 * guess - value) END)) AS pinball_low
        FROM (SELECT e.value, m.median AS guess, abs(e.value - m.median) / e.value AS ape FROM v_estimates e
            JOIN (SELECT as_of, item, MED(value) AS median FROM v_estimates GROUP BY as_of, item) m ON m.as_of = e.as_of AND m.item = e.item) x""",
    "e9_cyclic_index": """SELECT s.item, k.draw, s.value FROM (SELECT draw FROM NUMBERS(12)) k JOIN (
        SELECT item, value, row_number() OVER (PARTITION BY item ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY item) AS n FROM (SELECT DISTINCT p_type AS item, cast(p_size AS bigint) AS value FROM part WHERE p_size <= 5) d) s ON s.place = k.draw % s.n""",
    "f3_keyset_chunks": "SELECT cast(floor(event_id / 500) AS bigint) AS chunk, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM events GROUP BY cast(floor(event_id / 500) AS bigint)",
    "f9_argsort": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10",
    # -- matching and review
    "i8_fuse": """SELECT item, reporter_id, R6(0.4e0 * coalesce(lexical, 0.0e0) + 0.6e0 * coalesce(semantic, 0.0e0)) AS fused FROM (
            SELECT coalesce(a.item, b.item) AS item, coalesce(a.reporter_id, b.reporter_id) AS reporter_id, a.score AS lexical, b.score AS semantic
            FROM (SELECT item, reporter_id, avg(CASE WHEN is_valid THEN 1.0e0 ELSE 0.0e0 END) AS score FROM v_obs WHERE reporter_id % 3 <> 0 GROUP BY item, reporter_id) a
            FULL OUTER JOIN (SELECT item, reporter_id, 1.0e0 / (1.0e0 + count(*)) AS score FROM v_obs WHERE reporter_id % 5 <> 0 GROUP BY item, reporter_id) b ON a.item = b.item AND a.reporter_id = b.reporter_id) x""",
    "i5_build_catalogue": "SELECT variant, item FROM (SELECT variant, item, row_number() OVER (PARTITION BY variant ORDER BY p_partkey) AS k FROM (SELECT lower(p_brand) AS variant, p_type AS item, p_partkey FROM part) p) x WHERE k = 1",
    "i13_match_exact_tier": "SELECT r.submission_id, v.item, CASE WHEN r.raw_text = '' THEN 'reject' WHEN v.item IS NOT NULL THEN 'auto_resolve' ELSE 'fuzzy' END AS tier FROM v_reviews r LEFT JOIN v_variants v ON v.variant = r.raw_text",
    "i14_resolve": """SELECT r.submission_id, CASE WHEN d.phrase IS NOT NULL THEN 'rejected' WHEN v.item IS NOT NULL THEN 'resolved' ELSE 'review' END AS status, CASE WHEN d.phrase IS NULL AND v.item IS NOT NULL THEN 0.99e0 END AS confidence
        FROM v_reviews r LEFT JOIN v_variants v ON v.variant = r.raw_text LEFT JOIN (SELECT '5 low' AS phrase) d ON d.phrase = r.raw_text""",
    "i15_learn_variant": """SELECT r.raw_text AS learned, count(*) AS times FROM v_reviews r WHERE r.verdict = 'accepted' AND NOT EXISTS (SELECT 1 FROM v_variants v WHERE v.variant = r.raw_text) GROUP BY r.raw_text""",
    "i16_learn_rejection": """SELECT r.raw_text AS phrase, count(*) AS times FROM v_reviews r WHERE r.verdict = 'rejected' AND NOT EXISTS (SELECT 1 FROM v_variants v WHERE v.variant = r.raw_text) GROUP BY r.raw_text""",
    "i17_backlog_inherits": """SELECT q.submission_id, d.verdict FROM v_reviews q JOIN (
        SELECT raw_text, reporter_id, min(verdict) AS verdict FROM v_reviews WHERE verdict <> 'review' GROUP BY raw_text, reporter_id HAVING count(DISTINCT verdict) = 1) d ON d.raw_text = q.raw_text AND d.reporter_id = q.reporter_id WHERE q.verdict = 'review'""",
    "i18_rematch_queue": "SELECT r.submission_id, v.item, 'exact' AS method FROM v_reviews r JOIN v_variants v ON v.variant = r.raw_text WHERE r.verdict = 'review'",
    "i19_promote_plan": """SELECT text, CASE WHEN text = '' THEN 'empty' WHEN known > 0 THEN 'known' WHEN owners > 1 THEN 'ambiguous' WHEN text LIKE '%5%' THEN 'held' ELSE 'promote' END AS plan
        FROM (SELECT p.text, count(DISTINCT p.item) AS owners, count(v.variant) AS known FROM (SELECT lower(p_brand) AS text, p_type AS item FROM part) p LEFT JOIN v_variants v ON v.variant = p.text GROUP BY p.text) x""",
    "i45_embeddable_text": "SELECT location_id, CASE WHEN lower(name) = name THEN name ELSE concat(name, ' / ', lower(name)) END AS embeddable FROM v_locations",
    # -- reporters
    "i28_bias_review_state": """SELECT reporter_id, CASE WHEN suspicious AND cleared THEN 'cleared' WHEN suspicious THEN 'flagged' ELSE 'none' END AS state
        FROM (SELECT reporter_id, ratio < 0.6e0 AS suspicious, reporter_id % 10 = 0 AS cleared FROM v_bias) x""",
    # -- the index
    "i35_snapshot": """SELECT s.as_of, s.location_id, s.version, s.cost_local, s.coverage_pct, s.imputed_share, R4(s.cost_local / r.rate) AS cost_usd, r.rate_date < s.as_of AS fx_is_stale,
            CASE WHEN s.coverage_pct < 0.5e0 THEN 'low' WHEN s.coverage_pct + s.imputed_share < 0.999e0 THEN 'moderate' WHEN s.imputed_share > 0.1e0 OR coalesce(r.rate_date < s.as_of, false) THEN 'moderate' ELSE 'good' END AS quality
        FROM v_snapshots s LEFT JOIN (SELECT as_of, rate_date, rate FROM (
            SELECT d.as_of, q.rate_date, q.rate, row_number() OVER (PARTITION BY d.as_of ORDER BY q.rate_date DESC) AS k FROM (SELECT DISTINCT as_of FROM v_snapshots) d JOIN SEENRATE(v_rates) q ON q.seen_on = d.as_of) x WHERE k = 1) r ON r.as_of = s.as_of""",
    "i36_chain_link": """SELECT x.location_id, CASE WHEN x.old_cost > 0 AND x.new_cost > 0 AND x.complete = 1 THEN R6(x.new_cost / x.old_cost) ELSE R6(m.factor) END AS factor,
            CASE WHEN x.old_cost > 0 AND x.new_cost > 0 AND x.complete = 1 THEN 'own' WHEN m.factor IS NOT NULL THEN 'country_median' ELSE 'skipped' END AS method
        FROM (SELECT location_id, max(CASE WHEN version = 1 THEN cost END) AS old_cost, max(CASE WHEN version = 2 THEN cost END) AS new_cost, min(is_complete) AS complete FROM v_link_costs GROUP BY location_id) x
        CROSS JOIN (SELECT MED(factor) AS factor FROM (SELECT location_id, max(CASE WHEN version = 2 THEN cost END) / max(CASE WHEN version = 1 THEN cost END) AS factor FROM v_link_costs WHERE is_complete = 1 GROUP BY location_id) f) m""",
    "i38_rebuild_queue": "SELECT as_of, location_id, stale_since FROM (SELECT s.as_of, s.location_id, max(o.observed_on) AS stale_since FROM v_snapshots s JOIN v_obs o ON o.location_id = s.location_id AND o.observed_on = s.as_of WHERE NOT o.is_valid GROUP BY s.as_of, s.location_id) q ORDER BY stale_since, as_of, location_id LIMIT 500",
    "i39_health": """SELECT name, status FROM (
            SELECT 'prices' AS name, CASE WHEN count(*) = 0 THEN 'stalled' WHEN sum(CASE WHEN is_valid THEN 1 ELSE 0 END) * 2 < count(*) THEN 'degraded' ELSE 'ok' END AS status FROM v_obs
            UNION ALL SELECT 'rates' AS name, CASE WHEN count(*) = 0 THEN 'stalled' WHEN count(official_rate) = 0 THEN 'degraded' ELSE 'ok' END AS status FROM v_rates
            UNION ALL SELECT 'review' AS name, CASE WHEN sum(CASE WHEN verdict = 'review' THEN 1 ELSE 0 END) * 4 > count(*) THEN 'degraded' ELSE 'ok' END AS status FROM v_reviews
            UNION ALL SELECT 'baskets' AS name, CASE WHEN count(*) = 0 THEN 'stalled' WHEN sum(CASE WHEN effective_to IS NULL THEN 1 ELSE 0 END) <> 1 THEN 'degraded' ELSE 'ok' END AS status FROM v_baskets
            UNION ALL SELECT 'arrivals' AS name, CASE WHEN max(DAYS(came, seen)) > 3 THEN 'degraded' ELSE 'ok' END AS status FROM (SELECT cast(ingested_at AS date) AS came, cast(observed_at AS date) AS seen FROM v_arrivals) a) x""",
    "i40_forget_reporter": "SELECT event_id, CASE WHEN user_id % 97 = 0 THEN NULL ELSE user_id END AS reporter_id, event_type, value FROM events",
    "i41_fx_series": "SELECT rate_date, R4(rate) AS rate, R4(CASE WHEN official_rate > 0 AND parallel_rate IS NOT NULL THEN parallel_rate / official_rate - 1.0e0 END) AS premium FROM v_rates",
    "i41_location_series": "SELECT location_id, as_of, version, cost_local, coverage_pct FROM v_snapshots",
    "i41_map_points": """SELECT l.location_id, l.latitude, l.longitude, s.cost_local FROM v_locations l LEFT JOIN (
        SELECT location_id, cost_local, row_number() OVER (PARTITION BY location_id ORDER BY as_of DESC, version DESC) AS k FROM v_snapshots) s ON s.location_id = l.location_id AND s.k = 1""",
    # -- incremental work
    "j1_event_and_arrival": "SELECT cast(observed_at AS date) AS day, count(*) AS n, count(CASE WHEN cast(ingested_at AS date) > cast(observed_at AS date) THEN 1 END) AS arrived_later FROM v_arrivals GROUP BY cast(observed_at AS date)",
    "j2_idempotent_ingest": """SELECT submission_id, reporter_id, item, price FROM (SELECT u.*, row_number() OVER (PARTITION BY reporter_id, submission_id ORDER BY attempt) AS k FROM (
        SELECT *, 1 AS attempt FROM v_submissions UNION ALL SELECT *, 2 AS attempt FROM v_submissions WHERE submission_id % 50 = 0) u) x WHERE k = 1""",
    "j4_debounced_drain": "SELECT submission_id, item FROM (SELECT submission_id, item, ingested_at FROM v_arrivals WHERE ingested_at <= LATER(timestamp '2024-01-20 00:00:00', -1) ORDER BY ingested_at, submission_id LIMIT 500) x",
    "j10_reporter_state": "SELECT reporter_id, 2 + sum(CASE WHEN verdict = 'accepted' THEN 1 ELSE 0 END) AS alpha, 2 + sum(CASE WHEN verdict = 'rejected' THEN 1 ELSE 0 END) AS beta FROM v_reviews GROUP BY reporter_id",
}

# A reporter's lowest tenth of price ratios to the median of the location's other reporters.
VIEWS["v_bias"] = """
        SELECT reporter_id, count(*) AS n, Q(ratio, 0.1) AS ratio FROM (
            SELECT o.reporter_id, o.unit_price / r.median AS ratio FROM v_obs o JOIN (
                SELECT a.location_id, a.item, a.reporter_id, MED(b.unit_price) AS median FROM (SELECT DISTINCT location_id, item, reporter_id FROM v_obs WHERE is_valid) a
                JOIN v_obs b ON b.location_id = a.location_id AND b.item = a.item WHERE b.is_valid AND b.reporter_id <> a.reporter_id GROUP BY a.location_id, a.item, a.reporter_id) r
            ON r.location_id = o.location_id AND r.item = o.item AND r.reporter_id = o.reporter_id WHERE o.is_valid AND r.median > 0) x
        GROUP BY reporter_id HAVING count(*) >= 15"""
