"""Views that give the price-index schema over the star-schema tables; one text serves Spark and DuckDB."""

from __future__ import annotations

import re

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_locations": """
        SELECT cast(n_nationkey AS bigint) AS location_id, n_name AS name, cast(n_regionkey AS bigint) AS admin1_id,
            cast((n_nationkey * 37) % 120 - 60 AS double) AS latitude, cast((n_nationkey * 53) % 300 - 150 AS double) AS longitude
        FROM nation""",
    "v_obs": """
        SELECT cast(s.s_nationkey AS bigint) AS location_id, p.p_type AS item, cast(l.l_suppkey AS bigint) AS reporter_id,
            cast(l.l_shipdate AS date) AS observed_on, l.l_extendedprice AS price, l.l_quantity AS quantity,
            l.l_extendedprice / l.l_quantity AS unit_price, l.l_returnflag <> 'R' AS is_valid
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "v_reporters": """
        SELECT cast(l_suppkey AS bigint) AS reporter_id,
            cast(2 + sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS double) AS alpha,
            cast(2 + sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS double) AS beta
        FROM lineitem GROUP BY l_suppkey""",
    "v_basket_items": """
        SELECT v.version, b.item, cast(b.r AS double) / 21.0e0 AS weight, cast(CASE WHEN v.version = 1 THEN b.r ELSE 7 - b.r END AS double) AS quantity
        FROM (SELECT item, row_number() OVER (ORDER BY item) AS r FROM (SELECT DISTINCT p_type AS item FROM part) a) b
        CROSS JOIN (SELECT 1 AS version UNION ALL SELECT 2 AS version) v""",
    "v_baskets": """
        SELECT 1 AS version, date '1995-01-01' AS effective_from, date '1998-03-15' AS effective_to
        UNION ALL SELECT 2 AS version, date '1998-03-16' AS effective_from, cast(NULL AS date) AS effective_to""",
    "v_fx": """
        SELECT cast(o_orderdate AS date) AS rate_date, cast(4.0 AS double) + avg(o_totalprice) / 100000.0e0 AS parallel_rate,
            CASE WHEN o_orderpriority = '1-URGENT' THEN cast(NULL AS double) ELSE cast(4.0 AS double) END AS official_rate,
            o_orderpriority = '2-HIGH' AS is_manual, o_orderpriority AS source
        FROM orders
        GROUP BY cast(o_orderdate AS date), o_orderpriority""",
    "v_submissions": "SELECT event_id AS submission_id, user_id AS reporter_id, event_type AS item, ts AS observed_at, value AS price FROM events",
    "v_days": "SELECT DISTINCT cast(l_shipdate AS date) AS as_of FROM lineitem",
    # Trailing window of 7 days, both ends included; half-life 3 days; reputation's lower bound, 0.25 at least.
    "v_windowed": """
        SELECT d.as_of, o.location_id, o.item, o.observed_on, o.unit_price, o.reporter_id,
            pow(2.0e0, -DAYS(d.as_of, o.observed_on) / 3.0e0) * greatest(0.25e0, greatest(0.0e0,
                r.alpha / (r.alpha + r.beta) - sqrt(r.alpha * r.beta / ((r.alpha + r.beta) * (r.alpha + r.beta) * (r.alpha + r.beta + 1.0e0))))) AS weight
        FROM v_obs o JOIN v_days d ON d.as_of = ANYDAY(o.observed_on) JOIN v_reporters r ON r.reporter_id = o.reporter_id
        WHERE o.is_valid AND o.unit_price > 0""",
    "v_ranked": """
        SELECT *, sum(weight) OVER (PARTITION BY as_of, location_id, item) AS total,
            sum(weight) OVER (PARTITION BY as_of, location_id, item ORDER BY unit_price, observed_on, reporter_id, weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative,
            lead(unit_price) OVER (PARTITION BY as_of, location_id, item ORDER BY unit_price, observed_on, reporter_id, weight) AS following
        FROM v_windowed""",
    "v_estimates": """
        SELECT as_of, location_id, item, max(n) AS n, min(value) AS value FROM (
            SELECT as_of, location_id, item, count(*) OVER (PARTITION BY as_of, location_id, item) AS n,
                CASE WHEN abs(cumulative - total / 2.0e0) <= 1e-12 THEN (unit_price + coalesce(following, unit_price)) / 2.0e0
                     WHEN cumulative > total / 2.0e0 THEN unit_price END AS value
            FROM v_ranked) x
        GROUP BY as_of, location_id, item""",
    # Observed estimates, else the median of the day's other locations.
    "v_filled": """
        SELECT g.as_of, g.location_id, b.version, b.item, b.weight, b.quantity, coalesce(e.value, m.median) AS price, e.value IS NULL AS is_imputed, coalesce(e.n, 0) AS n
        FROM (SELECT DISTINCT as_of, location_id FROM v_estimates) g
        JOIN v_baskets v ON g.as_of BETWEEN v.effective_from AND coalesce(v.effective_to, date '9999-12-31')
        JOIN v_basket_items b ON b.version = v.version
        LEFT JOIN v_estimates e ON e.as_of = g.as_of AND e.location_id = g.location_id AND e.item = b.item
        LEFT JOIN (SELECT as_of, item, MED(value) AS median FROM v_estimates GROUP BY as_of, item) m ON m.as_of = g.as_of AND m.item = b.item""",
    "v_snapshots": """
        SELECT as_of, location_id, version, R4(sum(quantity * price)) AS cost_local,
            R4(sum(CASE WHEN NOT is_imputed THEN weight ELSE 0.0e0 END) / sum(weight)) AS coverage_pct,
            R4(sum(CASE WHEN is_imputed AND price IS NOT NULL THEN weight ELSE 0.0e0 END) / sum(weight)) AS imputed_share,
            count(price) AS n_items
        FROM v_filled GROUP BY as_of, location_id, version""",
    "v_units": "SELECT 'kg' AS unit, 1000.0e0 AS factor UNION ALL SELECT 'g' AS unit, 1.0e0 AS factor UNION ALL SELECT 'l' AS unit, 1000.0e0 AS factor",
    "v_items": "SELECT item, CASE WHEN quantity > 4 THEN 'kg' WHEN quantity > 2 THEN 'g' ELSE 'l' END AS unit FROM v_basket_items WHERE version = 1",
    # Pairs of different locations of one region; as many as the regions' locations allow, whatever the observations.
    "v_distances": """
        SELECT a.location_id AS a, b.location_id AS b, 2 * 6371.0088e0 * asin(least(1.0e0, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2)
            + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) AS km
        FROM v_locations a JOIN v_locations b ON a.admin1_id = b.admin1_id AND a.location_id <> b.location_id""",
    # An item's local median against all locations' of 30 days.
    "v_levels": """
        SELECT l.location_id, l.item, l.median / n.median AS ratio
        FROM (SELECT location_id, item, MED(unit_price) AS median FROM v_obs WHERE is_valid AND observed_on BETWEEN date '1998-03-01' AND date '1998-03-30' GROUP BY location_id, item) l
        JOIN (SELECT item, MED(unit_price) AS median FROM v_obs WHERE is_valid AND observed_on BETWEEN date '1998-03-01' AND date '1998-03-30' GROUP BY item) n ON n.item = l.item WHERE n.median > 0""",
    # One rate a day: the manual one first; a side that is missing gives way to the other.
    "v_rates": """
        SELECT rate_date, coalesce(parallel_rate, official_rate) AS rate, official_rate, parallel_rate FROM (
            SELECT *, row_number() OVER (PARTITION BY rate_date ORDER BY CASE WHEN is_manual THEN 0 ELSE 1 END, source) AS k FROM v_fx) x
        WHERE k = 1""",
}

# What differs between the dialects, as (pattern, Spark, DuckDB).
_DIALECT = [
    (r"\bDAYS\(([^(),]+), ([^(),]+)\)", r"datediff(\1, \2)", r"date_diff('day', \2, \1)"),
    (r"\bADD\((max\(\w+\)), (-?\d+)\)", r"date_add(\1, \2)", r"(\1 + \2)"),
    (r"\bADD\(([^(),]+), ([^(),]+)\)", r"date_add(\1, cast(\2 AS int))", r"(\1 + cast(\2 AS integer))"),
    (r"\bMED\(([^()]+)\)", r"percentile(\1, 0.5)", r"quantile_cont(\1, 0.5)"),
    (r"\bQ\(([^(),]+), ([0-9.]+)\)", r"percentile(\1, \2)", r"quantile_cont(\1, \2)"),
    (r"\bSHA256\((.*?\)\))\)", r"substring(sha2(\1, 256), 1, 32)", r"substring(sha256(\1), 1, 32)"),
    (r"\bDIGEST\(([^()]+)\)", r"sha2(\1, 256)", r"sha256(\1)"),
    (r"\bFAIL\(", "raise_error(", "error("),
    (r"\bMATCHES\(", "regexp_like(", "regexp_matches("),
    (r"\bCHARS\b", "string", "varchar"),
    (r"\bJSON\(([^(),]+), ('[^']*')\)", r"get_json_object(\1, \2)", r"json_extract_string(\1, \2)"),
    (r"\bLOCALDAY\(([^(),]+), ('[^']*')\)", r"cast(convert_timezone('UTC', \2, \1) AS date)", r"cast(\1 AT TIME ZONE 'UTC' AT TIME ZONE \2 AS date)"),
    (r"\bLATER\(([^(),]+), (\([^()]*\) % \d+|-?\d+)\)", r"timestampadd(MINUTE, cast(\2 AS int), \1)", r"(\1 + to_minutes(cast(\2 AS integer)))"),
    (r"\bSEEN30\(v_obs\)", "(SELECT *, explode(sequence(observed_on, date_add(observed_on, 30))) AS seen_on FROM v_obs)", "(SELECT *, cast(unnest(generate_series(cast(observed_on AS timestamp), cast(observed_on + 30 AS timestamp), interval 1 day)) AS date) AS seen_on FROM v_obs)"),
    (r"\bSEENRATE\(v_rates\)", "(SELECT *, explode(sequence(rate_date, date_add(rate_date, 7))) AS seen_on FROM v_rates)", "(SELECT *, cast(unnest(generate_series(cast(rate_date AS timestamp), cast(rate_date + 7 AS timestamp), interval 1 day)) AS date) AS seen_on FROM v_rates)"),
    (r"\bNUMBERS\((\d+)\)", r"(SELECT cast(id AS int) AS draw FROM range(\1)) numbers", r"(SELECT cast(range AS integer) AS draw FROM range(\1)) numbers"),
    (r"\bJOINED\(([^()]+)\)", r"listagg(\1, ',') WITHIN GROUP (ORDER BY \1)", r"string_agg(\1, ',' ORDER BY \1)"),
    (r"\bWEEKDAY\(([^()]+)\)", r"(dayofweek(\1) - 1)", r"dayofweek(\1)"),
]


def _rounded(sql: str) -> str:
    """Rn(x) to n decimals, on the same double operations in both engines; a hair above half, so sums in another order round alike at ties."""
    while m := re.search(r"\bR([246])\(", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x, scale = sql[m.end() : end - 1], f"1e{m[1]}"
        sql = f"{sql[: m.start()]}(sign({x}) * floor(abs({x}) * {scale} + 0.5001e0) / {scale}){sql[end:]}"
    return sql


def rendered(sql: str, spark: bool) -> str:
    # A window join: an observation is repeated for the days that see it, and these join by equality.
    if spark:
        sql = sql.replace("FROM v_obs o JOIN v_days d ON d.as_of = ANYDAY(o.observed_on)", "FROM (SELECT *, explode(sequence(observed_on, date_add(observed_on, 7))) AS seen_on FROM v_obs) o JOIN v_days d ON d.as_of = o.seen_on")
    else:
        sql = sql.replace("d.as_of = ANYDAY(o.observed_on)", "o.observed_on BETWEEN d.as_of - 7 AND d.as_of")
    for pattern, for_spark, for_duckdb in _DIALECT:
        sql = re.sub(pattern, for_spark if spark else for_duckdb, sql)
    return _rounded(sql)


def needed(sql: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def uses(sql: str, view: str) -> bool:
    """Whether the SQL reads the view, itself or through others."""
    return any(n == view or uses(VIEWS[n], view) for n in needed(sql, list(VIEWS)))


def with_views(sql: str, spark: bool, sf_dir: str = "", kept: dict[str, str] | None = None) -> str:
    """The query with the views that it needs, and for Spark the tables, as common table expressions. kept: views that are stored, with their folders."""
    views: list[str] = []
    kept = kept or {}
    todo = needed(sql, list(VIEWS))
    while todo:
        name = todo.pop()
        if name not in views:
            views.append(name)
            todo += [] if name in kept else needed(VIEWS[name], list(VIEWS))
    ordered = [n for n in VIEWS if n in views]
    text = {n: f"SELECT * FROM parquet.`{kept[n]}`" if n in kept else rendered(VIEWS[n], spark) for n in ordered}
    parts = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in needed(" ".join([sql, *(v for n, v in text.items() if n not in kept)]), TABLES)] if spark else []
    parts += [f"{n} AS ({text[n]})" for n in ordered]
    return (f"WITH {', '.join(parts)} " if parts else "") + rendered(sql, spark)
