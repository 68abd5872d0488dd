"""Sliding windows in blocks of days against plain Python; queries over estimates keep them and repeat no row for each day of a window."""

from __future__ import annotations

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pricewell.operators import anomaly, medians, windows
from pricewell.plans import catalog, estimates

SF = "/root/testdata/sf0.001"
DAY = datetime.date(1969, 11, 20)  # day numbers below 0 as well

OVER_ESTIMATES = "a18_upsert a22_small_cells b12_quality_label b13_comparable b17_intensity b21_cost_usd c19_anchor_lookup c2_left_dims d14_basket_interval d19_link_factor d20_national_series d21_headline d22_coverage_report d23_method_share e2_latest_per_date i32_fallback i36_chain_link i41_location_series i41_map_points".split()


@pytest.fixture(scope="module")
def once(spark):
    return estimates.kept(spark, SF, estimates.DRAWS)


def day(n: int) -> datetime.date:
    return DAY + datetime.timedelta(n)


@pytest.mark.parametrize("name", OVER_ESTIMATES)
def test_no_row_for_each_day(spark, monkeypatch, once, name):
    monkeypatch.setattr(estimates, "kept", lambda *a: once)
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "observed_on" not in plan


def test_blocks_repeat_few_rows(spark):
    rows = spark.range(1000).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("observed_on"))
    assert windows.blocks(rows, 7).count() <= 1000 * (1 + 8 / windows.BLOCK)


@pytest.mark.parametrize("chunk", [1, windows.CHUNK])
def test_weighted_medians(spark, monkeypatch, chunk):
    monkeypatch.setattr(windows, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.choice("ab"), day(rng.randrange(90)), rng.randrange(4, 40) / 4, rng.choice([0.25, 0.5, 0.3])) for _ in range(400)]
    rows += [(9, "a", day(0), 1.0, 0.5), (9, "a", day(0), 3.0, 0.5), (9, "a", None, 3.0, 0.5)]  # two of one weight: their middle
    df = spark.createDataFrame(rows, "location_id long, item string, observed_on date, unit_price double, factor double")
    got = {(r["location_id"], r["item"], r["as_of"]): (r["n"], r["value"], r["lowest"]) for r in windows.weighted_medians(df, 7, 3.0, 2).collect()}
    want = {}
    for place, item in {r[:2] for r in rows}:
        for i in range(100):
            seen = sorted((p, f * 2.0 ** (-(day(i) - d).days / 3.0)) for a, b, d, p, f in rows if (a, b) == (place, item) and d and day(i - 7) <= d <= day(i))
            if not seen:
                continue
            half, running, found = sum(w for _, w in seen) / 2, 0.0, []
            for k, (p, w) in enumerate(seen):
                running += w
                if abs(running - half) <= 1e-12:
                    found.append((p + seen[min(k + 1, len(seen) - 1)][0]) / 2)
                elif running > half:
                    found.append(p)
            want[place, item, day(i)] = (len(seen), min(found), [p for p, _ in seen[:2]])
    assert got == want and got[9, "a", day(0)][1] == 2.0


def test_cuts_that_come_out_otherwise_each_time(spark, monkeypatch):
    """Approximate quantiles depend on the order of rows, so no two evaluations need agree."""
    drawn = F.udf(lambda top: sorted(random.uniform(0, top) for _ in range(15)), "array<double>").asNondeterministic()
    monkeypatch.setattr(medians.F, "percentile_approx", lambda value, *a: drawn(F.max(value)))
    rng = random.Random(5)
    rows = [(rng.randrange(2), day(rng.randrange(60)), rng.randrange(400) / 4) for _ in range(1200)]
    got = {(r["k"], r["as_of"]): r["median"] for r in medians.sliding_median(spark.createDataFrame(rows, "k int, d date, v double"), ["k"], "d", "v", 20).collect()}
    for (k, on), median in got.items():
        assert median == statistics.median(v for a, d, v in rows if a == k and on - datetime.timedelta(20) <= d <= on)
    assert len(got) == 160


def test_observations_without_place_or_day_are_kept(spark):
    rows = [(1, "a", day(3), 2.0, 1, True), (1, "a", day(4), 4.0, 1, True), (None, "a", day(4), 4.0, 1, True), (1, "a", None, 4.0, 1, True)]
    df = spark.createDataFrame(rows, "location_id long, item string, observed_on date, unit_price double, reporter_id long, is_valid boolean")
    got = sorted((str(r["location_id"]), str(r["observed_on"]), r["n_peers"], r["local_median"]) for r in anomaly.context(df).collect())
    assert got == [("1", str(day(3)), 0, None), ("1", str(day(4)), 1, 2.0), ("1", "None", 0, None), ("None", str(day(4)), 0, None)]


def test_place_medians(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), rng.choice("ab"), day(rng.randrange(70)), rng.randrange(400) / 4) for _ in range(500)]
    df = spark.createDataFrame(rows, "location_id long, item string, observed_on date, unit_price double")
    spans = {"now": (0, 3), "old": (4, 30)}
    got = {(r["item"], r["as_of"], r["location_id"]): r for r in windows.place_medians(df, spans).collect()}
    middle = lambda values: statistics.median(values) if values else None
    for (item, on, place), r in got.items():
        for name, (a, b) in spans.items():
            seen = [(x, p) for x, i, d, p in rows if i == item and a <= (on - d).days <= b]
            assert r[f"{name}_own"] == middle([p for x, p in seen if x == place]) and r[f"{name}_others"] == middle([p for x, p in seen if x != place])
    want = {(i, d + datetime.timedelta(k), x) for x, i, d, _ in rows for k in range(31)}
    assert set(got) == want | {(i, on, None) for i, on, _ in want}


def test_review_state_compares_no_pairs(spark):
    plan = catalog.QUERIES["i28_bias_review_state"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "l_extendedprice" not in plan
