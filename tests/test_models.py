"""Exact medians, isolation forest, quantile boosting, the model store and nowcasting against plain Python."""

from __future__ import annotations

import datetime
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewell.models import boosting, forest, nowcast, store
from pricewell.models.quantiles import exact_quantile
from pricewell.operators import anomaly, medians
from pricewell.operators import nowcast as cells_of

DAY = datetime.date(2024, 1, 1)


def day(n: int) -> datetime.date:
    return DAY + datetime.timedelta(n)


def test_medians_without_own(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"g": rng.integers(0, 5, 400), "m": rng.integers(0, 9, 400), "v": rng.integers(0, 50, 400) / 4})
    rows.loc[len(rows)] = [9, 1, 3.0]  # alone in its group
    df = spark.createDataFrame(rows.astype({"g": int, "m": int}))
    wanted = spark.createDataFrame([(g, m) for g in (0, 1, 9, 77) for m in (0, 1, 50)], "g long, m long")
    for cells in (None, wanted):
        got = {(r["g"], r["m"]): (r["n"], r["median"]) for r in medians.without_own(df, ["g"], ["m"], "v", cells).collect()}
        assert len(got) == (rows[["g", "m"]].drop_duplicates().shape[0] if cells is None else 12)
        for (g, m), (n, median) in got.items():
            others = rows[(rows.g == g) & (rows.m != m)].v
            assert n == len(others) and (median == np.median(others) if n else median is None)
    assert medians.without_own(df.where("false"), ["g"], ["m"], "v").count() == 0


@pytest.mark.parametrize("ranges", [2, 64])
def test_sliding_medians(spark, monkeypatch, ranges):
    monkeypatch.setattr(medians, "RANGES", ranges)
    rng = np.random.default_rng(2)
    rows = [(int(k), day(int(d)), round(float(v), 1)) for k, d, v in zip(rng.integers(0, 3, 1500), rng.integers(0, 60, 1500), rng.normal(10, 3, 1500), strict=True)] + [(3, day(5), None), (4, None, 1.0), (5, day(9), 2.5)]
    got = {(r["k"], r["as_of"]): (r["n"], r["median"]) for r in medians.sliding_median(spark.createDataFrame(rows, "k int, d date, v double"), ["k"], "d", "v", 7).collect()}
    want = {}
    for k in range(6):
        for i in range(70):
            seen = [v for a, d, v in rows if a == k and d is not None and v is not None and day(i - 7) <= d <= day(i)]
            if seen:
                want[k, day(i)] = (len(seen), float(np.median(seen)))
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert {k: m for k, (_, m) in got.items()} == pytest.approx({k: m for k, (_, m) in want.items()})


@pytest.mark.parametrize(("n", "share"), [(1, 0.5), (2, 0.3), (1000, 0.05), (5001, 0.999), (300, 0.0), (300, 1.0)])
def test_exact_quantile(spark, n, share):
    values = np.random.default_rng(n).normal(0, 1, n).round(2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    assert exact_quantile(df, "v", share) == pytest.approx(np.quantile(values, share))
    assert exact_quantile(df.where("false"), "v", share) is None


OBSERVED = "location_id long, item string, observed_on date, unit_price double, reporter_id long, is_valid boolean, copy string"


def test_anomaly_context(spark):
    """Peers are those of 7 days that are valid, without the observation but with its twin; the reference is the item's of 90 days."""
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice("ab"), day(rng.randrange(120)), rng.randrange(4, 40) / 4, rng.randrange(4), rng.random() < 0.7, "clash") for _ in range(500)]
    rows += rows[:40]  # twins
    got = sorted(map(tuple, anomaly.context(spark.createDataFrame(rows, OBSERVED)).drop("copy").collect()), key=repr)
    want = []
    for i, (place, item, on, price, who, valid, _) in enumerate(rows):
        peers = [r[3] for j, r in enumerate(rows) if j != i and r[:2] == (place, item) and r[5] and on - datetime.timedelta(7) <= r[2] <= on]
        past = [r[3] for r in rows if r[1] == item and r[5] and on - datetime.timedelta(90) <= r[2] <= on]
        median = float(np.median(peers)) if peers else None
        want.append((place, item, on, who, price, valid, len(peers), median, float(np.median(np.abs(np.array(peers) - median))) if peers else None, float(np.median(past)) if past else None))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:7] == b[:7] and list(a[7:]) == [x if x is None else pytest.approx(x) for x in b[7:]]
    assert anomaly.context(spark.createDataFrame([], OBSERVED)).count() == 0


def test_anomaly_layers(spark):
    cases = [(650.0, 10, 6.5, 0.2, 6.5), (9.1, 10, 6.5, 5.0, 6.5), (0.0065, 3, 6.5, 0.1, 6.5), (20.0, 8, 10.0, 0.0, None), (12.0, 8, 10.0, 0.0, 0.0)]
    df = spark.createDataFrame(cases, "p double, n long, m double, mad double, r double")
    c = {x: F.col(x) for x in df.columns}
    got = [tuple(r) for r in df.select(anomaly.bounds(c["p"], c["r"]), anomaly.robust(c["p"], c["n"], c["m"], c["mad"])).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (1.0, 0.0), (0.0, 0.6), (0.0, 0.0)]
    rounded = spark.createDataFrame([(100.0,), (50.0,), (9.73,), (0.0,), (7.0,), (15.0,), (30.0,)], "p double").select(anomaly.roundness(F.col("p")).alias("r"))
    assert [r["r"] for r in rounded.collect()] == [1.0, 0.9, 0.0, 0.0, 0.3, 0.5, 0.7]


def test_forest_finds_what_is_set_apart(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (2000, 3))
    x[:40] += rng.choice([-1, 1], (40, 3)) * 6
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(row=range(2000), forest="clash"))
    fitted = forest.fit(df, list("abc"))
    assert len(fitted.trees) == forest.TREES and fitted.sample == 256 and fitted.depth == 8
    plain = forest.plain_score(fitted, x)
    assert fitted.offset == pytest.approx(np.quantile(plain, 0.05))  # of all rows, exactly
    got = {r["row"]: r["forest"] for r in forest.score(df, fitted).collect()}
    want = np.where(plain < fitted.offset, np.minimum(1.0, 4 * (fitted.offset - plain)), 0.0)
    assert [got[i] for i in range(2000)] == pytest.approx(want.tolist())
    assert (want[:40] > 0).mean() == 1.0 and (want[40:] > 0).mean() < 0.04
    again = forest.fit(df.repartition(7), list("abc"))
    assert again.offset == fitted.offset and all((a.cut == b.cut).all() for a, b in zip(fitted.trees, again.trees, strict=True))


def test_forest_of_one_tree_by_hand(spark):
    """The path of a row is the number of cuts above its leaf and what an unsplit leaf of several rows adds."""
    tree = forest.grow(np.array([[0.0], [1.0], [1.0], [9.0]]), 2, 5)
    held = forest.Forest(["a"], [tree], 2, 4, 0.0, 4)
    depths = -np.log2(-forest.plain_score(held, np.array([[0.0], [1.0], [9.0]]))) * float(forest.expected_depth(4))
    assert sorted(depths.round(6).tolist()) in ([1.0, 2.0, 3.0], [1.0, 3.0, 3.0]) or depths.min() == pytest.approx(1.0)
    assert forest.expected_depth(np.array([1, 2])).tolist() == [0.0, 1.0] and float(forest.expected_depth(256)) == pytest.approx(10.244771, abs=1e-6)


def test_forest_edges(spark):
    few = spark.createDataFrame([(1.0, None)] * 49, "a double, b double")
    assert forest.fit(few, ["a", "b"]) is None and {r["forest"] for r in forest.score(few, None).collect()} == {0.0}
    same = few.union(few)
    fitted = forest.fit(same, ["a", "b"])
    assert {r["forest"] for r in forest.score(same, fitted).collect()} == {0.0} and forest.score(same.where("false"), fitted).count() == 0


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (3000, 3))
    y = np.where(x[:, 0] > 0.5, 2, 1) + x[:, 1] + rng.normal(0, 0.1 + 0.3 * x[:, 2])
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "y"])).repartition(3)
    return boosting.fit(df, ["a", "b", "c"], "y", [0.05, 0.5, 0.95], rounds=12, rate=0.3), df, x, y


def test_boosting_learns_quantiles(spark, fitted):
    model, _, _, _ = fitted
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (4000, 3))
    y = np.where(x[:, 0] > 0.5, 2, 1) + x[:, 1] + rng.normal(0, 0.1 + 0.3 * x[:, 2])
    at = np.sort(boosting.estimates(model.start, model.trees, boosting.binned(x, model.cuts)), axis=1)
    for i, q in enumerate(model.quantiles):  # held out
        assert abs((y <= at[:, i]).mean() - q) < 0.035
    assert np.abs(y - at[:, 1]).mean() < 0.45 * np.abs(y - np.median(y)).mean()


def test_first_tree_equals_a_plain_one(fitted):
    """Splits and leaf values of the first round, from all rows in memory."""
    model, _, x, y = fitted
    bins = boosting.binned(x, model.cuts)
    for q, (quantile, tree) in enumerate(zip(model.quantiles, model.trees[0], strict=True)):
        above = y > model.start[q]

        def split(node, rows, tree=tree, above=above, quantile=quantile, q=q):
            if tree.feature[node] < 0:
                residual = np.quantile(y[rows] - model.start[q], quantile, method="inverted_cdf") * 0.3
                assert tree.value[node] == pytest.approx(residual, rel=0.03, abs=1e-6)
                return
            n = np.stack([np.bincount(bins[rows, f], minlength=64) for f in range(3)])
            up = np.stack([np.bincount(bins[rows, f][above[rows]], minlength=64) for f in range(3)])
            assert boosting.best_split(n, up, quantile, 20) == (tree.feature[node], tree.bin[node])
            left = bins[rows, tree.feature[node]] <= tree.bin[node]
            split(2 * node + 1, rows[left])
            split(2 * node + 2, rows[~left])

        split(0, np.arange(len(y)))


def test_boosting_edges(spark, fitted):
    model, df, x, _ = fitted
    assert boosting.fit(df.limit(199), ["a"], "y", [0.5]) is None
    rows = spark.createDataFrame([(0.9, None, 0.1, "clash"), (None, None, None, None)], "a double, b double, c double, quantiles string")
    out = [r["quantiles"] for r in boosting.predict(rows, model).collect()]
    want = np.sort(boosting.estimates(model.start, model.trees, boosting.binned(np.array([[0.9, 0.0, 0.1], [0.0, 0.0, 0.0]]), model.cuts)), axis=1)
    assert np.allclose(out, want) and all(q == sorted(q) for q in out)
    assert boosting.predict(rows.where("false"), model).count() == 0


def test_residual_quantile():
    r = np.random.default_rng(5).normal(0, 2, 5000)
    counts = np.bincount(boosting._residual_bin(r, 1e-7), minlength=2 * boosting.RESIDUALS)
    for q in (0.05, 0.5, 0.95):
        assert boosting.residual_quantile(counts, q, 1e-7) == pytest.approx(np.quantile(r, q), rel=0.03, abs=0.01)


def test_store_keeps_versions_and_refuses_others(spark, fitted, tmp_path):
    model, folder = fitted[0], f"file://{tmp_path}/models"
    with pytest.raises(FileNotFoundError):
        store.load(spark, folder, "m", {})
    for _ in range(2):
        store.save(spark, folder, "m", *boosting.parts(spark, model))
    (tmp_path / "models/m/v000003/parts").mkdir(parents=True)  # begun, never finished
    assert store.versions(spark, folder, "m") == [1, 2]
    back = boosting.from_parts(*store.load(spark, folder, "m", {"features": ["a", "b", "c"], "quantiles": [0.05, 0.5, 0.95]}))
    assert back.cuts == model.cuts and back.rows == model.rows
    assert all((p.value == q.value).all() and (p.feature == q.feature).all() for a, b in zip(back.trees, model.trees, strict=True) for p, q in zip(a, b, strict=True))
    for wrong in ({"features": ["b", "a", "c"]}, {"quantiles": [0.1, 0.5, 0.9]}):
        with pytest.raises(store.IncompatibleModel):
            store.load(spark, folder, "m", wrong)
    with pytest.raises(store.IncompatibleModel):
        store.save(spark, folder, "nowcast-XTS", *boosting.parts(spark, model))
        nowcast.load(spark, folder, "XTS")
    assert store.save(spark, folder, "m", *boosting.parts(spark, model)) == 4  # never over a begun one


LOCATIONS = "location_id long, latitude double, longitude double"


def _features(spark, rows, cells, rates=(), places=((1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 3.0), (4, 50.0, 50.0))):
    made = cells_of.features(
        spark.createDataFrame(cells, "location_id long, item string, as_of date"),
        spark.createDataFrame([(*r, True) for r in rows], "location_id long, item string, observed_on date, unit_price double, reporter_id long, is_valid boolean"),
        spark.createDataFrame(list(places), LOCATIONS),
        spark.createDataFrame(list(rates), "rate_date date, rate double"),
    )
    return {(r["location_id"], r["item"], r["as_of"]): r.asDict() for r in made.collect()}


ROWS = [(1, "rice", day(20), 99.0, 1), (2, "rice", day(20), 10.0, 1), (3, "rice", day(14), 20.0, 1), (4, "rice", day(19), 40.0, 1), (1, "rice", day(12), 7.0, 1), (1, "rice", day(12), 8.0, 2), (2, "rice", day(8), 5.0, 1), (1, "oil", day(18), 30.0, 1), (2, "oil", day(1), 15.0, 1), (3, "oil", day(2), 15.0, 1)]


def test_nowcast_features_by_hand(spark):
    rates = [(day(-20), 4.0), (day(15), 5.0), (day(21), 9.0)]
    f = _features(spark, ROWS, [(1, "rice", day(20)), (9, "tea", day(20))], rates)
    got = f[1, "rice", day(20)]
    away = [2 * 6371.0088 * np.arcsin(np.sqrt(np.sin(np.radians(la / 2)) ** 2 + np.cos(np.radians(la)) * np.sin(np.radians(lo / 2)) ** 2)) for la, lo in ((0.0, 1.0), (0.0, 3.0), (50.0, 50.0))]
    assert got["national_median"] == 20.0 and got["neighbour_count"] == 3.0 and got["neighbour_median"] == 20.0
    assert got["nearest_neighbour_km"] == pytest.approx(away[0], abs=1e-3)
    assert got["neighbour_weighted"] == pytest.approx(sum(p / (1 + d) for p, d in zip((10, 20, 40), away, strict=True)) / sum(1 / (1 + d) for d in away))
    assert (got["last_local_price"], got["days_since_local"]) == (8.0, 8.0)  # strictly before the day
    assert got["national_trend"] == pytest.approx(20.0 / 5.0) and got["fx_change_30d"] == 1.25
    assert got["location_price_level"] == 2.0 and got["day_of_week"] == float(day(20).isoweekday() % 7)
    assert list(f[9, "tea", day(20)].values())[3:] == [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 60.0, 1.0, 1.25, 1.0, 0.0 + day(20).isoweekday() % 7]


def test_no_feature_moves_with_later_rows_or_the_own_price(spark):
    cells = [(1, "rice", day(20)), (2, "rice", day(15)), (4, "oil", day(20))]
    before = _features(spark, ROWS, cells)
    later = [(p, i, day(n), 1e6, 9) for p in (1, 2, 3, 4) for i in ("rice", "oil") for n in range(21, 60)]
    own = [(1, "rice", day(20), 1e6, 9), (2, "rice", day(15), 1e6, 9), (4, "oil", day(20), 1e6, 9)]
    assert _features(spark, ROWS + later, [c for c in cells if c[2] == day(20)]) == {k: v for k, v in before.items() if k[2] == day(20)}
    after = _features(spark, ROWS + own[:1], cells[:1])
    assert after[cells[0]] == before[cells[0]]


def test_nearest_reporters_beyond_the_first_places(spark, monkeypatch):
    """With two places looked at first, four times eight are looked at next; the answer is the same. Places without coordinates count alike."""
    places = [(i, 0.0, float(i)) for i in range(30)] + [(77, None, None)]
    rows = [(i, "rice", day(20), float(i), 1) for i in range(15, 30)] + [(77, "rice", day(20), 500.0, 1)]
    cells = [(0, "rice", day(20)), (16, "rice", day(20)), (77, "rice", day(20))]
    whole = _features(spark, rows, cells, places=places)
    monkeypatch.setattr(cells_of, "NEAR", 2)
    assert _features(spark, rows, cells, places=places) == whole
    assert whole[0, "rice", day(20)]["neighbour_median"] == 17.0 and whole[16, "rice", day(20)]["neighbour_median"] == 18.0
    assert whole[77, "rice", day(20)]["neighbour_median"] == 22.0 and whole[77, "rice", day(20)]["neighbour_count"] == 15.0 and whole[77, "rice", day(20)]["nearest_neighbour_km"] == 0.0


def _rows_with(spark, n, slope):
    rng = np.random.default_rng(n)
    columns = {c: rng.uniform(0.5, 1.5, n) for c in cells_of.FEATURES}
    columns["national_median"] = rng.uniform(5, 50, n)
    columns["price"] = columns["national_median"] * (1 + slope * (columns["location_price_level"] - 1)) * rng.lognormal(0, 0.05, n)
    return spark.createDataFrame(pd.DataFrame(columns))


def test_nowcast_beats_the_national_median_and_covers(spark):
    rows = _rows_with(spark, 3000, 0.8)
    model = nowcast.train(rows, rounds=15, rate=0.3)
    figures = nowcast.evaluate(nowcast.impute(_rows_with(spark, 2000, 0.8), model)).first()
    assert figures["n"] == 2000 and figures["fallback_share"] == 0.0
    assert figures["mape"] < 0.5 * figures["baseline_mape"] and nowcast.NOMINAL <= figures["coverage"] <= 0.97
    assert nowcast.train(rows.limit(199)) is None


def test_impute_falls_back(spark):
    base = dict.fromkeys(cells_of.FEATURES, 0.0)
    cases = [base | {"neighbour_median": 10.0, "national_median": 50.0, "location_price_level": 2.0}, base | {"national_median": 50.0}, base]
    out = [(r["value"], r["lower"], r["upper"], r["method"]) for r in nowcast.impute(spark.createDataFrame(pd.DataFrame(cases)), None).collect()]
    assert out == [(20.0, 14.0, 26.0, nowcast.NEAR), (50.0, 27.5, 72.5, nowcast.NATIONAL)]


def test_medians_of_groups_by_sql(spark):
    rows = [(i % 7, float(i * 31 % 101) if i % 11 else None) for i in range(600)]
    got = sorted(map(tuple, medians.median_of(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()))
    frame = pd.DataFrame(rows, columns=["g", "v"])  # noqa: F841
    assert got == sorted(duckdb.sql("SELECT g, count(v), median(v) FROM frame WHERE v IS NOT NULL GROUP BY g").fetchall())
