"""Every catalogue query against its DuckDB SQL, and hand-computed cases of the operators."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewell.operators import bootstrap, estimate, matching, text
from pricewell.plans import catalog, frames
from pricewell.sources import partner_files
from pricewell.sources.adapters import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    relation = duck.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == columns
    assert mine == sorted(repr(tuple(r)) for r in relation.select(*columns).fetchall())


def test_weighted_median(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, 1), ("a", 2.0, 1.0, 2), ("a", 9.0, 0.0, 3), ("b", 5.0, 1.0, 1), ("b", 7.0, 3.0, 2), ("c", -1.0, 1.0, 1)], "k string, v double, w double, t int")
    out = {r["k"]: (r["n"], r["value"]) for r in estimate.weighted_median(rows, ["k"], "v", "w", ["t"]).collect()}
    assert out == {"a": (2, 1.5), "b": (2, 7.0)}


def test_as_of_tolerance(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-12')) as as_of")
    rates = spark.sql("select date'2024-01-02' as rate_date, 5.0D as rate")
    out = {r["as_of"].day: (r["rate"], r["is_stale"]) for r in estimate.as_of(days, rates, 7).collect()}
    assert out[1] == (None, None) and out[2] == (5.0, False) and out[9] == (5.0, True) and out[10] == (None, None)


@pytest.mark.parametrize(("typed", "minor", "value"), [("1.234,50", 2, 1234.5), ("1,234.50", 2, 1234.5), ("1,234", 2, 1234.0), ("1,234", 3, None), ("12,5", 2, 12.5), ("٣٫٥", 2, 35.0), ("1234,567", 2, 1234567.0), ("1234,567", 3, None), ("1,234,567", 3, 1234567.0), ("1.234,567", 3, 1234.567), ("-5", 2, -5.0), ("", 2, None), ("x", 2, None)])
def test_parse_number(spark, typed, minor, value):
    assert spark.range(1).select(text.parse_number(F.lit(typed), minor).alias("v")).first()["v"] == value


def test_normalise(spark):
    cases = ["  Rice — 5 KG!! ", "أُرْز ٥", None, "400-gram 5%", "cafe\u0301"]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select(text.normalise(F.col("t")).alias("v"))
    assert [r["v"] for r in df.collect()] == ["rice 5 kg", "ارز 5", "", "400-gram 5", "caf\u00e9"]


def test_token_set_score():
    cases = [("white rice", "rice white", 1.0), ("rice", "white rice", 1.0), ("", "x", 0.0), ("abc", "abd", 4 / 6), ("a b", "c d", 2 * 1 / 6)]
    assert [round(matching.token_set_score(a, b), 6) for a, b, _ in cases] == [round(s, 6) for *_, s in cases]


def test_match_many(spark):
    variants = spark.createDataFrame([(1, "White Rice"), (1, "rice"), (2, "sunflower oil"), (3, "olive oil")], "item long, variant string")
    texts = spark.createDataFrame([("RICE",), ("rice",), ("oil",), ("sunflwr oil",), ("",), (None,), ("zzz",)], "text string")
    out = {r["text"]: (r["item"], r["action"]) for r in matching.match_many(texts, variants).collect()}
    assert out["RICE"] == (1, "auto_resolve") and out["oil"][1] != "auto_resolve" and out["sunflwr oil"][0] == 2
    assert out[""] == out[None] == out["zzz"] == (None, "reject")
    best = {(r["text"], r["item"]): r["score"] for r in matching.lexical_search(texts, variants).collect()}
    assert best["oil", 2] == best["oil", 3] == 1.0 and best["rice", 1] == 1.0


def test_fuse_and_calibrate(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 0.5)], "item long, score double")
    b = spark.createDataFrame([(2, 1.0), (3, 0.5)], "item long, score double")
    assert {r["item"]: round(r["fused"], 6) for r in matching.fuse(a, b, ["item"]).collect()} == {1: 0.4, 2: 0.8, 3: 0.3}
    assert {r["item"]: r["fused"] for r in matching.fuse(a, None, ["item"]).collect()} == {1: 1.0, 2: 0.5}
    rows = spark.range(400).select((F.col("id") / 400).alias("score"), (F.col("id") >= 200).cast("int").alias("label"))
    assert matching.fit_calibration(rows.limit(100)) is None and matching.fit_calibration(rows).boundaries.size > 1


@pytest.mark.parametrize(("text_", "expected"), [("flour 50kg", [(50_000.0, "g")]), ("tin 400 gram", [(400.0, "g")]), ("bottle 60 ml", [(60.0, "ml")]), ("oil 1.5 litre", [(1500.0, "ml")]), ("plain", []), (None, [])])
def test_parse_sizes(spark, text_, expected):
    row = spark.range(1).select(matching.parse_sizes(F.lit(text_).cast("string"), frames.UNITS).alias("s")).first()
    assert [(s["quantity"], s["unit"]) for s in row["s"]] == expected


def test_vector_knn_ties(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None)], "id long, vector array<double>")
    out = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in matching.vector_knn(rows.where("id in (1, 5)"), rows, 3).collect())
    assert out == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 4, 0.0)]


def test_bootstrap_brackets_and_repeats(spark):
    rows = [(1, "rice", 10.0 + i % 7, 1.0) for i in range(40)] + [(2, "oil", 5.0, 1.0), (2, "oil", 0.0, 1.0)]
    cells = spark.createDataFrame(rows, "location_id long, item string, unit_price double, weight double").withColumn("as_of", F.lit("1998-03-01").cast("date"))
    out = {r["location_id"]: r["samples"] for r in bootstrap.bootstrap(cells, 200).collect()}
    again = {r["location_id"]: r["samples"] for r in bootstrap.bootstrap(cells.repartition(5), 200).collect()}
    assert out == again and set(out[2]) == {5.0} and min(out[1]) >= 10.0 and max(out[1]) <= 16.0 and min(out[1]) < 13.0 < max(out[1])
    parts = spark.createDataFrame([(1, 2.0, [10.0] * 4), (1, 3.0, [4.0, 5.0, 6.0]), (2, 1.0, [])], "k long, quantity double, samples array<double>")
    [row] = bootstrap.basket_interval(parts, ["k"], 300).collect()
    assert (row["k"], row["lo"], row["hi"]) == (1, 32.0, 38.0)
    assert bootstrap.resampled(np.array([1.0, 2.0]), np.array([1.0, 3.0]), 50, 7).tolist() == bootstrap.resampled(np.array([1.0, 2.0]), np.array([1.0, 3.0]), 50, 7).tolist()


def test_partner_file(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Product;Price;Market;Unit;Date\nrice;6,50;ONE;kg;2026-03-15\n;5;one;kg;46081\noil;x;two;l;15/03/2026\noil;-1;nowhere;stone;bad\nmilk;٧;zwei\n")
    (tmp_path / "in.txt").write_text("a|b\n1|2\n")
    locations = spark.createDataFrame([(1, "one", "One", None), (2, "two", "Two", "Zwei")], "location_id long, slug string, name string, name_local string")
    now = F.lit("2026-08-01").cast("timestamp")
    raw = partner_files.read_delimited(spark, f"{tmp_path}/in.csv")
    assert [r["row_number"] for r in raw.collect()] == [2, 3, 4, 5, 6] and partner_files.read_delimited(spark, f"{tmp_path}/in.txt").columns == ["row_number", "a", "b"]
    rows = partner_files.validated(partner_files.mapped(raw, partner_files.guess_mapping(raw.columns[1:])), locations, ["kg", "l"], "xts", 2, now).collect()
    found = {r["row_number"]: [e["column"] for e in r["errors"]] for r in rows}
    assert found == {2: [], 3: ["item"], 4: ["price"], 5: ["price", "location", "unit", "observed_at"], 6: []}
    first = next(r for r in rows if r["row_number"] == 2)
    assert (first["price_value"], first["location_id"], first["currency"], str(first["observed_on"])) == (6.5, 1, "XTS", "2026-03-15")
    assert next(r for r in rows if r["row_number"] == 6)["location_id"] == 2
    load = lambda: partner_files.import_file(spark, f"{tmp_path}/in.csv", "shop", f"{tmp_path}/ledger", f"{tmp_path}/rows", locations, ["kg", "l"], "xts")
    one, two = load(), load()
    assert (one["status"], one["accepted"], one["rejected"], two["status"]) == ("partial", 2, 3, "already imported")
    keys = [r["row_key"] for r in spark.read.parquet(f"{tmp_path}/rows").collect()]
    assert len(set(keys)) == len(keys) == 2 and keys[0][14] == "5"
    with pytest.raises(ValueError, match="not a delimited file"):
        partner_files.read_delimited(spark, "x.xlsx")
