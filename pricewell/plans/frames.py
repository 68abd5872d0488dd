"""Queries that apply the DataFrame operators to the star schema; with the DuckDB SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators import bootstrap, matching
from pricewell.sources import partner_files
from pricewell.sources.adapters import with_views

UNITS = [("kg", "g", 1000.0, ["kilogram"]), ("g", "g", 1.0, ["gram"]), ("l", "ml", 1000.0, ["litre"]), ("ml", "ml", 1.0, [])]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(with_views(sql, True, sf_dir))


def _r4(c) -> F.Column:
    return F.signum(c) * F.floor(F.abs(c) * 1e4 + 0.5001) / 1e4


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as partners type them: six forms and spreadsheet day numbers."""
    day = F.col("o_orderdate").cast("date")
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy"]
    typed = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    for i, form in enumerate(forms):
        typed = F.when(F.col("o_orderkey") % 6 == i, F.date_format(day, form)).otherwise(typed)
    return _table(spark, sf_dir, "orders").select("o_orderkey", partner_files.parse_date(typed).alias("day"))


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = matching.tokens(F.lower("name"))
    return _view(spark, sf_dir, "SELECT DISTINCT p_type AS name FROM part").select("name", F.array_join(words, "|").alias("words"), F.size(words).cast("long").alias("n"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("kg"), F.lit(" gram"), F.lit("ml"), F.lit(" Litre")), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.col("p_brand"), F.lit(": "), F.col("p_size").cast("string"), unit, F.lit(" pack"))
    parts = _table(spark, sf_dir, "part").withColumn("s", matching.parse_sizes(text, UNITS))
    first = F.element_at("s", -1)
    return parts.select("p_partkey", first["quantity"].alias("quantity"), first["unit"].alias("unit"), matching.size_adjustment(F.col("s"), F.lit(20_000.0), F.lit("g")).alias("adjustment"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = matching.vector_knn(vectors.where("id % 50 = 0"), vectors, 5)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), _r4(F.col("score")).alias("score"))


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities, one letter short, against three catalogued ones."""
    texts = _view(spark, sf_dir, "SELECT DISTINCT substring(raw_text, 2) AS text FROM v_reviews")
    return matching.lexical_search(texts, _view(spark, sf_dir, "SELECT item, variant FROM v_variants"), 3)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.bootstrap(_view(spark, sf_dir, "SELECT location_id, item, as_of, unit_price, weight FROM v_windowed"))


def estimates_with_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5 and 97.5 percentiles of each cell's 500 bootstrap estimates."""
    s = F.array_sort("samples")
    at = lambda p: F.element_at(s, F.round(p * (F.size("samples") - 1)).cast("int") + 1)
    return _cells(spark, sf_dir).select("location_id", "item", "as_of", at(0.025).alias("lo"), at(0.975).alias("hi"), F.size("samples").alias("draws"))


def costs_with_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot's basket cost with its interval; imputed items give 70, 100 and 130 % of their price in turn."""
    items = _view(spark, sf_dir, "SELECT as_of, location_id, version, item, quantity, price, is_imputed FROM v_filled WHERE price IS NOT NULL")
    spread = F.array(F.col("price") * 0.7, F.col("price"), F.col("price") * 1.3)
    parts = items.join(_cells(spark, sf_dir), ["as_of", "location_id", "item"], "left").withColumn("samples", F.coalesce("samples", spread))
    keys = ["as_of", "location_id", "version"]
    return bootstrap.basket_interval(parts, keys).join(parts.groupBy(*keys).agg(F.sum(F.col("quantity") * F.col("price")).alias("cost_local")), keys)


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "b24_parse_date": (dates, "SELECT o_orderkey, cast(o_orderdate AS date) AS day FROM orders"),
    "i2_tokenise": (tokenised, "SELECT name, array_to_string(words, '|') AS words, len(words) AS n FROM (SELECT p_type AS name, list_filter(string_split(lower(p_type), ' '), lambda w: w <> '') AS words FROM (SELECT DISTINCT p_type FROM part) p) x"),
    "i10_parse_sizes": (
        sizes,
        """SELECT p_partkey, quantity, unit, CASE WHEN unit <> 'g' OR quantity <= 0 THEN 0.0 WHEN greatest(quantity, 20000) / least(quantity, 20000) <= 1.4 THEN 0.05
            WHEN greatest(quantity, 20000) / least(quantity, 20000) >= 3 THEN -0.12 ELSE 0.0 END::DOUBLE AS adjustment
        FROM (SELECT p_partkey, (p_size * CASE WHEN p_partkey % 4 IN (0, 3) THEN 1000 ELSE 1 END)::DOUBLE AS quantity, CASE WHEN p_partkey % 4 < 2 THEN 'g' ELSE 'ml' END AS unit FROM part) x""",
    ),
    "c16_vector_knn": (
        nearest,
        """SELECT query_id, id, rank, R4(score) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, c.score, row_number() OVER (PARTITION BY q.vec_id ORDER BY c.score DESC, v.vec_id) AS rank
        FROM embeddings q, embeddings v, LATERAL (SELECT list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score) c WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) x WHERE rank <= 5""",
    ),
}

#: Queries that SQL can't check; tests compare them with plain Python.
UNCHECKED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "c15_fuzzy_text": lexical,
    "d13_bootstrap": estimates_with_spread,
    "i34_cost_interval": costs_with_interval,
}
