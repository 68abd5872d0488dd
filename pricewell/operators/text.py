"""Text normalisation and number parsing as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Arabic-Indic and Persian digits, letters that fold, and signs that go.
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
LETTERS = ("أإآٱةىؤئ", "ااااهيوي")
DROPPED = "[\\u064B-\\u065F\\u0670\\u0640\\u0621]"


def _composed(text: Column) -> Column:
    def composed(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFC")

    # ASCII is composed already; a null in its place is all that such a text sends to Python.
    return F.coalesce(F.pandas_udf(composed, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalise(text: Column, composed: bool = False) -> Column:
    """Letters composed, digits to ASCII, marks dropped, letter variants folded, punctuation to blanks (. and - stay), lower case, single blanks.

    composed: the text is in composed form already, which saves a Python pass.
    """
    out = F.coalesce(text, F.lit(""))
    out = F.translate(F.translate(out if composed else _composed(out), *DIGITS), *LETTERS)
    out = F.regexp_replace(out, DROPPED, "")
    out = F.regexp_replace(F.lower(out), r"[^\p{L}\p{M}\p{N}_.\-\s]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def parse_number(text: Column, minor_units: int = 2) -> Column:
    """A price as typed: of both separators the last is the decimal one; a comma without a dot groups thousands before three last digits.

    One comma alone before three last digits is null where the currency has
    three minor units.
    """
    s = F.regexp_replace(F.translate(text, *DIGITS), r"[^0-9,.\-]", "")
    has_comma, has_dot = s.contains(","), s.contains(".")
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    grouped = s.rlike(r",[0-9]{3}$")
    plain = F.when(has_comma & has_dot & comma_last, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    plain = plain.when(has_comma & has_dot, F.replace(s, F.lit(","), F.lit("")))
    if minor_units == 3:
        plain = plain.when(s.rlike(r"^[^,]*,[0-9]{3}$"), F.lit(None).cast("string"))
    return plain.when(grouped, F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit("."))).try_cast("double")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    whole = F.floor(cents / 100).cast("long").cast("string")
    typed = F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", "."), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    return orders.select("o_orderkey", parse_number(typed).alias("price"))


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/part.parquet")
    return docs.select("p_partkey", normalise(F.concat(F.lit("  "), F.col("p_type"), F.lit(" — #٣٥ أرز ")))).toDF("p_partkey", "normalised")


FRAMES = {
    "b23_parse_number": (_numbers, "SELECT o_orderkey, floor(o_totalprice * 100 + 0.5) / 100 AS price FROM orders"),
    "i1_normalise": (_normalised, "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9.-]+', ' ', 'g'), ' +', ' ', 'g')) || ' 35 ارز' AS normalised FROM part"),
}
