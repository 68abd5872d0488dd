"""Partner price files: delimited text to mapped, checked rows, and a ledger that takes each file once."""

from __future__ import annotations

import hashlib
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators.text import parse_number
from pricewell.sources.scratch import released, stored

REQUIRED = ["item", "price", "location"]
# Headers that partners use, by field.
ALIASES = {
    "item": ["item", "product", "commodity", "item_name", "product_name", "goods", "السلعة", "المنتج"],
    "price": ["price", "unit_price", "cost", "amount", "value", "السعر"],
    "location": ["location", "market", "town", "city", "admin1", "district", "الموقع", "المدينة"],
    "unit": ["unit", "uom", "measure", "الوحدة"],
    "quantity": ["quantity", "qty", "pack_size", "size", "الكمية"],
    "observed_at": ["date", "observed_at", "observed", "survey_date", "التاريخ"],
    "currency": ["currency", "ccy", "العملة"],
    "external_id": ["id", "external_id", "record_id", "reference"],
}
# Date forms in the order they are tried.
DATE_FORMS = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy"]
DELIMITERS = ",;\t|"
#: Rows of a file at most; a longer file is refused whole.
MOST_ROWS = 250_000


def _header(name: str) -> str:
    return re.sub(r"[\W_]+", "_", name.strip().lower())


def guess_mapping(headers: list[str]) -> dict[str, str]:
    """field -> header, by the first alias that the file has."""
    have = {_header(h): h for h in headers}
    return {field: next(have[_header(a)] for a in names if _header(a) in have) for field, names in ALIASES.items() if any(_header(a) in have for a in names)}


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """The file's columns as text, with row_number counted from the header, which is 1. Blank rows are dropped, short ones filled with nulls."""
    if not path.lower().endswith((".csv", ".txt", ".tsv")):
        raise ValueError(f"not a delimited file: {path}")
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"an empty file: {path}")
    line = first["value"].lstrip("﻿")
    sep = max(DELIMITERS, key=line.count)
    names = [h.strip().strip('"').strip() for h in line.split(sep)]
    schema = ", ".join(f"`{n or f'column_{i + 1}'}` string" for i, n in enumerate(names))
    # A file stays in one split, so its rows are numbered in order.
    rows = spark.read.schema(schema).option("sep", sep).option("header", True).option("multiLine", True).option("enforceSchema", True).csv(path)
    numbered = rows.withColumn("row_number", F.monotonically_increasing_id() + 2)
    texts = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns]
    out = numbered.select("row_number", *texts)
    return out.where(F.coalesce(*(F.col(f"`{c}`") for c in rows.columns)).isNotNull())


def mapped(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """row_number and all fields as text; those without a column are null."""
    missing = [f for f in REQUIRED if f not in mapping]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return rows.select("row_number", *((F.col(f"`{mapping[f]}`") if f in mapping else F.lit(None).cast("string")).alias(f) for f in ALIASES))


def parse_date(text: Column) -> Column:
    """A spreadsheet's day number (five digits), else the first of DATE_FORMS that fits, else what a plain cast reads."""
    t = F.trim(text)
    serial = F.when(t.rlike(r"^\d{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), t.try_cast("int")))
    return F.coalesce(serial, *(F.try_to_timestamp(t, F.lit(f)).cast("date") for f in DATE_FORMS), F.when(~t.rlike(r"^\d+$"), t.try_cast("date")))


def resolve_location(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """rows with location_id: by name or local name, else by slug, in lower case. locations: location_id, slug, name, name_local; of one name the first slug."""
    name = F.lower(F.trim("location"))
    names = locations.select("location_id", "slug", F.explode(F.array("name", "name_local")).alias("key")).where("key is not null")
    by_name = names.groupBy(F.lower("key").alias("key")).agg(F.min_by("location_id", "slug").alias("by_name"))
    by_slug = locations.select(F.lower("slug").alias("key"), F.col("location_id").alias("by_slug"))
    out = rows.withColumn("_key", name)
    for table in (by_name, by_slug):
        out = out.join(table.withColumnRenamed("key", "_key"), "_key", "left")
    return out.withColumn("location_id", F.coalesce("by_name", "by_slug")).drop("_key", "by_name", "by_slug")


def validated(rows: DataFrame, locations: DataFrame, units: list[str], currency: str, minor_units: int = 2, now: Column | None = None) -> DataFrame:
    """Mapped rows with parsed values and errors, array<struct<row, column, message>>; a row is valid if it has none."""
    now = F.current_timestamp() if now is None else now
    t = resolve_location(rows, locations)
    t = t.withColumns({"price_value": parse_number(F.col("price"), minor_units), "quantity_value": parse_number(F.col("quantity"), minor_units), "observed_on": parse_date(F.col("observed_at"))})

    def error(column: str, when: Column, message: str) -> Column:
        return F.when(when, F.struct(F.col("row_number").alias("row"), F.lit(column).alias("column"), F.lit(message).alias("message")))

    col = F.col
    errors = F.array(
        error("item", col("item").isNull(), "Item is missing."),
        error("price", col("price").isNull(), "Price is missing."),
        error("price", col("price").isNotNull() & col("price_value").isNull(), "Price could not be read."),
        error("price", col("price_value") <= 0, "Price must be positive."),
        error("location", col("location").isNull(), "Location is missing."),
        error("location", col("location").isNotNull() & col("location_id").isNull(), "Location is not known."),
        error("unit", col("unit").isNotNull() & ~F.lower("unit").isin(units), "Unit is not known."),
        error("quantity", col("quantity").isNotNull() & (col("quantity_value").isNull() | (col("quantity_value") <= 0)), "Quantity must be a positive number."),
        error("observed_at", col("observed_at").isNotNull() & col("observed_on").isNull(), "Date could not be read."),
        error("observed_at", col("observed_on").cast("timestamp") > now + F.expr("interval 1 day"), "Date is in the future."),
    )
    filled = {"currency": F.upper(F.coalesce("currency", F.lit(currency))), "unit": F.lower("unit"), "errors": F.filter(errors, lambda e: e.isNotNull())}
    return t.withColumns(filled).withColumn("observed_on", F.coalesce("observed_on", now.cast("date")))


def row_key(checksum: Column, row: Column) -> Column:
    """The version-5 UUID of a batch's row, the same at each import."""

    def keys(c: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([str(uuid.uuid5(uuid.NAMESPACE_URL, f"batch:{a}:row:{b}")) for a, b in zip(c, n, strict=True)])

    return F.pandas_udf(keys, "string")(checksum, row.cast("long"))


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of the file's bytes; a partner file fits in memory."""
    return hashlib.sha256(spark.read.format("binaryFile").load(path).first()["content"]).hexdigest()


def import_file(spark: SparkSession, path: str, source: str, ledger: str, target: str, locations: DataFrame, units: list[str], currency: str, minor_units: int = 2) -> dict:
    """Appends a file's valid rows to ``target`` and a line to ``ledger`` (both Parquet folders); a file that the source gave before changes nothing.

    The rows lie in a folder of their file, by its checksum, and the ledger is
    written last: a run that died before is repeated whole and replaces them.
    """
    sha = checksum(spark, path)
    known = spark.read.schema("source string, sha256 string, status string, accepted long, rejected long").option("ignoreMissingFiles", True)
    try:
        seen = known.parquet(ledger).where((F.col("source") == source) & (F.col("sha256") == sha)).first()
    except Exception as e:  # the first import finds no ledger
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = None
    if seen:
        return {**seen.asDict(), "status": "already imported"}
    raw = read_delimited(spark, path)
    if raw.count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    rows = stored(validated(mapped(raw, guess_mapping([c for c in raw.columns if c != "row_number"])), locations, units, currency, minor_units), "partner-rows")
    counts = rows.agg(F.count_if(F.size("errors") == 0).alias("accepted"), F.count_if(F.size("errors") > 0).alias("rejected")).first()
    good = rows.where(F.size("errors") == 0).withColumn("row_key", row_key(F.lit(sha), F.col("row_number")))
    good.select("row_key", "item", F.col("price_value").alias("price"), "location_id", "currency", "unit", F.col("quantity_value").alias("quantity"), "observed_on", "external_id", F.lit(sha).alias("file")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(target)
    released(rows)
    status = "completed" if not counts["rejected"] else "partial" if counts["accepted"] else "failed"
    entry = (source, sha, status, counts["accepted"], counts["rejected"])
    spark.createDataFrame([entry], "source string, sha256 string, status string, accepted long, rejected long").write.mode("append").parquet(ledger)
    return dict(zip(["source", "sha256", "status", "accepted", "rejected"], entry, strict=True))
