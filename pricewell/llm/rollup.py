"""Operator 7: token totals kept by signed deltas, committed in idempotent batches.

A batch is a set of signed rows: an insert adds a document's count, a delete
takes it away, a revision takes the old count and adds the new one. Each batch
is summed by source, language and tokenizer version before it is stored, under
its own number in the shared folder; committing a number again replaces the same
rows by the same rows. Totals are sums over the stored batches, so the documents
are never read again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm.shared import trimmed
from pricewell.llm.tokens import ByteBpe

KEYS = ["source", "lang", "tokenizer_version"]
COUNTED = "doc_id long, source string, lang string, estimate long, n_tokens long, is_empty boolean"
STORED = "batch long, source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of docs: its token count, and a quarter of its bytes as a cheap first estimate. A null text is empty: no tokens."""

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteBpe(vocabulary)
        for batch in batches:
            for first, _, bounds in tokens.texts(batch.column(3)):
                part = batch.slice(first, len(bounds) - 1)
                size = pa.compute.fill_null(pa.compute.binary_length(part.column(3)), 0).cast(pa.int64())
                n = np.diff(bounds)
                yield pa.record_batch([*part.columns[:3], pa.compute.divide(pa.compute.add(size, 3), 4), pa.array(n), pa.compute.equal(size, 0)], names=[x.split()[0] for x in COUNTED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(task, COUNTED)


def signed(rows: DataFrame, version: str, docs: Column, tokens: Column) -> DataFrame:
    """Signed rows of a batch: docs and tokens are what each row adds."""
    return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


def changes(before: DataFrame, after: DataFrame, version: str) -> DataFrame:
    """Signed rows that lead from one table of counts (doc_id, source, lang, n_tokens) to another: inserts, deletes and revisions.

    doc_id is a key of both; a null key matches a null key.
    """
    old = before.select("doc_id", "source", "lang", F.lit(-1).alias("sign"), "n_tokens")
    new = after.select("doc_id", "source", "lang", F.lit(1).alias("sign"), "n_tokens")
    net = old.unionByName(new).groupBy("doc_id", "source", "lang").agg(F.sum("sign").alias("d"), F.sum(F.col("sign") * F.col("n_tokens")).alias("t"))
    return signed(net.where("d != 0 or t != 0"), version, F.col("d"), F.col("t"))


def commit(folder: str, batch: int, rows: DataFrame) -> None:
    """Stores a batch. Repeating it, also after it failed half-way, leaves the folder as one commit does."""
    sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sums.withColumn("batch", F.lit(batch).cast("long")).select("batch", *KEYS, "n_docs", "n_tokens").write.mode("overwrite").parquet(f"{folder}/batch-{batch:012d}")


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """Writes the sums of all batches as the only one of another folder."""
    commit(to, 0, totals(spark, folder))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """source, lang, tokenizer_version, n_docs, n_tokens; a null source or language is a group of its own, and groups without documents and tokens are left out."""
    rows = spark.read.schema(STORED).parquet(f"{folder}/batch-*")
    sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs != 0 or n_tokens != 0")
