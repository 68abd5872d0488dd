"""Corpus pipeline: documents through quality rules, near-duplicate and substring removal, decontamination, then packing.

All stages take an empty table to an empty one and carry other columns along,
whatever their names. A row without a doc_id can't be judged and goes in the
first stage. A verdict holds for all rows of its doc_id; rows that repeat a
doc_id become one in the second stage, the one with the least text (a null one
first), so ids are unique from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import decontaminate, jaccard, passages
from pricewell.llm.packing import pack
from pricewell.llm.quality import quality
from pricewell.llm.queries import BYTE_BPE, PIECE_BPE
from pricewell.llm.shared import released, small_batches, stored, table

#: Rows up to which a list of ids is broadcast.
BROADCAST_IDS = 1_000_000


def _restricted(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the ids."""
    ids = stored(ids.select("doc_id").distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how).select(*docs.columns)


def _one_row_an_id(docs: DataFrame) -> DataFrame:
    """docs with one row of each doc_id; only rows of repeated ids are shuffled."""
    repeated = stored(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    one = _restricted(docs, repeated, "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("_row"))
    one = one.select("doc_id", *(F.col("_row").getField(c).alias(c) for c in docs.columns if c != "doc_id"))
    return _restricted(docs, repeated, "left_anti").unionByName(one)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the base counts and the tokeniser bands keep; null and empty texts fail the base."""
    small_batches(spark)
    docs = docs.where("doc_id is not null")
    return _restricted(docs, quality(docs, PIECE_BPE).where("not kept"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of documents alike in 5-word shingles (0.8 or more) the one with the smallest id. Texts without words are alike with none."""
    docs = _one_row_an_id(docs)
    groups = jaccard.join(docs, n=5, percent=80)
    return _restricted(docs, groups.where("doc_id != component_id"), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more out of all documents but the first that has them; n_chars follows the text. A document with no word left goes; a null text stays."""
    cut = passages.without_passages(docs, passages.passages(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with its own or other parameters. Null and empty texts hold none."""
    return _restricted(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; one row a piece, with its ids. A null or empty text is its end id alone."""
    small_batches(spark)
    return pack(docs, BYTE_BPE)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            released(before)
        before = docs
    return docs
