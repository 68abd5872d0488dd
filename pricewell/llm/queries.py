"""Thin queries op1 to op13 over the synthetic tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import chat, decontaminate, html_text, jaccard, lm, merkle, passages, repair, rollup, toxicity, warc
from pricewell.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL
from pricewell.llm.packing import pack
from pricewell.llm.quality import quality
from pricewell.llm.shared import shared_folder, stored, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def fold_of(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def op1_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op3_weighted_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = stored(toxicity.sample(docs, labels, fold_of("doc_id") != 0), "labelled")
    scored = toxicity.score(docs, toxicity.fit(labelled))
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(extra))
    return chat.digests(chat.segments(turns.withColumn("conv_id", F.col("conv_id").cast("long"))))


def op7_delta_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts every document with an estimate, revises it to the exact count, deletes empty ones; each batch is committed twice."""
    version, folder = "byte_bpe_50k", f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    docs = stored(rollup.counts(table(spark, sf_dir, "documents"), BYTE_BPE), "counts")
    one, none = F.lit(1), F.lit(0)
    batches = [
        rollup.signed(docs, version, one, F.col("estimate")),
        rollup.signed(docs, version, none, F.col("n_tokens") - F.col("estimate")),
        rollup.signed(docs.where("is_empty"), version, -one, -F.col("n_tokens")),
    ]
    for number, rows in [*enumerate(batches), *enumerate(batches)]:
        rollup.commit(folder, number, rows)
    return rollup.totals(spark, folder)


def op8_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), PIECE_BPE)


def op9_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), fold_of("doc_id") != 1)
    return scored.withColumn("held_out", fold_of("doc_id") == 1)


def op10_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op11_merkle_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    facts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", merkle.leaf(*facts, F.col("text")).alias("node"), F.when(tampered, merkle.leaf(*facts, merkle.folded_ascii(F.col("text")))).alias("tampered"))
    proofs, _ = merkle.manifest(leaves, "source", "doc_id")
    folded = proofs.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", merkle.proof_digest().alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "node")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}")
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_blocks": op1_line_blocks,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_weighted_lexicon": op3_weighted_lexicon,
    "op4_template_windows": op4_template_windows,
    "op5_token_combinations": op5_token_combinations,
    "op6_schema_fingerprint": op6_schema_fingerprint,
    "op7_delta_rollup": op7_delta_rollup,
    "op8_tokeniser_fertility": op8_tokeniser_fertility,
    "op9_log_frequency_bloom": op9_log_frequency_bloom,
    "op10_collinear_chaining": op10_collinear_chaining,
    "op11_merkle_blocks": op11_merkle_blocks,
    "op12_edit_lattice": op12_edit_lattice,
    "op13_seekable_bundles": op13_seekable_bundles,
}

# The template escapes "<|" and the backslash inside texts: one more character each.
_OP6_SQL = """
WITH turns AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(role) + length(text) + 24 + (length(text) - length(replace(text, '<|', '|'))) + (length(text) - length(replace(text, chr(92), ''))))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

ORACLES: dict[str, str] = {"op6_schema_fingerprint": _OP6_SQL, "op11_merkle_blocks": OP11_SQL, "op12_edit_lattice": OP12_SQL, "op13_seekable_bundles": OP13_SQL}
