"""The operators as queries over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steward.llm import (
    grammar, html, langid, maxent, merkle, packing, pieces, quality, reversed_search, secrets, sharding, simhash, topk,
)
from steward.llm.shared import table
from steward.session import scratch_path

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
WORD_LEVEL = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    book = quality.stored_ledger(table(spark, folder, "documents"))
    base = quality.kept(quality.BASE)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"), (base & quality.kept(quality.CLEAN)).alias("kept"), "failed",
    )


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), BYTE_LEVEL, end=0)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return sharding.shard(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + sharding.OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    grammar.write(table(spark, folder, "documents"), path, WORD_LEVEL, end=1)
    return grammar.read(spark, path)


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = langid.held_out()
    profiles = langid.learn(docs.filter(~held))
    asked = docs.select("doc_id", held.alias("held_out"), "text")
    return langid.predict(asked, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op8_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return topk.top_k(rows.filter(F.col("vec_id") % 100 == 0), rows)


def op9_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    ledger = scratch_path(spark, "secrets")
    found = secrets.by_path(secrets.scan(table(spark, folder, "documents"), ledger), ledger)

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["number"] < len(secrets.BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *[of(r.kind) for r in secrets.BASE],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op10_piece_dropout(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded with dropout, and decoded again; ``lossless`` says whether the text came back."""
    return pieces.round_trip(table(spark, folder, "documents"), PIECES)


def op11_reversed_search(spark: SparkSession, folder: str) -> DataFrame:
    return reversed_search.search(table(spark, folder, "benchmark"), table(spark, folder, "documents"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Every row's proof; where 7 divides the checksum of the id, the row claims one character more."""
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    told = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claim = merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), told, F.col("text"))
    return merkle.checked(merkle.manifest(docs.withColumn("claim", claim)))


def op13_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_html_extraction, op3_packing, op4_simhash, op5_sharding, op6_token_files,
        op7_language_id, op8_top_k, op9_secret_scans, op10_piece_dropout, op11_reversed_search, op12_merkle,
        op13_lm_scoring,
    )
}
