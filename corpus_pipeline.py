"""From raw documents to packed sequences: five stages, each over all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steward.llm import langid, packing, quality, secrets, simhash
from steward.llm.queries import BYTE_LEVEL
from steward.llm.shared import written
from steward.session import scratch_path

# No language is this far from a text in it that has ten words.
LEAST_SCORE = 0.1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects. Null and empty texts are rejected."""
    return quality.keep_clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones; held-out ones do not teach.

    With no labelled document at all nothing can be told, and all documents stay.
    """
    profiles = langid.learn(docs.filter(~langid.held_out()))
    if not profiles.names:
        return docs
    lang, score = "_lang_pred", "_lang_score"
    while {lang, score} & set(docs.columns):
        lang, score = lang + "_", score + "_"
    found = langid.predict(docs, profiles, lang_as=lang, score_as=score)
    known = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)
    return found.filter(known).drop(lang, score)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return simhash.keep_one(docs, place=simhash.file_place(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mask; ``n_chars`` follows the text."""
    ledger = scratch_path(spark, "secrets")
    secrets.scan(docs, ledger)
    clean = secrets.redacted(docs, ledger)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.char_length("text").cast(kind))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, with their token ids."""
    return packing.pack(docs, BYTE_LEVEL, end=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("packing", packed),
]

# Fingerprints, trained profiles and token ids have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
