"""A training-data pipeline over `documents`: quality rules, near-duplicates, benchmark
decontamination, PII redaction, SentencePiece encoding. Each stage takes what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import decontaminate, minhash, pii, quality_rules, sentencepiece_codec, sp_model
from gazette.llm.common import materialize, table
from gazette.llm.queries import SP_MODEL

#: The SQL check has none for the whole run: stages find components, read templates and segment words.
ORACLE_SQL = None


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules reject. The verdict is a row-local expression: no join."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole_row"))
    return quality_rules.apply_policy(quality_rules.ledger(whole, keep=("whole_row",))).filter("kept").select("whole_row.*")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of five-word-shingle near-duplicates: that of the smallest doc_id."""
    return minhash.survivors(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item leaks."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else clean


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip."""
    return sentencepiece_codec.encode(docs, sp_model.load(SP_MODEL))


STAGES = [
    ("quality rules", rules_stage),
    ("MinHash near-dedup", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
