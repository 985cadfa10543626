"""A training-corpus pipeline: STAGES are applied in turn to documents, each to what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, decontaminate, neardup, quality, secretscan
from folioflow.llm.common import restored, table

#: SQL cannot express the hashed likelihood ratio, the ownership frequency and the encoding; a test compares with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the counting rules or the likelihood ratio reject."""
    ratio = quality.fit(docs, quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return restored(quality.rules(docs, ratio, keep=True).where("kept"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies. Rows that share a doc_id are one document: they go only if none is kept."""
    fate = neardup.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = table(fate.where("not kept").select(F.col("doc_id").alias("gone")), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of a benchmark item occurs."""
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return restored(judged.where("not contaminated"), docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret by its kind; n_chars follows the text. Texts without secrets stay as they are, null included."""
    text = secretscan.masked(F.col("text"), F.col("found"))
    size = F.when(F.size("found") > 0, F.length(text).cast("bigint"))
    return restored(secretscan.scan(docs, keep=True), docs.columns, change={"text": lambda old: text, "n_chars": lambda old: F.coalesce(size, old)})


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("byte-level BPE", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
