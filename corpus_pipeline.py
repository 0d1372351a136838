"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Language identification, near-duplicate removal, benchmark decontamination, secret masking, packing.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresift.llm import decontam, langid, packing, parity_join, secret_scan
from foresift.llm.common import shared_dir, table

# least calibrated probability of the language that a document must have
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a clear language go; where no row names a language, only those without letters."""
    model = langid.train_language_model(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = langid.predict_language(docs, model)
    return rows.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays; documents without words or id all stay."""
    groups = parity_join.similarity_components(docs)
    kept = groups.where((F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0))
    alone = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    # rows that share an id are told apart as whole rows
    again = kept.groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = alone.join(again, "doc_id", "left_anti").unionByName(alone.join(again, "doc_id", "left_semi").dropDuplicates())
    bare = docs.where(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return once.unionByName(bare.join(kept.select("doc_id").distinct(), "doc_id", "left_anti")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with the secrets in its text masked and its length counted anew."""
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of 4096 ids: a row per piece."""
    return packing.piece_digest(packing.pack_documents(docs))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

# language models, fuzzy verification and tokenizers have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
