"""Corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``. Null, empty and very long texts,
repeated rows, empty tables and extra columns are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulant.llm import leaks, mixing, neardup, quality, tokens
from emulant.session import new_table_path

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines; n_chars is that of the cleaned text."""
    cleaned = quality.kept_documents(docs)
    new = {"text": F.col("quality.clean_text"), "n_chars": F.length("quality.clean_text").cast("long")}
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    kept = neardup.near_duplicates(docs).filter("near.kept").select(*docs.columns)
    # Repeated rows of the id that stays are one document.
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.find_leaks(docs, benchmark).filter(F.size("leaks") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))
    mixed = mixing.mix_sources(docs).filter("mix.copies > 0")
    return mixed.withColumn("_copy", copies).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places and checksums of the ids of each row; copies of a document are told apart by ``nth``."""
    out = tokens.encoded(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "nth", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token output", token_output),
]

#: The stages hold draws, sketches and a tokenizer, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_table_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
