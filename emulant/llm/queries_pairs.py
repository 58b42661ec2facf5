"""Queries of near-duplicate operators: substring dedup (2), MinHash near-dedup (5), SimHash near-dedup (11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulant.llm import neardup, passages, simhash
from emulant.llm.registry import query, table


@query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near duplicates of every document, and whether the document stays."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).select("doc_id", "near.class_id", "near.kept")


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Class of documents that share passages, number of links, and repeated spans, for every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    p = passages.repeated_passages(docs)
    joined = F.array_join(F.transform("passages.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return p.select("doc_id", "passages.class_id", "passages.n_links", F.coalesce(joined, F.lit("")).alias("spans"))


@query("op11_simhash")
def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and the least id it reaches over links of three bits or fewer."""
    return simhash.classes(table(spark, folder, "documents").select("doc_id", "text"))
