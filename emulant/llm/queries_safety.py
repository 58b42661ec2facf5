"""Queries of toxicity (3) and secret scans (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulant.llm import secrets, toxicity
from emulant.llm.registry import query, table


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; a third of the ids is never learned from."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, folder, "labels").select("doc_id", "toxic").filter(~held)
    model = toxicity.train(docs, labels)
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    found = secrets.scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    s = F.col("secrets")
    return found.select(
        "doc_id",
        s["n_assign"].alias("n_assign"),
        s["n_access"].alias("n_access"),
        s["n_hex"].alias("n_hex"),
        F.sha2(s["base"], 256).alias("base_sha256"),
        s["spans"].alias("spans"),
        s["n_guess"].alias("n_guess"),
    )
