"""Query of benchmark decontamination (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulant.llm import leaks
from emulant.llm.registry import query, table


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the items."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = leaks.find_leaks(docs, table(spark, folder, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("l")).select(
        "doc_id", "l.item_id", *[F.round(f"l.{c}", 4).alias(c) for c in ("cosine", "lcs", "answer")]
    )
