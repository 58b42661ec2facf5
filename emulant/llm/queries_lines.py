"""Query of line dedup (8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulant.llm import lines
from emulant.llm.registry import query, table


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that fit a recurring template: lines and words taken away, and what is left."""
    found = lines.cleaned_lines(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [f"lines.{c}" for c in ("n_lines", "n_words", "n_dropped", "dropped_words")]
    return found.select("doc_id", *counts, F.sha2(F.coalesce("lines.clean_text", F.lit("")), 256).alias("clean_sha256"))
