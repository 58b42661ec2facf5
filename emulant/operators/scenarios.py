"""Scenario grids and keys of prediction grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def crossing(spark: SparkSession, factors: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the factor levels, numbered with the last factor fastest."""
    grid = spark.range(1).select(*[F.array(*[F.lit(v) for v in vs]).alias(k) for k, vs in factors.items()])
    number = F.lit(0)
    for k, vs in factors.items():
        keep = [c for c in grid.columns if c != k]
        grid = grid.select(*keep, F.posexplode(k).alias(f"_i_{k}", k))
        number = number * len(vs) + F.col(f"_i_{k}")
    return grid.select((number + 1).cast("int").alias("scenario"), *factors)


def cross_grid(ids: DataFrame, visits: int, id: str = "id") -> DataFrame:
    """Person x trial x follow-up with the follow-up bounded by the end of the study.

    Each person row is exploded by itself, so nothing is joined.
    """
    last = F.lit(visits - 1)
    return (
        ids.select(id)
        .distinct()
        .withColumn("trial_period", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("followup_time", F.explode(F.sequence(F.lit(0), last - F.col("trial_period"))))
    )


def onto_grid(rows: DataFrame, grid: DataFrame, keys: Sequence[str] = ("id", "trial_period", "followup_time")) -> DataFrame:
    """All grid rows, with values where they were observed."""
    return grid.join(rows, list(keys), "left")


def observed_pairs(grid: DataFrame, expanded: DataFrame) -> DataFrame:
    """Grid rows of the (person, trial) pairs that exist."""
    return grid.join(expanded.select("id", "trial_period").distinct(), ["id", "trial_period"], "left_semi")


def attach_probs(panel: DataFrame, probs: DataFrame, on: Sequence[str] = ("id", "t")) -> DataFrame:
    """Panel rows with fitted probabilities of the rows that have them."""
    return panel.join(probs, list(on), "left")


def pair_num_den(den: DataFrame, num: DataFrame, on: Sequence[str] = ("id", "t")) -> DataFrame:
    """Numerator rows with their denominators; every numerator row stays."""
    return num.join(den, list(on), "left")


def merge_weights(weights: DataFrame, expanded: DataFrame, counts: DataFrame) -> DataFrame:
    """New weights, expansion and counts in one table.

    The expansion's own weight is kept as ``old_weight``; the result weight is the
    new one times the count, 0 for persons not drawn.
    """
    keys = ["id", "trial_period", "followup_time"]
    old = expanded.withColumnRenamed("weight", "old_weight")
    new = weights.select(*keys, F.col("weight").alias("new_weight"))
    rows = old.join(new, keys, "left").join(counts.select("id", "n"), "id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.withColumn("n", n).withColumn(
        "weight", F.when(F.col("n") != 0, F.col("new_weight") * F.col("n")).otherwise(F.lit(0.0))
    )
