"""Counts, contingency tables, histograms and pivots."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.session import written


def count_by(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts of the combinations that occur."""
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))


def _dictionary(counts: DataFrame, dim: str, levels: Sequence | None, most: int) -> DataFrame:
    """(_i, ``dim``) of the levels of a dimension, numbered from 0; refused beyond ``most``."""
    spark, kind = counts.sparkSession, counts.schema[dim].dataType
    if levels is not None:
        schema = T.StructType([T.StructField("_i", T.LongType()), T.StructField(dim, kind)])
        return spark.createDataFrame(list(enumerate(levels)), schema)
    found = written(counts.select(dim).distinct(), "levels")
    if (n := found.count()) > most:
        raise ValueError(f"{dim} has {n} levels, more than {most}: not a category")
    # One task numbers at most ``most`` levels.
    return found.withColumn("_i", F.row_number().over(Window.orderBy(dim)) - F.lit(1).cast("long"))


def crosstab_full(
    df: DataFrame,
    dims: Sequence[str],
    levels: Mapping[str, Sequence] | None = None,
    most_levels: int = 100_000,
    most_cells: int = 100_000_000,
) -> DataFrame:
    """Counts of every combination of the levels that occur, zeros included.

    The table is counted once; levels and cells then come from the counts. Rows with
    a missing level are left out. The result has as many rows as the product of
    the numbers of levels. That product is known before a cell is made: beyond ``most_cells``, or with a
    dimension of more than ``most_levels`` levels, the table is refused. Cells are numbers that tasks
    unfold on their own, digit by digit; no row holds all levels of a dimension.
    """
    dims = list(dims)
    counts = written(count_by(df.dropna(subset=dims), dims), "counts")
    dictionaries = [_dictionary(counts, d, levels.get(d) if levels else None, most_levels) for d in dims]
    sizes = [d.count() for d in dictionaries]
    product = math.prod(sizes)
    if product > most_cells:
        raise ValueError(f"{' x '.join(map(str, sizes))} cells are more than {most_cells}")
    cells, stride = df.sparkSession.range(product).withColumnRenamed("id", "_cell"), 1
    for dim, size, names in reversed(list(zip(dims, sizes, dictionaries))):
        digit = F.expr(f"(_cell div {stride}L) % {size}L")
        cells = cells.withColumn("_i", digit).join(F.broadcast(names), "_i").drop("_i")  # most_levels rows at most
        stride *= max(size, 1)
    return cells.join(counts, dims, "left").select(*dims, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def person_trial_totals(expanded: DataFrame, totals: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Totals within each (person, trial), then how many have each combination.

    ``dims`` are constant within a trial.
    """
    per = expanded.groupBy("id", "trial_period", *[d for d in dims if d != "trial_period"]).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in totals]
    )
    return count_by(per, [*dims, *totals])


def event_counts(df: DataFrame, dims: Sequence[str], outcome: str = "outcome") -> DataFrame:
    return df.groupBy(*dims).agg(F.sum(outcome).cast("bigint").alias("events"))


def total_events(df: DataFrame, outcome: str = "Y") -> DataFrame:
    return df.agg(F.sum(outcome).cast("bigint").alias("events"))


def histogram(df: DataFrame, column: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts in bins centred on multiples of ``width``."""
    bins = F.floor(F.col(column) / F.lit(width) + F.lit(0.5)).cast("bigint")
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(*by, bins.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("centre", F.col("bin") * F.lit(width))
    )


def na_label(ok: Column) -> Column:
    return F.when(ok, "No NAs").otherwise("Some NAs")


def na_crosstab(flags: DataFrame, checks: Mapping[str, Column], dims: Sequence[str]) -> DataFrame:
    """Contingency table of "No NAs"/"Some NAs" labels against ``dims``."""
    return crosstab_full(flags.withColumns({n: na_label(c) for n, c in checks.items()}), [*checks, *dims])


def pivot_table(df: DataFrame, rows: Sequence[str], column: str, levels: Sequence, value: str, prefix: str = "") -> DataFrame:
    """One row per ``rows`` and one column per level, each cell holding one value."""
    return df.groupBy(*rows).agg(
        *[F.max(F.when(F.col(column) == F.lit(v), F.col(value))).alias(f"{prefix}{v}") for v in levels]
    )


def tag(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Mark rows with scenario constants."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})
