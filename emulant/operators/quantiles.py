"""Exact interpolated quantiles of large groups.

The built-in ``percentile`` keeps every distinct value of a group in one task.
That suits groups of known size, such as the replicates of one interval; a group
that grows with the data (all weights of one arm) needs the form below, which
never brings a group together and never shuffles a row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.session import keep, written

CELLS = 4096  # parts into which a round cuts a range
FEW = 1024  # values that are sorted at last
BROADCAST_ROWS = 200_000  # ranges of up to this number are broadcast, four numbers and a key each


@F.arrow_udf(T.LongType())
def _ordered(values: pa.Array) -> pa.Array:
    """Doubles as whole numbers in the same order; -0 counts as 0."""
    bits = (values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.arrow_udf(T.DoubleType())
def _value(ordered: pa.Array) -> pa.Array:
    bits = ordered.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64))


def _met(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows in the ranges (_key, lo, hi) of ``cells``, which don't overlap within a key."""
    side = F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells
    side = side.select(F.col("_key").alias("_k"), "lo", "hi")
    return rows.join(side, (F.col("_key") == F.col("_k")) & F.col("_b").between(F.col("lo"), F.col("hi"))).drop("_k")


def quantile_table(
    df: DataFrame, by: Sequence[str], column: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics) per group.

    A rank is looked for by histograms of digits. A double, read as a whole number, has the order of
    its value. Each round cuts the range that holds a wanted rank into ``CELLS`` parts and counts the rows in
    each: a few counts per group and task, added up before they are shuffled. The running count tells
    which part holds the rank, and that is the range of the next round. Once a range holds one
    value, or ``FEW`` rows, the rank is read from it. Six rounds read 64 bits, so that is the most; one is usual.

    Missing values are left out; an empty group gives no row.
    """
    by = list(by)
    # One struct key: never NULL itself, and equal where its fields are (NULLs too).
    key = F.struct(*[F.col(k) for k in by]) if by else F.struct(F.lit(0))
    rows = df.filter(F.col(column).isNotNull()).select(key.alias("_key"), _ordered(F.col(column).cast("double")).alias("_b"))
    rows = keep(rows)
    try:
        return _quantiles(rows, by, probs)
    finally:
        rows.unpersist()


def _quantiles(rows: DataFrame, by: list[str], probs: Mapping[str, float]) -> DataFrame:
    b = F.col("_b")
    groups = rows.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(b < 0, 1)).alias("_below"), F.min("_b").alias("_min"), F.max("_b").alias("_max")
    )
    groups = written(groups, "groups")

    def rank(p: float, how) -> Column:
        return how((F.col("_n") - 1) * F.lit(p)).cast("long")

    ranks = F.array_distinct(F.array(*[rank(p, how) for p in probs.values() for how in (F.floor, F.ceil)]))
    # Ranges on one side of 0, so that their length is a long.
    low = F.col("rank") < F.col("_below")
    targets = groups.withColumn("rank", F.explode(ranks)).select(
        "_key",
        "rank",
        F.when(low, F.col("_min")).otherwise(F.greatest("_min", F.lit(0).cast("long"))).alias("lo"),
        F.when(low, F.least("_max", F.lit(-1).cast("long"))).otherwise(F.col("_max")).alias("hi"),
        F.when(low, F.lit(0).cast("long")).otherwise(F.col("_below")).alias("before"),
        F.when(low, F.col("_below")).otherwise(F.col("_n") - F.col("_below")).alias("size"),
    )
    wide = (F.col("size") > FEW) & (F.col("lo") < F.col("hi"))
    while not targets.filter(wide).isEmpty():
        targets = written(_narrowed(rows, targets.filter(wide)).unionByName(targets.filter(~wide)), "ranges")
    few = _met(rows, targets.filter("lo < hi").select("_key", "lo", "hi").distinct())
    lists = few.groupBy("_key", "lo", "hi").agg(F.sort_array(F.collect_list("_b")).alias("_sorted"))
    here = F.get("_sorted", (F.col("rank") - F.col("before")).cast("int"))
    found = targets.join(lists, ["_key", "lo", "hi"], "left").select("_key", "rank", _value(F.coalesce(here, F.col("lo"))).alias("_v"))
    picks = []
    for i, p in enumerate(probs.values()):
        for tag, how in (("lo", F.floor), ("hi", F.ceil)):
            picks.append(F.max(F.when(F.col("rank") == rank(p, how), F.col("_v"))).alias(f"_{tag}{i}"))
        h = (F.col("_n") - 1) * F.lit(p)
        picks.append(F.max(h - F.floor(h)).alias(f"_f{i}"))
    wide_rows = found.join(groups.select("_key", "_n"), "_key").groupBy("_key").agg(*picks)
    results = [
        (F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name)
        for i, name in enumerate(probs)
    ]
    return written(wide_rows.select(*[F.col("_key")[k].alias(k) for k in by], *results), "quantiles")


def _narrowed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The part of each range that holds its rank."""
    width = F.shiftright(F.col("hi") - F.col("lo"), int(np.log2(CELLS))) + 1
    part = F.expr("(_b - lo) div _width")
    counts = _met(rows, targets.select("_key", "lo", "hi").distinct()).withColumn("_width", width)
    counts = counts.groupBy("_key", "lo", "hi", part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.partitionBy("_key", "lo", "hi").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_end", F.sum("_c").over(up_to))  # CELLS rows of a range at most
    placed = targets.join(counts, ["_key", "lo", "hi"])
    inside = F.col("rank") - F.col("before")
    placed = placed.filter((inside >= F.col("_end") - F.col("_c")) & (inside < F.col("_end"))).withColumn("_width", width)
    first = F.col("lo") + F.col("_part") * F.col("_width")
    return placed.select(
        "_key",
        "rank",
        first.alias("lo"),
        # Compared as a length: the end of the last part may lie beyond the largest long.
        F.when(F.col("hi") - first < F.col("_width"), F.col("hi")).otherwise(first + (F.col("_width") - 1)).alias("hi"),
        (F.col("before") + F.col("_end") - F.col("_c")).alias("before"),
        F.col("_c").alias("size"),
    )
