"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def spread_join(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined on ``key`` to ``side``, which has one row for each key.

    Keys of more than 1 / ``SHARE`` of the rows are fewer than ``SHARE``, whatever the size
    of ``rows``: what ``side`` holds for them is broadcast, so their rows stay where they are.
    All others are joined by a shuffle in which no key is large. A null key finds nothing.
    """
    bound = rows.count() / SHARE
    hot = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound).select(key)
    near = side.join(F.broadcast(hot), key, "left_semi")
    held = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(near), key, "left")
    others = rows.join(F.broadcast(hot), key, "left_anti").join(side, key, "left")
    return held.unionByName(others)
