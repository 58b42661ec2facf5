"""Classes of linked rows: connected components by stars, as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulant.session import written


def _star(edges: DataFrame) -> DataFrame:
    """Every neighbour of a node above it is linked to the least of node and neighbours, and the
    node to that least one: large and small star in one pass over (u, v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
    met = both.join(least, F.col("u") == F.col("_u"))
    pairs = met.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(met.select("u", F.col("_m").alias("v")))
    return pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that are in the long pairs (u, v), root the least of its class.

    Each pass is written to the shared folder. Passes end when every node has one link,
    to a node without a link of its own; their number is the logarithm of a chain's length.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        heads = now.groupBy("u").agg(F.count(F.lit(1)).alias("_n"))
        # A flat star: one link for each u, and no v that is a u.
        state = heads.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
        if state <= 1 and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        now = written(_star(now), "links")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
