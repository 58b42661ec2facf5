"""Resampling of persons by counts that do not depend on the partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.functions.tree import Tree, drawn

BUCKETS = 4096


def hash_number(text: Column, digits: int = 15) -> Column:
    """First hex digits of an MD5 sum as a whole number, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def person_index(ids: DataFrame, id: str = "id") -> DataFrame:
    """Number distinct persons 0..n-1 without sorting them in one place.

    Persons fall into hash buckets; the bucket sizes (at most ``BUCKETS`` rows) give
    each bucket its first number, and rows are numbered within buckets.
    """
    keyed = ids.select(id).distinct().withColumn("_b", hash_number(F.col(id).cast("string"), 8) % BUCKETS)
    sizes = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    within = Window.partitionBy("_b").orderBy(id)
    return (
        keyed.withColumn("_r", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "_b")  # at most BUCKETS rows
        .select(id, (F.col("_s") + F.col("_r")).cast("bigint").alias("idx"))
    )


def bootstrap_counts(ids: DataFrame, replicates: int, seed: int, id: str = "id") -> DataFrame:
    """How often each person is drawn in each replicate: ``(rep, id, n)``.

    Persons not drawn have no row. Counts of a replicate add up to the number of
    persons. Draws arise in the task that holds the person, by a splitting tree over the
    persons' numbers; none is shuffled.
    """
    index = person_index(ids, id)
    n = index.count()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = Tree(n, 0, replicates, seed)
        for batch in batches:
            idx = batch.column("idx").to_numpy()
            order = np.argsort(idx, kind="stable")
            for a, _, place, rep in drawn(idx[order], splits):
                cells, count = np.unique(place * replicates + rep, return_counts=True)
                rows = batch.column(id).take(pa.array(order[a + cells // replicates]))
                yield pa.RecordBatch.from_arrays([pa.array((cells % replicates).astype(np.int32)), rows, pa.array(count)], ["rep", id, "n"])

    kind = index.schema[id].dataType.simpleString()
    return index.mapInArrow(counted, f"rep int, `{id}` {kind}, n bigint")


def with_draws(persons: DataFrame, n: int, first: int, last: int, seed: int) -> DataFrame:
    """``persons``, numbered 0..n-1 by ``idx``, with ``drawn``: the replicates first..last-1 that drew the person, once per draw."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = Tree(n, first, last, seed)
        for batch in batches:
            idx = batch.column("idx").to_numpy()
            order = np.argsort(idx, kind="stable")
            owner, reps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, _, place, rep in drawn(idx[order], splits):
                owner.append(order[a + place])
                reps.append(rep)
            owner, reps = np.concatenate(owner), np.concatenate(reps)
            by_person = np.argsort(owner, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(idx)))))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(reps[by_person].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "drawn"])

    return persons.mapInArrow(add, T.StructType([*persons.schema.fields, T.StructField("drawn", T.ArrayType(T.IntegerType()))]))


def sparse_counts(ids: DataFrame, replicates: int, seed: int, id: str = "id") -> DataFrame:
    """The draws of each person as one row: ``(id, drawn)``, the replicates that drew the person, once per draw.

    About as long as the number of replicates, whatever the data, and empty for a person that is never drawn.
    """
    index = person_index(ids, id)
    return with_draws(index, index.count(), 0, replicates, seed).select(id, "drawn")


def pack_counts(counts: DataFrame, id: str = "id") -> DataFrame:
    """Counts ``(rep, id, n)`` as one row per person: ``(id, drawn)``, as ``sparse_counts`` gives them."""
    rows = counts.withColumn("rep", F.explode(F.array_repeat("rep", F.col("n").cast("int"))))
    return rows.groupBy(id).agg(F.sort_array(F.collect_list("rep")).alias("drawn"))


def count_in(drawn: Column, rep: Column) -> Column:
    """How often a replicate is in a list of draws; 0 for a missing list."""
    return F.coalesce(F.size(F.filter(drawn, lambda r: r == rep)), F.lit(0)).cast("bigint")


def attach_draws(df: DataFrame, drawn: DataFrame, id: str = "id") -> DataFrame:
    """Rows with the list ``drawn`` of their person: as many rows as before."""
    return df.join(drawn, id, "left").withColumn("drawn", F.coalesce("drawn", F.array().cast("array<int>")))


def unfold(df: DataFrame, replicates: int) -> DataFrame:
    """Rows with a list ``drawn`` once for each replicate, with its count ``n``, 0 if not drawn.

    This is rows times replicates; sums over replicates need no more than the list.
    """
    rep = F.explode(F.array(*[F.lit(r) for r in range(replicates)]).cast("array<int>"))
    return df.withColumn("rep", rep).withColumn("n", count_in(F.col("drawn"), F.col("rep"))).drop("drawn")


def attach_counts(df: DataFrame, counts: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Rows of every replicate in ``counts`` with the count of their person, 0 if not drawn.

    Each person carries its list of draws; rows are multiplied only here.
    """
    replicates = counts.agg(F.max("rep")).first()[0]
    return unfold(attach_draws(df, pack_counts(counts, id), id), 0 if replicates is None else replicates + 1)


def bootstrap_rows(df: DataFrame, counts: DataFrame, id: str = "id") -> DataFrame:
    """Copied-row bootstrap: each drawn person's rows once per draw, under a new id.

    The new id is the pair (id, copy).
    """
    return (
        df.join(counts, id)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .drop("n")
        .withColumn("new_id", F.concat_ws(":", F.col(id).cast("string"), F.col("copy").cast("string")))
    )


def jackknife_counts(ids: DataFrame, id: str = "id") -> DataFrame:
    """Counts of leave-one-out replicates in sparse form: the person left out.

    Replicate ``rep`` leaves out the person numbered ``rep``; everybody else has
    count 1, so only the absent person is listed (n = 0).
    """
    return person_index(ids, id).select(F.col("idx").cast("int").alias("rep"), id, F.lit(0).cast("bigint").alias("n"))


def keep_ids(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Rows of the persons in ``ids``."""
    return df.join(ids.select(id).distinct(), id, "left_semi")


def drop_id(df: DataFrame, value, id: str = "id") -> DataFrame:
    """Rows of everybody but one person."""
    return df.filter(F.col(id) != F.lit(value))
