"""Adding per-partition arrays of sums across a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARTIAL = "key int, stat array<double>"
COLLECT_BYTES = 32 << 20


def batch_of(sums: np.ndarray) -> pa.RecordBatch:
    """Rows of ``sums`` as (key, stat)."""
    values = pa.array(np.ascontiguousarray(sums, dtype=np.float64).ravel())
    offsets = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(sums), dtype=np.int32)), pa.ListArray.from_arrays(offsets, values)],
        names=["key", "stat"],
    )


def list_column(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    offsets = pa.array((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


def list_matrix(column: pa.ListArray, p: int) -> np.ndarray:
    """A list column of fixed length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def add_partitions(
    df: DataFrame, keys: int, size: int, partial: Callable[[Iterable[pa.RecordBatch]], np.ndarray | None]
) -> np.ndarray:
    """Sum ``partial`` (a keys x size matrix per partition) over all partitions.

    The result has a fixed size, set by the model and the replicate block. Few
    partitions are added on the driver if they fit ``COLLECT_BYTES``; otherwise
    the partial rows are shuffled by key and added there first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = partial(batches)
        if sums is not None:
            yield batch_of(sums)

    parts = df.mapInArrow(run, PARTIAL)
    count = df.rdd.getNumPartitions()
    if count * keys * size * 8 > COLLECT_BYTES:
        parts = parts.repartition(min(keys * 8, count), "key").mapInArrow(_add_by_key(size), PARTIAL)
    out = np.zeros((keys, size))
    for batch in parts.toArrow().to_batches():
        np.add.at(out, batch.column("key").to_numpy(), list_matrix(batch.column("stat"), size))
    return out


def _add_by_key(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, row in zip(batch.column("key").to_numpy(), list_matrix(batch.column("stat"), size)):
                if key in sums:
                    sums[key] += row
                else:
                    sums[key] = row.copy()
        if sums:
            found = batch_of(np.stack(list(sums.values())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), found.column("stat")], names=["key", "stat"]
            )

    return run
