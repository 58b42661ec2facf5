"""Near duplicates by 64-bit SimHash fingerprints, found by pigeonhole blocks.

1. Shingles of three words (A-Z lower-cased, repeats included) are hashed by XXH64 with
   seed 42. A bit of the fingerprint is 1 if it is set in more than half the hashes.
2. Equal fingerprints are one node. Two fingerprints that differ in three bits or fewer
   agree in one of four blocks of bits: each node goes to four buckets, keyed by the block
   and its bits.
3. A bucket of up to ``DENSE`` nodes is compared at once by Hamming distance, and gives
   the links of a spanning forest, so links are fewer than members. A larger bucket isn't
   compared: what its members don't yet agree in is split into four blocks again, which is
   exact by the same pigeonhole. With every split a quarter of the open bits is fixed; ten
   open bits hold 1,024 different fingerprints at most, so splitting ends after six levels.
4. Classes are the connected components of the links.

Null and empty texts, and those of white space alone, have fingerprint zero and are linked
like any other; a text of one or two words has one shingle of all of them. Rows without an
id have a fingerprint and a class, but don't name it: ``component_id`` is the least id that
isn't null, and null if there is none. Repeated rows and ids are judged row by row. Other
columns pass through; one named ``simhash`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.llm.hot import spread_join
from emulant.llm.links import components
from emulant.session import written

SHINGLE, SEED = 3, 42
BITS, APART = 64, 3
DENSE = 1024
SLICE = 1 << 16
BROADCAST_ROWS = 200_000
SMALL, PAIRS = 32, 1 << 21


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of one text."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes split at 20 and 09-0D only
    if not words:
        return 0
    n = max(len(words) - SHINGLE + 1, 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SLICE):  # a very long text goes by slices
        part = words[at : at + SLICE + SHINGLE - 1]
        shingles = zip(*(part[k:] for k in range(SHINGLE))) if len(words) >= SHINGLE else [part]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
    return pa.array(found.view(np.int64))


def fingerprints(text: Column) -> Column:
    """Fingerprint as a signed long."""
    return _fingerprints(text)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def split_bits(open_bits: int) -> list[int]:
    """What stays open after each of the four blocks of ``open_bits`` has been fixed."""
    places = [b for b in range(BITS) if open_bits >> b & 1]
    cuts = [len(places) * k // (APART + 1) for k in range(APART + 2)]
    return [open_bits & ~sum(1 << b for b in places[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    mask &= (1 << BITS) - 1
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether fingerprints are linked. (Bits of signed numbers would be counted after their sign is lost.)"""
    return np.bitwise_count((x ^ y).view(np.uint64)) <= APART


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints within ``APART`` bits of each other."""
    left, us, vs, todo = fps, [], [], []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
        here = todo.pop()
        linked = near(left, here)
        met, left = left[linked], left[~linked]
        us.append(np.full(len(met), here))
        vs.append(met)
        todo.extend(met)
    return np.concatenate(us), np.concatenate(vs)


def _small_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets of ``SMALL`` members at most, all buckets of a size at once."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, SMALL + 1):
        at = starts[sizes == m]
        i, j = np.triu_indices(m, 1)
        step = max(PAIRS // len(i), 1)
        for k in range(0, len(at), step):
            members = fps[at[k : k + step, None] + np.arange(m)]
            linked = near(members[:, i], members[:, j])
            many = linked.sum(axis=1) >= m
            b, pair = np.nonzero(linked & ~many[:, None])
            us.append(members[b, i[pair]])
            vs.append(members[b, j[pair]])
            for bucket in members[many]:
                u, v = forest(bucket)
                us.append(u)
                vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(0)
        offsets = column.offsets.to_numpy().astype(np.int64)
        fps = column.values.to_numpy()
        sizes = np.diff(offsets)
        u, v = _small_links(fps, offsets[:-1], sizes)
        us, vs = [u], [v]
        for a, m in zip(offsets[:-1][sizes > SMALL], sizes[sizes > SMALL]):
            u, v = forest(fps[a : a + m])
            us.append(u)
            vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def block_links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column ``fp``) within three bits of each other.

    ``dense`` is the largest bucket that is compared; it must hold 1,024 or more in use, below
    that splitting needn't end.
    """
    session = fps.sparkSession
    rows = fps.select("fp", F.lit(0).alias("path"))
    open_bits, found = [(1 << BITS) - 1], None
    while True:
        splits = [split_bits(o) for o in open_bits]
        fixed = F.array(*[F.array(*[F.lit(_signed(~o)).cast("long") for o in four]) for four in splits])
        blocks = rows.select("fp", "path", F.posexplode(F.get(fixed, F.col("path"))).alias("_k", "_fixed"))
        blocks = blocks.select("fp", (F.col("path") * (APART + 1) + F.col("_k")).alias("path"), F.col("fp").bitwiseAND(F.col("_fixed")).alias("key"))
        counts = blocks.groupBy("path", "key").agg(F.count(F.lit(1)).alias("_n"))
        full = written(counts.filter(F.col("_n") > dense).select("path", "key"), "dense-blocks")
        n_full = full.count()
        side = F.broadcast(full) if n_full <= BROADCAST_ROWS else full  # two numbers a row
        small = blocks.join(side, ["path", "key"], "left_anti") if n_full else blocks
        buckets = small.groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        links = written(buckets.select("fps").mapInArrow(_links, "u long, v long"), "block-links")
        found = links if found is None else found.unionByName(links)
        if not n_full:
            return found
        rows = written(blocks.join(side, ["path", "key"], "left_semi").select("fp", "path"), "dense-members")
        open_bits = [o for four in splits for o in four]


def _class_ids(fps: DataFrame) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of ``fps`` (doc_id, fp)."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("_least")), "fingerprints")
    roots = components(block_links(nodes))
    linked = written(nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "_least"), "linked")
    named = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = spread_join(linked.select("fp", "root"), named, "root").select("fp", F.col("component_id").alias("_of"), F.lit(True).alias("_linked"))
    both = nodes.join(classes, "fp", "left")
    return both.select("fp", F.when(F.col("_linked"), F.col("_of")).otherwise(F.col("_least")).alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    fps = written(docs.select(F.col("doc_id"), fingerprints(F.col("text")).alias("fp")), "simhash")
    found = written(_class_ids(fps), "classes")
    return spread_join(fps, found, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct column ``simhash``: fingerprint, component_id, kept.

    The rows of ``component_id`` are kept, and rows without an id.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "simhash"]).alias("row")
    fps = written(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "simhash")
    found = written(_class_ids(fps), "classes")
    out = spread_join(docs.select(row, fingerprints(F.col("text")).alias("fp")), found, "fp")
    same = F.coalesce(F.col("row.doc_id") == F.col("component_id"), F.lit(True))
    made = F.struct(as_hex(F.col("fp")).alias("fingerprint"), F.col("component_id"), same.alias("kept"))
    return out.select("row.*", made.alias("simhash"))
