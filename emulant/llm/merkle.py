"""Merkle manifest of a data set, with proofs that are folded from retained hash states.

H is the lower-case hex SHA-256 of its inputs, digests being fed as hex text. The leaves of
a group ascend by their order; while a group has several nodes, each ``FAN`` of them in a row (the
last ones fewer, even one) become their H. What remains is the group's subroot; subroots,
ordered by group (null first, UTF-8 bytewise), become the root the same way.

1. Places. Digests alone (no texts) are sorted by ranges of (group, order, digest); a row's
   place is its number in its part and the rows of the parts before. No window runs over a
   group, so a group that holds a third of all rows is many parts like any other.
2. Up. A block is ``BLOCK`` nodes of one group in a row, the leaves of a subtree of ``LEVELS``
   levels. Blocks stream through tasks sorted, one block in memory at a time; each
   becomes one node of the next table, so tables shrink 4096-fold.
3. Down. A task rebuilds the subtree of a block. Each parent retains a copy of its hash state
   before each child slot. What lies above the block comes along as one row: for each level the
   digests left and right of the path, the left ones hashed once into a retained state. To fold
   a replaced leaf, each level resumes the state of the slot and hashes the replacement and
   the right siblings only.

Rows of equal order and digest take neighbouring places; which of them comes first changes no
result. A null order comes first in its group. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulant.llm.hot import spread_join
from emulant.session import written

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
BATCH = 2048

sha = hashlib.sha256


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def places(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, a written table, with ``_at``: their number in ascending order, nulls first, from 0."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // 1_000_000 + 1)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id counts rows from 0 in each part, with the part's number above bit 33.
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "sorted")
    # One small row for each part: their number is set above and doesn't follow the rows' content.
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(at)
        at += counts.get(part, 0)
    offset = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_part").cast("int")) if before else F.lit(0)
    return dealt.withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1) + offset).drop("_id", "_part")


def _depth(nodes: int) -> int:
    """Levels of a block in a group of ``nodes`` nodes."""
    depth = 0
    while depth < LEVELS and FAN**depth < nodes:
        depth += 1
    return depth


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, BATCH).columns))


def _parents(nodes: list[str]) -> list[str]:
    return [sha("".join(nodes[k : k + FAN]).encode()).hexdigest() for k in range(0, len(nodes), FAN)]


def _raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One node for each block of the sorted rows (g, block, at, size, digest)."""
    out = []
    for (g, block), rows in groupby(_rows(batches), lambda r: r[:2]):
        rows = list(rows)
        size, digests = rows[0][3], [r[4] for r in rows]
        for _ in range(_depth(size)):
            digests = _parents(digests)
        out.append((g, block, -(-size // BLOCK), digests[0]))
        if len(out) >= BATCH:
            yield _batch(out, NODE)
            out = []
    yield _batch(out, NODE)


NODE = pa.schema([("g", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])
NODE_TYPE = "g long, at long, size long, digest string"
PATH = pa.schema([("g", pa.int64()), ("at", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
PATH_TYPE = "g long, at long, path array<string>, subroot string, root string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {BLOCK}"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes (g, at, size, digest) from ``nodes`` up, until every group has one."""
    tables = [nodes]
    while not tables[-1].filter("size > 1").isEmpty():
        dealt = _blocks(tables[-1]).repartition("g", "block").sortWithinPartitions("g", "block", "at")
        tables.append(written(dealt.select("g", "block", "at", "size", "digest").mapInArrow(_raised, NODE_TYPE), "nodes"))
    return tables


class _Tree:
    """The subtree of a block: for each level the digests, and the states retained before each child slot."""

    def __init__(self, leaves: list[str], size: int, path: list[str]):
        self.levels, self.states = [leaves], []
        for _ in range(_depth(size)):
            nodes, states = self.levels[-1], []
            parents = []
            for k in range(0, len(nodes), FAN):
                state = sha()
                for digest in nodes[k : k + FAN]:
                    states.append(state.copy())
                    state.update(digest.encode())
                parents.append(state.hexdigest())
            self.states.append(states)
            self.levels.append(parents)
        #: Above the block: retained state before the path's slot, digests to the right, all siblings.
        self.above = [(sha(a.encode()), b.encode(), (a + b).encode()) for a, b in zip(path[::2], path[1::2])]

    def sides(self, slot: int) -> Iterator[tuple[str, str]]:
        """For each level, the digests left and right of the path from ``slot``."""
        for nodes in self.levels[: len(self.states)]:
            first = slot - slot % FAN
            yield "".join(nodes[first:slot]), "".join(nodes[slot + 1 : first + FAN])
            slot //= FAN

    def fold(self, slot: int, digest: str) -> str:
        """Root with ``digest`` in the place of a leaf."""
        for nodes, states in zip(self.levels, self.states):
            state = states[slot].copy()
            state.update("".join((digest, *nodes[slot + 1 : slot - slot % FAN + FAN])).encode())
            digest, slot = state.hexdigest(), slot // FAN
        for state, right, _ in self.above:
            state = state.copy()
            state.update(digest.encode() + right)
            digest = state.hexdigest()
        return digest

    def proof(self, slot: int) -> str:
        """H of the siblings of all levels, left to right."""
        state = sha("".join(a + b for a, b in self.sides(slot)).encode())
        for _, _, siblings in self.above:
            state.update(siblings)
        return state.hexdigest()


def _with_paths(nodes: DataFrame, above: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (g, block, at, size, ``columns``, path, subroot, root) of all blocks, sorted, each block led by its path row.

    ``above`` has one row (g, at, path, subroot, root) for each block.
    """
    types = {f.name: f.dataType for f in nodes.schema}
    head = above.select(
        "g",
        F.col("at").alias("block"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(None).cast("long").alias("size"),
        *[F.lit(None).cast(types[c]).alias(c) for c in columns],
        "path",
        "subroot",
        "root",
    )
    body = _blocks(nodes).select(
        "g",
        "block",
        "at",
        "size",
        *columns,
        F.lit(None).cast("array<string>").alias("path"),
        F.lit(None).cast("string").alias("subroot"),
        F.lit(None).cast("string").alias("root"),
    )
    return head.unionByName(body).repartition("g", "block").sortWithinPartitions("g", "block", "at")


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(path row, node rows) of each block."""
    for _, rows in groupby(_rows(batches), lambda r: r[:2]):
        head, *body = rows
        if body:
            yield head, body


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path of every node, from those of its block."""
    out = []
    for head, body in _block_rows(batches):
        path, subroot, root = head[-3:]
        tree = _Tree([r[4] for r in body], body[0][3], [])
        for slot, r in enumerate(body):
            own = [side for pair in tree.sides(slot) for side in pair]
            out.append((r[0], r[2], own + path, subroot, root))
            if len(out) >= BATCH:
                yield _batch(out, PATH)
                out = []
    yield _batch(out, PATH)


def descend(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the blocks of ``tables[0]``; ``top`` has those of the groups, as (g, at, path, subroot, root)."""
    paths = top
    for nodes in reversed(tables[1:]):
        paths = written(_with_paths(nodes, paths, ["digest"]).mapInArrow(_lowered, PATH_TYPE), "paths")
    return paths


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for head, body in _block_rows(batches):
        path, subroot, root = head[-3:]
        tree = _Tree([r[4] for r in body], body[0][3], path)
        for slot, r in enumerate(body):
            _, _, _, _, digest, replaced, row = r[:7]
            out.append((row, digest, subroot, root, tree.proof(slot), tree.fold(slot, replaced or digest)))
            if len(out) >= BATCH:
                yield _batch(out, PROOF)
                out = []
    yield _batch(out, PROOF)


PROOF = pa.schema([("row", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])
PROOF_TYPE = "row long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def manifest(docs: DataFrame, leaf: Column, replaced: Column | None = None, group: str = "source", order: str = "doc_id") -> DataFrame:
    """(``order``, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    ``replaced`` is the digest that takes the place of ``leaf`` when the row is folded, or null for none; each
    row is folded on its own, among the original siblings. ``order`` must be a long. Only digests
    are shuffled; join the result to other columns by ``order``.
    """
    other = (replaced if replaced is not None else F.lit(None)).cast("string")
    rows = docs.select(F.col(group).alias("_group"), F.col(order).cast("long").alias("row"), leaf.alias("digest"), other.alias("replaced"))
    rows = written(rows.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    # The tie parts rows that are equal in all else, so that copies of one row don't fill one part.
    placed = written(places(rows, ["_group", "row", "digest", "_tie"]).drop("_tie"), "placed")
    groups = written(placed.groupBy("_group").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("size")), "groups")
    groups = written(places(groups, ["first"]).withColumnRenamed("_at", "g"), "group-places")
    # Nodes know their group by number; the group itself may be null, its first place is not.
    known = groups.select(F.struct("_group").alias("_key"), "g", "first", "size")
    leaves = spread_join(placed.withColumn("_key", F.struct("_group")), known, "_key")
    leaves = leaves.select("g", (F.col("_at") - F.col("first")).alias("at"), "size", "digest", "replaced", "row")
    leaves = written(leaves, "numbered")
    tables = climb(leaves)
    subroots = tables[-1].select("g", "digest")
    n_groups = groups.count()
    tops = climb(written(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.lit(n_groups).cast("long").alias("size"), "digest"), "subroots"))
    # The root's own path is empty; a block that is a whole tree has the root's.
    root = tops[-1].select("g", "at", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    top = written(_with_paths(tops[0], descend(tops, root), ["digest"]).mapInArrow(_lowered, PATH_TYPE), "top-paths")
    top = top.drop("subroot").join(subroots.select(F.col("g").alias("at"), F.col("digest").alias("subroot")), "at")
    top = top.select(F.col("at").alias("g"), F.lit(0).cast("long").alias("at"), "path", "subroot", "root")
    dealt = _with_paths(leaves, descend(tables, top), ["digest", "replaced", "row"])
    out = dealt.mapInArrow(_folded, PROOF_TYPE).withColumnRenamed("row", order)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
