"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

1. A document is the weighted set of its five-word shingles (lower case), weight tf * idf, where
   idf is log(documents / documents with the shingle). All shingles are counted, exactly. The documents are dealt
   into parts of about ``PART_CHARS``, and the hashes into as many ranges. Tasks send the hashes of a range, with the parts
   that hold them, in pieces of steps between hashes; a task counts a range and answers every part in the order of
   its hashes, where the counts meet the texts of the part. So no task holds more than a range or a part, and nothing
   but the number of documents is told to all of them. About 9 bytes are sent for a shingle of a document.
2. Improved consistent weighted sampling (Ioffe 2010) draws ``BANDS * ROWS`` samples; equal
   samples have the probability of the weighted Jaccard similarity. ROWS samples make
   a band. A text whose shingles of two documents or more weigh less than ``SIMILAR`` of all its shingles
   can't be that similar to any other text, and needs no samples.
3. Equal texts (the same words) are one class before anything is compared. The buckets are taken in
   ``ROUNDS`` of bands. All sets of a bucket that holds more than one class so far meet in a task, and
   every two of them are compared by the exact weighted Jaccard similarity unless links found
   by then join their classes already: no link between classes is left out, and a group of copies
   costs its members times those that stay apart from it. A bucket of more than ``BLOCK_SHINGLES`` is
   dealt into blocks, of which every two meet, so a task holds two blocks at most.
4. Classes are connected components of the verified links, made anew after each round.

Documents without words (null or empty too) and null ids are classes of their own and are kept.
Texts of fewer than five words have one shingle of all of them. Repeated ids are classed
row by row, their ids being equal: all rows of an id get the class of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulant.llm.links import components
from emulant.llm.words import mix, shingles, word_chunks
from emulant.session import new_table_path, shuffles_freed, written

BANDS, ROWS = 8, 3
ROUNDS = ((0,), (1, 2), tuple(range(3, BANDS)))
HEADS = 32
BLOCK_SHINGLES = 1 << 19
SIMILAR = 0.8
IDF_FLOOR = 0.0  # every count is known
PART_CHARS = 1 << 23  # bytes of the texts of a part, which a task holds with its shingles and their counts
BATCH_DOCS = 1000  # texts that go to Python at once
PIECE_SHINGLES = 1 << 19  # shingles that a task holds before it reports
BITS_EACH, MOST_BITS = 16, 27  # 16 MB at most; with many more ids than bits, sets are made that meet none


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, shingle, tf, hash of the word sequence by row), shingles distinct and sorted in a row."""
    for words in word_chunks(column):
        h, ends = shingles(words)
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(at, append=len(h))
        # Word sequence: sum of word hashes mixed with their place.
        starts, n = words.starts(), words.ends - words.starts()
        place = np.arange(len(words.hashes)) - np.repeat(starts, n)
        placed = mix(words.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(placed)))  # whole numbers: a text's hash is the same wherever it lies
        yield words.first, row[at], h[at], tf, mix(total[words.ends] - total[starts] + n.astype(np.uint64))


def _packed(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, the planes of zeros at the end left out; the first byte is the number of planes."""
    planes = values.view(np.uint8).reshape(-1, 8).T
    k = max([i + 1 for i in range(8) if planes[i].any()], default=1)
    return bytes([k]) + planes[:k].tobytes()


def _unpacked(packed: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(kind).ravel()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from that before it in any of the columns; the first does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _reports(ranges: int):
    """(range, h, part, c) of pieces of (text, part): steps between ascending hashes of the range, parts that hold them, and how many documents of each."""

    def report(seen: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        h, part = np.concatenate(seen), np.concatenate(parts)
        order = np.argsort(h)
        h, part = h[order], part[order]
        at = np.flatnonzero(_changes(h, part))  # those of one hash and part are put together where they lie side by side
        h, part, c = h[at], part[at], np.diff(at, append=len(h))
        cuts = np.searchsorted((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        spans = [slice(*x) for x in zip(cuts[some], cuts[some + 1])]
        packed = [[_packed(np.diff(h[x], prepend=np.uint64(0))) for x in spans], [_packed(part[x]) for x in spans], [_packed(c[x]) for x in spans]]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(x, pa.binary()) for x in packed]], ["range", "h", "part", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, size = [], [], 0
        for batch in batches:
            part = batch.column(1).to_numpy()
            for first, row, h, _, _ in _sets(batch.column(0)):
                seen.append(h)
                parts.append(part[first + row])
                size += len(h)
                if size > PIECE_SHINGLES:
                    yield report(seen, parts)
                    seen, parts, size = [], [], 0
        if size:
            yield report(seen, parts)

    return run


def _groups(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Rows of each value of column ``name``, by which they are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[name].to_numpy()
        cuts = np.flatnonzero(_changes(values))
        for a, b in zip(cuts, np.append(cuts[1:], len(values))):
            if held and held[0][name][0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _counted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, part, df) of the reports of one range, h ascending, df the documents of all parts that hold h."""
    h = np.concatenate([np.cumsum(_unpacked(x.as_py(), np.uint64)) for x in rows["h"]])
    part, c = (np.concatenate([_unpacked(x.as_py()) for x in rows[k]]) for k in ("part", "c"))
    order = np.argsort(h)
    h, part, c = h[order], part[order], c[order]
    at = np.flatnonzero(_changes(h))
    return h, part, np.repeat(np.add.reduceat(c, at), np.diff(at, append=len(h)))


def frequent_shingles(docs: DataFrame, floor: float = IDF_FLOOR, part: str | None = None, parts: int = 1) -> tuple[DataFrame, int]:
    """((h, df) of the shingles in at least ``floor`` of the documents, number of documents with text).

    With a column ``part``, numbers from 0 to ``parts`` - 1, instead (part, range, df): for the documents of a part the
    counts of all their distinct shingles, by range in order of the hashes.
    """
    text = docs.select(F.lower("text").alias("t"), (F.col(part) if part else F.lit(0)).cast("long").alias("part")).filter("t IS NOT NULL")
    n = text.count()
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, parts)
    reports = text.mapInArrow(_reports(ranges), "range int, h binary, part binary, c binary").repartitionById(ranges, "range").sortWithinPartitions("range")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "range"):
            h, _, df = _counted(rows)
            some = _changes(h) & (df >= floor * n)
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(df[some])], ["h", "df"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "range"):
            h, p, df = _counted(rows)
            order = np.argsort(p.astype(np.min_scalar_type(parts)), kind="stable")
            order = order[_changes(p[order], h[order])]
            p, df = p[order], df[order]
            at = np.flatnonzero(_changes(p))
            packed = [_packed(x) for x in np.split(df, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(p[at]), pa.array(np.repeat(rows["range"][0].as_py(), len(at))), pa.array(packed, pa.binary())], ["part", "range", "df"])

    if part:
        return reports.mapInArrow(answers, "part long, range long, df binary"), n
    return written(reports.mapInArrow(shares, "h long, df long"), "shingle-counts"), n


def idf_of(df: np.ndarray, n: int, floor: float = 0.0) -> np.ndarray:
    # A shingle of every document still weighs a little, so that no set is without weight.
    return np.maximum(-np.log(np.clip(df / max(n, 1), max(floor, 1 / max(n, 1)), 1)), 0.01).astype(np.float32)


class Idf:
    """Weights of shingles: known counts, those of the floor, or of one document, for all others."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n: int, floor: float):
        order = np.argsort(hashes, kind="stable")  # numbers in order take no time
        self.hashes, self.top = hashes[order], idf_of(np.zeros(1), n, floor)[0]
        self.idf = idf_of(df[order], n, floor)

    def weights(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.top, np.float32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            out[known] = self.idf[at[known]]
        return out * tf.astype(np.float32)


def icws(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """Samples (one row for each set, ``samples`` columns) of the sets that begin at ``starts``.

    r and c are Gamma(2, 1), beta is uniform, all by hash of shingle and sample:
    t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r; the sample is (shingle, t)
    of least a.
    """
    out = np.empty((len(starts), samples), np.int64)
    log_w = np.log(weight)
    sizes = np.diff(starts, append=len(h))
    for k in range(samples):
        bits = mix(h, 100 + k)
        more = bits * np.uint64(0xDA942042E4DD58B5)
        u = [((x & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 21) for x in (bits, bits >> np.uint64(21), bits >> np.uint64(42), more >> np.uint64(43), more >> np.uint64(22))]
        r = -np.log(u[0] * u[1])
        log_c = np.log(-np.log(u[2] * u[3]))
        beta = u[4]
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta) - r
        best = np.minimum.reduceat(log_a, starts)
        hit = np.flatnonzero(log_a == np.repeat(best, sizes))
        row = np.searchsorted(starts, hit, "right") - 1
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        hit = hit[first]
        out[:, k] = mix(h[hit] ^ (t[hit].astype(np.int64).view(np.uint64) << np.uint64(1)), k).view(np.int64)
    return out


def _rows(ids: pa.Array, first: int, row: np.ndarray, h: np.ndarray, weight: np.ndarray, text: np.ndarray, with_bands: bool) -> Iterator[pa.RecordBatch]:
    """Signatures of sets, or the sets themselves."""
    starts = np.flatnonzero(_changes(row)) if len(row) else np.zeros(0, np.int64)
    if not len(starts):
        return
    rows = row[starts]
    columns, names = [ids.take(pa.array(first + rows)), pa.array(text[rows].view(np.int64))], ["doc_id", "same"]
    if with_bands:
        bands = icws(h, weight, starts, BANDS * ROWS).reshape(-1, BANDS, ROWS).view(np.uint64)
        key = np.zeros(bands.shape[:2], np.uint64)
        for r in range(ROWS):
            key = mix(key ^ bands[:, :, r], 9)
        columns.append(pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())))
        columns.append(pa.array(np.diff(starts, append=len(h))))
        names += ["bands", "size"]
    else:
        ends = np.append(starts, len(h)).astype(np.int32)
        columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(ends), pa.array(weight))]
        names += ["h", "w"]
    yield pa.RecordBatch.from_arrays(columns, names)


def _batches(docs_column: int, idf: Idf | None, with_bands: bool):
    """Signatures or sets of documents; without ``idf`` the weights are tf."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for first, row, h, tf, text in _sets(batch.column(docs_column)):
                weight = idf.weights(h, tf) if idf else tf.astype(np.float32)
                yield from _rows(batch.column(0), first, row, h, weight, text, with_bands)

    return run


def _signed(n: int, similar: float):
    """(doc_id, same, bands, size, df) of the rows of a part, which follow its counts; df are those of the shingles of a text by hash.

    What a text shares with any other is part of its shingles of two documents or more. If these weigh less than ``similar``
    of all of its shingles, no text is like it, and it has no signature.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("bands", pa.list_(pa.int64())), ("size", pa.int64()), ("df", pa.binary())])

    def part(docs: pa.Table, counts: pa.Table) -> Iterator[pa.RecordBatch]:
        df = np.concatenate([np.zeros(0, np.int64), *[_unpacked(x.as_py()) for x in counts["df"]]])
        found = [(batch["doc_id"], s) for batch in docs.to_batches() for s in _sets(batch["text"])]
        every = np.concatenate([np.zeros(0, np.uint64), *[s[2] for _, s in found]])
        order = np.argsort(every)
        h = every[order]
        new = _changes(h) if len(h) else np.zeros(0, bool)
        if new.sum() != len(df):
            raise ValueError(f"{len(df)} shingles of a part were counted, {new.sum()} are there now: the texts have changed in between")
        place = np.empty(len(every), np.int64)
        place[order] = np.cumsum(new) - 1
        idf, at = Idf(h[new], df, n, IDF_FLOOR), 0
        for ids, (first, row, h, tf, text) in found:
            here = place[at : at + len(h)]
            at += len(h)
            if not len(h):
                continue
            counted, weight = df[here], idf.idf[here] * tf.astype(np.float32)
            starts = np.flatnonzero(_changes(row))
            shared = np.add.reduceat(np.where(counted > 1, weight, 0), starts, dtype=np.float64)
            able = shared >= similar * (1 - 1e-6) * np.add.reduceat(weight, starts, dtype=np.float64)
            some = np.repeat(able, np.diff(starts, append=len(h)))
            for signed in _rows(ids, first, row[some], h[some], weight[some], text, True):
                packed = [_packed(x) for x in np.split(counted[some], np.cumsum(signed["size"].to_numpy())[:-1])]
                yield pa.RecordBatch.from_arrays([*signed.columns, pa.array(packed, pa.binary())], schema=kind)
            rest = row[starts[~able]]
            alone = [ids.take(pa.array(first + rest)), pa.array(text[rest].view(np.int64)), *[pa.nulls(len(rest), kind.field(k).type) for k in ("bands", "size", "df")]]
            yield pa.RecordBatch.from_arrays(alone, schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "part"):
            yield from part(rows.filter(pc.field("range").is_null()), rows.filter(pc.field("range").is_valid()))

    return run


def _weighed(n: int):
    """(id, same, h, w) of (id, same, h, w, df), ``w`` tf before and tf * idf after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                df = np.concatenate([_unpacked(x.as_py()) for x in batch["df"]])
                w = batch["w"].flatten().to_numpy() * idf_of(df, n, IDF_FLOOR)
                ends = np.cumsum(pc.list_value_length(batch["w"]).to_numpy(), dtype=np.int32)
                w = pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int32), ends))), pa.array(w))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["same"], batch["h"], w], ["id", "same", "h", "w"])

    return run


def group_links(classes: np.ndarray, ends: np.ndarray, h: np.ndarray, w: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Places (u, v) of similar sets that join all classes of one group that any of its links joins.

    Set k has the shingles up to ``ends[k]``. Heads from the largest class come first, as they
    take in most of a group of copies. Each set that is still outside then meets all others.
    """
    starts, w = np.concatenate(([0], ends[:-1])), w.astype(np.float64)
    column = np.unique(h, return_inverse=True)[1]
    label = np.unique(classes, return_inverse=True)[1]
    total, own, done = np.add.reduceat(w, starts), np.zeros(len(h)), np.zeros(len(ends), bool)
    found: list[tuple[int, int]] = []

    def meet(x: int) -> None:
        done[x] = True
        at = column[starts[x] : ends[x]]
        own[at] = w[starts[x] : ends[x]]
        low = np.add.reduceat(np.minimum(w, own[column]), starts)
        own[at] = 0
        for y in np.flatnonzero(~done & (label != label[x]) & (low / (total + total[x] - low) >= similar)):
            if label[y] != label[x]:
                found.append((x, int(y)))
                label[label == label[y]] = label[x]

    for _ in range(HEADS):
        inside = label == np.bincount(label).argmax()
        if inside.all() or not (inside & ~done).any():
            break
        meet(int(np.flatnonzero(inside & ~done)[0]))
    large = int(np.flatnonzero(label == np.bincount(label).argmax())[0])
    for x in np.flatnonzero(~done):
        if label[x] != label[large]:
            meet(int(x))
    return found


def _group_links(similar: float):
    """Links of the groups of (g, id, class, h, w), which come in order of g."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        ids, classes = (rows[c].to_numpy() for c in ("id", "class"))
        h, w = (rows[c].combine_chunks().flatten().to_numpy() for c in ("h", "w"))
        ends = np.cumsum(pc.list_value_length(rows["h"]).to_numpy())
        g = rows["g"].to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
        u, v = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            first = ends[a - 1] if a else 0
            here = slice(first, ends[b - 1])
            for x, y in group_links(classes[a:b], ends[a:b] - first, h[here], w[here], similar):
                u.append(ids[a + x])
                v.append(ids[a + y])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch["g"].to_numpy()
            # The last group may go on in the next batch.
            last = int(np.searchsorted(g, g[-1]))
            if last or (held and held[0]["g"][-1].as_py() != g[-1]):
                yield links(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _meetings(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(g, id, same, class) of the members of buckets with more than one class; g is one meeting of a bucket or two blocks."""
    named = members.join(roots, F.col("id") == F.col("node"), "left").withColumn("class", F.coalesce("root", "id")).drop("node", "root")
    blocks = F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("blocks")
    apart = named.groupBy("band", "key").agg(F.min("class").alias("_a"), F.max("class").alias("_b"), blocks).filter("_a < _b").drop("_a", "_b")
    met = named.join(apart, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("same"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: (x != F.col("block")) | (F.col("blocks") == 1))
    met = met.withColumn("other", F.explode(others))
    g = F.xxhash64("band", "key", F.least("block", "other"), F.greatest("block", "other"))
    return met.select(g.alias("g"), "id", "same", "class")


def _bit_places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64), 21) & np.uint64(bits - 1)).astype(np.int64)


def id_bits(ids: DataFrame) -> np.ndarray:
    """Bytes with the bits of the hashes of ``id`` set: ``BITS_EACH`` for each id or more, 2^``MOST_BITS`` at most.

    The bits are put together on the executors, in parts of 2^16.
    """
    bits = 1 << min(max((BITS_EACH * ids.count()).bit_length(), 16), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit_places(batch.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 16), pa.array(at & 0xFFFF)], ["part", "place"])

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << 16, bool)
        flags[table["place"].to_numpy()] = True
        return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()])})

    parts = ids.select(F.col("id").cast("long")).mapInArrow(places, "part long, place long")
    out = np.zeros(max(bits >> 3, 1 << 13), np.uint8)
    for part, packed in parts.groupBy("part").applyInArrow(pack, "part long, bits binary").collect():
        out[part << 13 : (part + 1) << 13] = np.frombuffer(packed, np.uint8)
    return out


def has_bit(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the bit of each id is set: always for the ids of ``id_bits``, seldom for others."""
    at = _bit_places(ids, len(packed) * 8)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def near_links(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(links (u, v) between ids of different texts, (doc_id, rep) of all rows with words).

    ``rep`` is the least id with the same words. The links join all classes that similar texts
    of a bucket join; texts that they join already have no link of their own.
    """
    with shuffles_freed(docs.sparkSession, BATCH_DOCS):
        return _near_links(docs, similar)


def _near_links(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, chars // PART_CHARS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts).cast("long")))
    counts, n = frequent_shingles(placed, part="part", parts=parts)
    docs, placed = (x.withColumn("text", F.lower("text")) for x in (docs, placed))
    # The counts of a part come before its texts.
    rows = placed.unionByName(counts, allowMissingColumns=True).withColumn("part", F.col("part").cast("int")).repartitionById(parts, "part")
    rows = rows.sortWithinPartitions("part", F.col("range").asc_nulls_last()).select("part", "range", "doc_id", "text", "df")
    signed = written(rows.mapInArrow(_signed(n, similar), "doc_id long, same long, bands array<long>, size long, df binary"), "signatures")
    reps = signed.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    member = signed.select("doc_id", "same").join(reps.select("same", "rep"), "same").select("doc_id", "rep")
    buckets = reps.select(F.col("rep").alias("id"), "same", "size", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    members = written(buckets.join(shared, ["band", "key"]), "buckets")
    # Sets of the documents that share a bucket, made where the texts lie; those of ids that only look alike meet none.
    wanted = spark.sparkContext.broadcast(id_bits(members.select("id").distinct()))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(wanted.value, batch["doc_id"].to_numpy())))

    sets = docs.mapInArrow(lambda batches: _batches(1, None, False)(held(batches)), "doc_id long, same long, h array<long>, w array<float>")
    sets = sets.withColumnRenamed("doc_id", "id").dropDuplicates(["id", "same"])
    dfs = signed.select(F.col("doc_id").alias("id"), "same", "df").join(members.select("id", "same"), ["id", "same"], "left_semi").dropDuplicates(["id", "same"])
    sets = sets.join(dfs, ["id", "same"]).select("id", "same", "h", "w", "df")
    sets = written(sets.mapInArrow(_weighed(n), "id long, same long, h array<long>, w array<float>"), "shingle-sets")
    link_folder, link_type = new_table_path(spark, "near-links"), "u long, v long"
    spark.createDataFrame([], link_type).write.parquet(link_folder)
    roots = spark.createDataFrame([], "node long, root long")
    for turn, bands in enumerate(ROUNDS):
        met = _meetings(members.filter(F.col("band").isin(*bands)), roots).join(sets, ["id", "same"])
        met = met.select("g", "id", "class", "h", "w").repartition("g").sortWithinPartitions("g")
        met.mapInArrow(_group_links(similar), link_type).write.mode("append").parquet(link_folder)
        if turn + 1 < len(ROUNDS):
            roots = written(components(spark.read.schema(link_type).parquet(link_folder)), "roots")
    return spark.read.schema(link_type).parquet(link_folder), member


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with the struct column ``near``: class_id (least id of the class), kept.

    One row of each class is kept: that of ``class_id``, of repeated ids any one; rows
    without words or id are kept, with their own id as class.
    """
    links, member = near_links(docs, similar)
    roots = components(links)
    classes = member.join(roots, F.col("rep") == F.col("node"), "left").select(
        F.col("doc_id").alias("_id"), F.coalesce("root", "rep").alias("_class")
    )
    # Rows of one id share the least class of their texts.
    classes = classes.groupBy("_id").agg(F.min("_class").alias("_class"), F.count(F.lit(1)).alias("_rows"))
    out = docs.join(classes, docs["doc_id"] == F.col("_id"), "left")
    near = F.struct(
        F.coalesce("_class", docs["doc_id"]).cast("long").alias("class_id"),
        (F.col("_class").isNull() | (F.col("_class") == docs["doc_id"])).alias("kept"),
    )
    return out.withColumn("near", near).select(*docs.columns, "near")
