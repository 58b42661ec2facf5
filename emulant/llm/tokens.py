"""Token ids in shards of raw numbers, with a minimal perfect hash index over the keys.

Format, below one folder:

* ``shards/shard-NNNNNN.bin``: ids of the documents one after the other, little-endian
  unsigned 16-bit numbers (32-bit if the vocabulary needs it), nothing else. Shards and
  documents are in ascending order of doc_id, null ids first.
* ``index``: Parquet, one row for each bucket of keys. Keys fall into buckets by hash.
  In a bucket a minimal perfect hash of levels of bits (each level keeps the keys that
  have a bit to themselves, the others go to the next level) gives each key its own
  slot among as many slots as keys. A slot stores a 64-bit fingerprint of the key, the shard,
  the offset in it, the length, and the number of ids in all shards before it.

A look-up hashes the key, reads one bucket, tests a bit in a few levels, compares the
fingerprint and reads one range of one shard: constant time. Keys that aren't in the
index are found out by their fingerprint.

A key is (doc_id, occurrence): rows with the same id are numbered from 0 in the order
they are written, by hash of their text. Equal rows may spread over several shards.
Null and empty texts have only the end id. Shards are written under a name of the
attempt and then renamed, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emulant.llm.words import mix
from emulant.session import new_table_path, written

END_ID = 1
BUCKET_KEYS = 1024
LEVEL_BITS = 1.6
CHUNK_BYTES = 1 << 23  # of texts encoded at once
CALL_RUNS = 2048  # runs or pieces that go through the library in one call


#: How tokenizers of the kind ``</w>`` split text, and the same for lower-cased ASCII without white space.
SPLIT_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"


class Ids(NamedTuple):
    """Ids of strings, one after the other; string k has ``counts[k]`` of them."""

    values: np.ndarray
    counts: np.ndarray

    def take(self, which: np.ndarray) -> Ids:
        counts = self.counts[which]
        first = (np.cumsum(self.counts) - self.counts)[which] - (np.cumsum(counts) - counts)
        return Ids(self.values[np.repeat(first, counts) + np.arange(int(counts.sum()))], counts)


def _joined(parts: list[Ids], kind: str) -> Ids:
    return Ids(np.concatenate([np.zeros(0, kind), *(p.values for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p.counts for p in parts)]))


class WordEncoder:
    """Ids of whole texts as bytes, made from the ids of their runs between white space.

    Right for tokenizers whose tokens never cross ASCII white space and that drop it. The distinct runs of a chunk of
    texts go through the tokenizers library. Where the tokenizer lower-cases and splits by ``SPLIT_PIECES``, runs of
    printable ASCII are made from the ids of their distinct pieces, and pieces and other runs go through the library
    ``CALL_RUNS`` in a call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_type(path)
        self.split = splits_pieces(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # For pieces, which are normalised and split already; bytes of printable ASCII stand for themselves.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, WhitespaceSplit()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _alone(self, runs: list[str]) -> Ids:
        ids = [self._ids(r) for r in runs]
        return _joined([Ids(x, np.array([len(x)])) for x in ids], self.kind)

    def _pieces(self, pieces: list[str]) -> Ids:
        parts = []
        for k in range(0, len(pieces), CALL_RUNS):
            some = pieces[k : k + CALL_RUNS]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            good = len(ends) == len(some) and ends[-1] == len(ids)
            parts.append(Ids(ids, np.diff(ends, prepend=0)) if good else self._alone(some))
        return _joined(parts, self.kind)

    def _others(self, runs: list[str]) -> Ids:
        """Runs with a special token between every two: text is normalised and split between these."""
        mark, parts = self.special[0], []
        for k in range(0, len(runs), CALL_RUNS):
            some = runs[k : k + CALL_RUNS]
            ids = self._ids(mark.join(some))
            marks = ids == self.tokenizer.token_to_id(mark)
            cuts = np.flatnonzero(marks)
            good = len(cuts) == len(some) - 1
            parts.append(Ids(ids[~marks], np.diff(np.append(cuts, len(ids)), prepend=-1) - 1) if good else self._alone(some))
        return _joined(parts, self.kind)

    def _runs(self, runs: pa.Array) -> Ids:
        """Ids of distinct runs."""
        if not self.split or not self.special:
            return self._alone(runs.to_pylist())
        special = np.zeros(len(runs), bool)
        for token in self.special:
            special |= pc.match_substring(runs, token).to_numpy(zero_copy_only=False)
        made = pc.match_substring_regex(runs, r"^[\x21-\x7e]+$").to_numpy(zero_copy_only=False) & ~special
        cut = pc.replace_substring_regex(pc.ascii_lower(runs.filter(pa.array(made))), f"({ASCII_PIECES})", r"\1 ")
        lists = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(cut))
        pieces = lists.flatten().dictionary_encode()
        ids = self._pieces(pieces.dictionary.to_pylist()).take(pieces.indices.to_numpy())
        upto = np.concatenate(([0], np.cumsum(ids.counts)))
        parts = [Ids(ids.values, np.diff(upto[lists.offsets.to_numpy()]))]
        order = [np.flatnonzero(made)]
        for which, ids_of in ((special, self._alone), (~special & ~made, self._others)):
            parts.append(ids_of(runs.filter(pa.array(which)).to_pylist()))
            order.append(np.flatnonzero(which))
        place = np.empty(len(runs), np.int64)
        place[np.concatenate(order)] = np.arange(len(runs))
        return _joined(parts, self.kind).take(place)

    def encode_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, null counted as empty, in chunks of about ``CHUNK_BYTES``."""
        texts = texts.fill_null("").cast(pa.large_string())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, "right")))
            lists = pc.ascii_split_whitespace(texts.slice(at, upto - at))
            runs = lists.flatten().dictionary_encode()
            ids = self._runs(runs.dictionary).take(runs.indices.to_numpy())
            ends = np.concatenate(([0], np.cumsum(ids.counts)))[lists.offsets.to_numpy()] * ids.values.itemsize
            data = ids.values.tobytes()
            yield from (data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))
            at = upto

    def encode(self, text: str) -> bytes:
        return next(self.encode_texts(pa.array([text])))


def splits_pieces(path: str) -> bool:
    """Whether the tokenizer lower-cases and then splits by ``SPLIT_PIECES``, each piece ending with ``</w>``."""
    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    normalizers = [n["type"] for n in (known["normalizer"] or {}).get("normalizers", [])]
    splits = (known["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        normalizers == ["NFC", "Replace", "Lowercase"]
        and [p["type"] for p in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": SPLIT_PIECES}
        and splits[0]["behavior"] == "Removed"
        and splits[0]["invert"]
        and not (splits[1]["add_prefix_space"] or splits[1]["use_regex"])
        and known["model"].get("end_of_word_suffix") == "</w>"
        and all(t["special"] and not t["normalized"] for t in known["added_tokens"])
    )


def id_type(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _id_type_there(spark: SparkSession, path: str) -> str:
    """``id_type`` by a task: the vocabulary does not lie in the driver."""

    def kind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([id_type(path)] * batch.num_rows)], ["kind"])

    return spark.range(1, numPartitions=1).mapInArrow(kind, "kind string").first()[0]


def _write_shards(path: str, folder: str, end_id: int):
    """Rows of one partition, in order, to one shard; gives the place of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(f"{folder}/shards")
        encoder = WordEncoder(path)
        width, end = int(encoder.kind[-1]), np.array([end_id], encoder.kind).tobytes()
        attempt = f"{base}/_shard-{shard:06d}-{uuid.uuid4().hex}"
        at, last, seen = 0, object(), 0
        with fs.open_output_stream(attempt) as out:
            for batch in batches:
                ids, offsets, lengths, nth = batch.column(0), [], [], []
                for key, data in zip(ids.to_pylist(), encoder.encode_texts(batch.column(1))):
                    data += end
                    out.write(data)
                    seen = seen + 1 if key == last else 0
                    last = key
                    offsets.append(at)
                    lengths.append(len(data) // width)
                    nth.append(seen)
                    at += len(data) // width
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([shard] * len(ids), pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(nth, pa.int64())],
                    ["doc_id", "shard", "offset", "n_tokens", "nth"],
                )
        fs.move(attempt, f"{base}/shard-{shard:06d}.bin")

    return run


def _key(doc_id: Column, nth: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), nth)


def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys, level + 1) % np.uint64(size)).astype(np.int64)


def build_levels(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(size of each level, packed bits of all, slot of each key) for distinct hashes."""
    slot, left, sizes, bits, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), [], [], 0
    while len(left):
        size = max(8, int(LEVEL_BITS * len(left)))
        place = _bits(keys[left], len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        own = alone[place]
        slot[left[own]] = before + rank[place[own]]
        before += int(alone.sum())
        sizes.append(size)
        bits.append(alone)
        left = left[~own]
    return sizes, np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little").tobytes(), slot


def find_slots(keys: np.ndarray, sizes: list[int], packed: bytes) -> np.ndarray:
    """Slot of each hash; of a hash that isn't in the index any slot or -1."""
    bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
    slot, left, start, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, 0
    for level, size in enumerate(sizes):
        own = bits[start : start + size]
        place = _bits(keys[left], level, size)
        found = own[place]
        slot[left[found]] = before + (np.cumsum(own) - 1)[place[found]]
        left, start, before = left[~found], start + size, before + int(own.sum())
    return slot


INDEX = "bucket long, keys long, sizes array<int>, bits binary, fingerprint binary, shard binary, offset binary, n_tokens binary, start binary"
STORED = (("fingerprint", "<u8"), ("shard", "<i4"), ("offset", "<i8"), ("n_tokens", "<i8"), ("start", "<i8"))


def _build_bucket(table: pa.Table) -> pa.Table:
    hashes = table["key"].to_numpy().view(np.uint64)
    sizes, bits, slot = build_levels(hashes)
    row = {"bucket": [table["bucket"][0].as_py()], "keys": [len(hashes)], "sizes": [sizes], "bits": [bits]}
    for name, kind in STORED:
        values = mix(hashes, 77) if name == "fingerprint" else table[name].to_numpy()
        placed = np.zeros(len(hashes), kind)
        placed[slot] = values.astype(kind)
        row[name] = [placed.tobytes()]
    kinds = {"bucket": pa.int64(), "keys": pa.int64(), "sizes": pa.list_(pa.int32())}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in row.items()})


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> str:
    """Write shards and index of ``docs`` (doc_id, text); gives the folder."""
    spark = docs.sparkSession
    folder = folder or new_table_path(spark, "tokens")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shards")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    if ":/" not in folder:
        folder = f"file://{folder}"
    order = ["doc_id", "_by"]
    ranged = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_by"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    )
    rows = written(
        ranged.mapInArrow(_write_shards(tokenizer, folder, end_id), "doc_id long, shard int, offset long, n_tokens long, nth long"), "token-rows"
    )
    # One row for each shard, and for each id that goes on from one shard to the next.
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_t"))
    ahead = F.sum("_t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select(F.col("shard").alias("_shard"), F.coalesce(ahead, F.lit(0)).alias("_base"))
    rows = rows.join(F.broadcast(shards), F.col("shard") == F.col("_shard")).withColumn("start", F.col("_base") + F.col("offset"))
    spans = rows.groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("_c"))
    earlier = F.sum("_c").over(Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("shard").alias("_sh"), earlier.alias("_e")).filter("_e > 0")
    rows = rows.join(spans, F.expr("doc_id <=> _d AND shard = _sh"), "left").withColumn("nth", F.col("nth") + F.coalesce("_e", F.lit(0)))
    rows = written(rows.select("doc_id", "nth", "shard", "offset", "n_tokens", "start"), "token-places")
    buckets = -(-max(rows.count(), 1) // BUCKET_KEYS)
    keyed = rows.withColumn("key", _key(F.col("doc_id"), F.col("nth"))).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    keyed.drop("doc_id", "nth").groupBy("bucket").applyInArrow(_build_bucket, INDEX).write.parquet(f"{folder}/index")
    rows.select("doc_id", "nth").write.parquet(f"{folder}/keys")
    return folder


def look_up(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, nth, shard, offset, n_tokens, start) of the (doc_id, nth) that are in the index."""
    spark = keys.sparkSession
    index = spark.read.parquet(f"{folder}/index")
    buckets = -(-max(index.agg(F.sum("keys")).first()[0] or 0, 1) // BUCKET_KEYS)
    asked = keys.select("doc_id", "nth", _key(F.col("doc_id"), F.col("nth")).alias("key"))
    asked = asked.withColumn("_bucket", F.pmod("key", F.lit(buckets)))
    # A bucket holds about BUCKET_KEYS keys, so the keys asked of it are as few.
    packs = asked.groupBy("_bucket").agg(F.collect_list(F.struct("doc_id", "nth", "key")).alias("asked"))
    met = packs.join(index, F.col("_bucket") == F.col("bucket")).drop("_bucket")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                asked = row["asked"].values.slice(row["asked"].offsets[0].as_py(), len(row["asked"][0]))
                hashes = asked.field("key").to_numpy().view(np.uint64)
                slot = find_slots(hashes, row["sizes"][0].as_py(), row["bits"][0].as_py())
                stored = {name: np.frombuffer(row[name][0].as_py(), kind) for name, kind in STORED}
                good = slot >= 0
                good[good] = stored["fingerprint"][slot[good]] == mix(hashes[good], 77)
                take = pa.array(np.flatnonzero(good))
                at = slot[good]
                yield pa.RecordBatch.from_arrays(
                    [asked.field("doc_id").take(take), asked.field("nth").take(take)]
                    + [pa.array(stored[n][at].astype("i4" if n == "shard" else "i8")) for n in ("shard", "offset", "n_tokens", "start")],
                    ["doc_id", "nth", "shard", "offset", "n_tokens", "start"],
                )

    return met.mapInArrow(find, "doc_id long, nth long, shard int, offset long, n_tokens long, start long")


def read_ids(places: DataFrame, folder: str, kind: str) -> DataFrame:
    """``places`` with the ids read from the shards: ``ids_crc32`` of them as 32-bit numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(f"{folder}/shards")
        width, name, file = int(kind[-1]), None, None
        for batch in batches:
            crcs = []
            for shard, offset, n in zip(*(batch[c].to_numpy() for c in ("shard", "offset", "n_tokens"))):
                if shard != name:
                    name, file = shard, fs.open_input_file(f"{base}/shard-{shard:06d}.bin")
                data = file.read_at(int(n) * width, int(offset) * width)
                ids = np.frombuffer(data, kind)
                if len(ids) != n:
                    raise OSError(f"shard {shard} ends within a document")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crcs, pa.int64())], [*batch.schema.names, "ids_crc32"])

    # Rows of a shard by ranges, so that one shard's reads may be split over tasks.
    near = places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return near.mapInArrow(read, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in places.schema)}, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs``, look every key up in the index, and read its ids back."""
    spark: SparkSession = docs.sparkSession
    folder = write_tokens(docs, tokenizer)
    keys = spark.read.parquet(f"{folder}/keys")
    return read_ids(look_up(keys, folder), folder, _id_type_there(spark, tokenizer))
