"""Benchmark decontamination by latent semantic retrieval.

1. Words (lower case) are hashed to ``FEATURES`` features; document frequencies of the
   features are counted over all documents.
2. A randomised SVD gives the leading right singular vectors of the TF-IDF matrix of
   passages (``PASSAGE`` words): G = A'(A Omega), orthonormalised and applied again
   ``POWER`` times. Tasks add up A'(A Q) of their passages; only features x rank sums
   meet. All passages of all documents count.
3. Every window of every document (16, 32 and 48 words, a step of 8) is projected and
   compared by cosine with the benchmark items of about its length: those from ``COSINE``
   on are candidates.
   Before anything is projected, windows that can't hold a leak are passed over: a leak has c of
   an item's n words, so it has k of the n - c + k of them that are rarest in the documents. A
   window is projected for the items of its size of which k such key words (``KEY_HITS``, or c if that is
   less) stand in it or around it. This is exact, by the pigeonhole principle, and any choice of
   n - c + k words would do.
4. Where the words around a candidate's window hold too few of the item's, no common subsequence can
   be long enough. The others are compared with the item by their longest common subsequence, and with the words of its answer (its last sentence). A leak has
   ``LCS`` of the item's words in order, or ``LCS_ANSWER`` of them and ``ANSWER`` of the answer.
   Items of fewer than ``SHORT`` words need all their words in order.

Items are taken in blocks of ``BLOCK_ITEMS``, each a pass over the documents, so what is
broadcast has a bound. Rows are judged one by one where they lie: nothing is shuffled but
sums. Null and empty texts or items have no leaks; rows may repeat; other columns pass
through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.llm.words import Words, word_chunks

FEATURES = 1 << 15
RANK = 48
POWER = 1
PASSAGE = 32
TASK_DOCS = 20_000
PASSAGES_AT_ONCE = 16  # made dense over their own features; products of more take several threads, which wait for one another
HOP = 8
SIZES = (16, 32, 48)
COSINE = 0.5
LCS, LCS_ANSWER, ANSWER, SHORT = 0.7, 0.55, 0.8, 8
BLOCK_ITEMS = 4096
KEY_HITS = 4
CELLS = 1 << 21  # windows times items for which key words are counted at once


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null("").cast(pa.large_string()))


def _features(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)


def _tasks(docs: DataFrame, n: int) -> int:
    return max(docs.sparkSession.sparkContext.defaultParallelism, n // TASK_DOCS)


def feature_idf(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(idf of each feature, number of documents)."""

    def count(batches: Iterator[pa.RecordBatch]):
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for words in word_chunks(_lower(batch.column(0))):
                row = np.repeat(np.arange(len(words.ends)), words.ends - words.starts())
                total += np.bincount(np.unique(row * FEATURES + _features(words)) % FEATURES, minlength=FEATURES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], ["f", "df"])

    n = docs.count()
    sums = docs.select("text").coalesce(_tasks(docs, n)).mapInArrow(count, "f long, df long").groupBy("f").agg(F.sum("df").alias("df"))
    found = sums.toPandas()  # at most FEATURES + 1 rows
    df = np.zeros(FEATURES)
    known = found[found.f >= 0]
    df[known.f.to_numpy(np.int64)] = known.df.to_numpy(float)
    return np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.1), n


def _add_products(total: np.ndarray, words: Words, idf: np.ndarray, q: np.ndarray) -> None:
    """Add A'(A q) of the passages of one chunk to ``total``."""
    f = _features(words)
    at = np.arange(len(f)) - np.repeat(words.starts(), words.ends - words.starts())
    starts = np.flatnonzero(at % PASSAGE == 0)
    bounds, w = np.append(starts, len(f)), idf[f]
    w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), np.diff(bounds))
    place = np.zeros(FEATURES, np.int64)
    for first in range(0, len(starts), PASSAGES_AT_ONCE):
        ends = bounds[first : first + PASSAGES_AT_ONCE + 1]
        here = slice(ends[0], ends[-1])
        own = np.flatnonzero(np.bincount(f[here], minlength=FEATURES))
        place[own] = np.arange(len(own))
        cell = np.repeat(np.arange(len(ends) - 1) * len(own), np.diff(ends)) + place[f[here]]
        a = np.bincount(cell, w[here], (len(ends) - 1) * len(own)).astype(np.float32).reshape(-1, len(own))
        total[own] += a.T @ (a @ q[own])


def latent_basis(docs: DataFrame, idf: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Orthonormal basis (features x rank) of the leading right singular vectors of TF-IDF passages."""
    spark = docs.sparkSession
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, RANK)))[0].astype(np.float32)
    shared_idf = spark.sparkContext.broadcast(idf)
    for _ in range(1 + POWER):
        shared = spark.sparkContext.broadcast(q)

        def multiply(batches: Iterator[pa.RecordBatch]):
            idf, q = shared_idf.value, shared.value
            total = np.zeros((FEATURES, RANK))
            for batch in batches:
                for words in word_chunks(_lower(batch.column(0))):
                    if len(words.hashes):
                        _add_products(total, words, idf, q)
            some = np.flatnonzero(total.any(axis=1))
            if len(some):
                values = pa.FixedSizeListArray.from_arrays(pa.array(total[some].astype(np.float32).ravel()), RANK).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(some), values], ["f", "v"])

        parts = docs.select("text").coalesce(_tasks(docs, n)).mapInArrow(multiply, "f long, v array<float>")
        sums = parts.groupBy("f").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(RANK)]).alias("v")).toArrow()  # at most FEATURES rows
        g = np.zeros((FEATURES, RANK))
        if sums.num_rows:
            g[sums["f"].to_numpy()] = sums["v"].combine_chunks().flatten().to_numpy().reshape(-1, RANK)
            q = np.linalg.qr(g)[0].astype(np.float32)
        del sums, g
        shared.destroy()
    shared_idf.destroy()
    return q


class Items:
    """Benchmark items of one block: latent vectors by window size, words, answers."""

    def __init__(self, ids: list, texts: list[str], basis: np.ndarray, idf: np.ndarray):
        self.ids, self.words, self.answers, size, vectors = [], [], [], [], []
        for item, text in zip(ids, texts):
            hashes = next(iter(word_chunks(_lower(pa.array([text or ""]))))).hashes
            if not len(hashes):
                continue
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
            answer = next(iter(word_chunks(_lower(pa.array([sentences[-1]]))))).hashes
            f = (hashes >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)
            self.ids.append(item)
            self.words.append(hashes.tolist())
            self.answers.append(set(answer.tolist()))
            size.append(min(SIZES, key=lambda s: abs(s - len(hashes))))
            vectors.append(basis[f].sum(axis=0))
        v = np.array(vectors, np.float32).reshape(len(vectors), basis.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        self.size = size
        self.by_size = {s: np.flatnonzero(np.array(size, int) == s) for s in SIZES}
        # Words of all items, and for each item the place of a word in its own list of distinct words.
        self.vocabulary = np.unique(np.array([w for words in self.words for w in words], np.uint64))
        self.own, self.counts = [], []
        for words in self.words:
            distinct, counts = np.unique(np.array(words, np.uint64), return_counts=True)
            places = np.full(len(self.vocabulary) + 1, len(distinct), np.int32)
            places[np.searchsorted(self.vocabulary, distinct)] = np.arange(len(distinct))
            self.own.append(places)
            self.counts.append(counts)
        # For each item, which of its distinct words are key words, and how many of these a leak has at least.
        self.keys, self.least = {}, []
        for k, words in enumerate(self.words):
            c = math.ceil(self.needed(k) * len(words) - 1e-9)
            self.least.append(min(KEY_HITS, c))
            hashes = np.array(words, np.uint64)
            rare = np.argsort(-idf[(hashes >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)], kind="stable")
            self.keys[k] = np.zeros(len(self.counts[k]), bool)
            self.keys[k][self.own[k][np.searchsorted(self.vocabulary, hashes[rare[: len(words) - c + self.least[k]]])]] = True
        self.masks = []
        for words in self.words:
            mask: dict[int, int] = {}
            for i, w in enumerate(words):
                mask[w] = mask.get(w, 0) | 1 << i
            self.masks.append(mask)

    def needed(self, k: int) -> float:
        """Share of item ``k``'s words that a leak has at least."""
        return 1.0 if len(self.words[k]) < SHORT else LCS_ANSWER

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, or its length for other words."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary)).astype(np.int32)

    def windows(self, items: np.ndarray, numbers: np.ndarray, row: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``items``, block) of the windows whose words around, as far as compared, hold enough key words of the item.

        ``numbers`` are the words' places in the vocabulary, ``row`` their rows; row r begins at word
        ``starts[r]``, and its blocks are ``first[r]`` to ``first[r + 1] - 1``.
        """
        # Items by key word: those of word w are ``which[upto[w]:upto[w + 1]]``.
        word = [np.searchsorted(self.vocabulary, np.unique(np.array(self.words[k], np.uint64)))[self.keys[k]] for k in items]
        which = np.repeat(np.arange(len(items)), [len(w) for w in word])
        word = np.concatenate(word)
        which = which[np.argsort(word, kind="stable")]
        upto = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(self.vocabulary) + 1))))
        n = np.diff(upto)[numbers]
        held = np.flatnonzero(n)
        n = n[held]
        place = which[np.repeat(upto[numbers[held]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        held = np.repeat(held, n)
        # A window that begins at block b reaches from HOP words before it to ``reach`` words after its begin.
        reach = np.array([self.reach(k) for k in items])
        r = row[held]
        at = held - starts[r]
        low = np.maximum((at - reach[place]) // HOP + 1, 0) + first[r]
        high = np.minimum(at // HOP + 2, first[r + 1] - first[r]) + first[r]
        width = int(first[-1]) + 1
        some = low < high
        change = np.bincount((place * width + low)[some], minlength=len(items) * width) - np.bincount((place * width + high)[some], minlength=len(items) * width)
        count = np.cumsum(change).reshape(len(items), width)
        return np.nonzero(count >= np.array([self.least[k] for k in items])[:, None])

    def reach(self, k: int) -> int:
        """Words after the begin of a window that are compared with item ``k``."""
        return max(self.size[k], len(self.words[k])) + HOP

    def common(self, k: int, numbers: np.ndarray) -> np.ndarray:
        """Share of item ``k``'s words, with repeats, in each row of ``numbers``: no LCS is longer."""
        counts = self.counts[k]
        width = len(counts) + 1
        place = self.own[k][numbers] + np.arange(len(numbers))[:, None] * width
        found = np.bincount(place.ravel(), minlength=len(numbers) * width).reshape(-1, width)[:, :-1]
        return np.minimum(found, counts).sum(axis=1) / len(self.words[k])

    def compare(self, k: int, region: list[int]) -> tuple[float, float]:
        """(share of the item's words in common order, share of the answer's words) in ``region``."""
        n, masks = len(self.words[k]), self.masks[k]
        full = (1 << n) - 1
        row = full
        for w in region:  # one bit for each word of the item: Hyyro's bit-parallel LCS
            m = masks.get(w)
            if m is not None:
                u = row & m
                row = ((row + u) | (row - u)) & full
        lcs = (n - row.bit_count()) / n
        answer = self.answers[k]
        return lcs, len(answer.intersection(region)) / len(answer) if answer else 0.0

    def leaks(self, k: int, lcs: float, answer: float) -> bool:
        if len(self.words[k]) < SHORT:
            return lcs == 1.0
        return lcs >= LCS or (lcs >= LCS_ANSWER and answer >= ANSWER)


def _block_sums(basis: np.ndarray, f: np.ndarray, begin: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Running sums of the latent vectors of ``blocks``."""
    place = begin[blocks][:, None] + np.arange(HOP)
    inside = place < np.append(begin[1:], len(f))[blocks][:, None]
    # A place beyond the block counts as a feature without weight.
    feature = np.where(inside, f[np.minimum(place, len(f) - 1)], len(basis))
    basis = np.append(basis, np.zeros((1, basis.shape[1]), basis.dtype), axis=0)
    sums = basis[feature[:, 0]]
    for k in range(1, HOP):
        sums += basis[feature[:, k]]
    total = np.zeros((len(blocks) + 1, basis.shape[1]))
    np.cumsum(sums, axis=0, out=total[1:])
    return total


def _search(words: Words, basis: np.ndarray, items: Items) -> dict[int, dict[int, tuple]]:
    """{row: {item: (cosine, lcs, answer)}} of one chunk."""
    f, starts, n = _features(words), words.starts(), words.ends - words.starts()
    hits: dict[int, dict[int, tuple]] = {}
    if not len(f) or not items.ids:
        return hits
    of = np.repeat(np.arange(len(n)), n)
    begin = np.flatnonzero((np.arange(len(f)) - starts[of]) % HOP == 0)  # blocks of HOP words
    row = of[begin]
    upto = np.concatenate(([0], np.cumsum(-(-n // HOP))))
    last = upto[row + 1]  # end of the blocks of the row
    numbers = np.append(items.word_numbers(words.hashes), len(items.vocabulary))
    windows, used = [], np.zeros(len(begin) + 1, np.int64)
    for size, every in items.by_size.items():
        at_once = max(CELLS // (len(begin) + 1), 1)
        for k in range(0, len(every), at_once):
            which = every[k : k + at_once]
            place, held = items.windows(which, numbers[:-1], of, starts, upto)
            if not len(held):
                continue
            window, place_of = np.unique(held, return_inverse=True)
            end = np.minimum(window + size // HOP, last[window])
            windows.append((which, place, place_of, window, end))
            np.add.at(used, window, 1)
            np.add.at(used, end, -1)
    # Only blocks of such windows are projected, once for all sizes.
    blocks = np.flatnonzero(np.cumsum(used)[:-1] > 0)
    total = _block_sums(basis, f, begin, blocks)
    for which, place, place_of, window, end in windows:
        first = np.searchsorted(blocks, window)
        v = (total[first + end - window] - total[first]).astype(np.float32)
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]
        cuts = np.searchsorted(place, np.arange(len(which) + 1))
        for item, low, high in zip(which.tolist(), cuts[:-1], cuts[1:]):
            if low == high:
                continue
            cosine = v[place_of[low:high]] @ items.vectors[item]
            near = np.flatnonzero(cosine >= COSINE)
            if not len(near):
                continue
            found = window[place_of[low:high][near]]
            # Words around the window, as far as the row goes; the last number is no word.
            low = np.maximum(begin[found] - HOP, starts[row[found]])
            high = np.minimum(begin[found] + items.reach(item), words.ends[row[found]])
            region = low[:, None] + np.arange(items.reach(item) + HOP)
            common = items.common(item, numbers[np.where(region < high[:, None], region, len(f))])
            for j in np.flatnonzero(common >= items.needed(item)):
                r = int(row[found[j]])
                known = hits.get(r, {}).get(item)
                lcs, answer = items.compare(item, words.hashes[low[j] : high[j]].tolist())
                if items.leaks(item, lcs, answer) and (known is None or lcs > known[1]):
                    hits.setdefault(r, {})[item] = (float(cosine[near[j]]), lcs, answer)
    return hits


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("cosine", "lcs", "answer")]]))
HITS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) of ``docs`` with ``leaks``: array of (item_id, cosine, lcs, answer).

    ``docs`` needs text, ``benchmark`` item_id and text. A column of ``docs`` named leaks is
    replaced.
    """
    spark = docs.sparkSession
    columns = [c for c in (columns or docs.columns) if c != "leaks"]
    idf, n = feature_idf(docs)
    basis = latent_basis(docs, idf, n) * idf[:, None]
    shared_basis = spark.sparkContext.broadcast(basis)
    out = docs.select("text", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns) if c != "text"], F.array().cast(HITS).alias("leaks"))
    rows = benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator()
    while block := list(islice(rows, BLOCK_ITEMS)):
        shared = spark.sparkContext.broadcast(Items([r[0] for r in block], [r[1] for r in block], basis, idf))

        def search(batches: Iterator[pa.RecordBatch], shared=shared):
            items = shared.value
            for batch in batches:
                found = batch["leaks"].to_pylist()
                for words in word_chunks(_lower(batch["text"])):
                    for r, hits in _search(words, shared_basis.value, items).items():
                        found[words.first + r] = found[words.first + r] + [
                            {"item_id": items.ids[k], "cosine": c, "lcs": s, "answer": a} for k, (c, s, a) in sorted(hits.items())
                        ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, HITS_ARROW)], names=batch.schema.names)

        out = out.mapInArrow(search, out.schema)
    return out.select(*["text" if c == "text" else F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)], "leaks")
