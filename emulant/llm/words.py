"""Words of whole texts as 64-bit hashes, in numpy, straight from Arrow buffers.

A word is a run of bytes other than ASCII white space (20, 09-0D). Texts are worked on
in chunks of about a megabyte, so memory does not grow with a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE = 5

_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalizer that spreads every bit of ``x`` over 64 bits."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Words(NamedTuple):
    """Words of the rows ``first`` to ``first + len(ends) - 1`` of a batch."""

    first: int
    hashes: np.ndarray  # of all words, row after row
    ends: np.ndarray  # for each row, the number of words up to its end

    def starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1])).astype(np.int64)


def _chunk(data: np.ndarray, offsets: np.ndarray, first: int) -> Words:
    base, size = offsets[0], int(offsets[-1] - offsets[0])
    if not size:
        return Words(first, np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64))
    data, offsets = data[base : base + size], (offsets - base).astype(np.int64)
    word = _NOT_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = np.unique(offsets[(offsets > 0) & (offsets < size)])  # a row's end also ends a word
    begins[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(size)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:size], out=total[1:])
    hashes = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return Words(first, hashes, np.searchsorted(begin, offsets[1:], "left"))


def word_chunks(column: pa.Array) -> Iterator[Words]:
    """Words of a string column, null counted as empty, in chunks of whole rows."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        upto = min(upto, n)
        yield _chunk(data, offsets[at : upto + 1], at)
        at = upto


def shingles(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row, and for each row how many there are up to its end.

    A row with fewer words than ``width`` has one shingle of all its words; a row
    without words has none.
    """
    h, starts = words.hashes, words.starts()
    counts = words.ends - starts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.cumsum(n)
    if not len(h):
        return np.zeros(0, np.uint64), ends
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    sums = np.zeros(len(h), np.uint64)
    for k in range(width):
        sums = sums * np.uint64(0x5851F42D4C957F2D) + padded[k : k + len(h)]
    row = np.repeat(np.arange(len(n)), n)
    at = starts[row] + np.arange(len(row)) - (ends - n)[row]
    out = mix(sums[at])
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        short = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in h[starts[r] : starts[r] + counts[r]]:
                short = short * np.uint64(0x5851F42D4C957F2D) + x
        out[ends[r] - 1] = mix(np.array([short], np.uint64), int(counts[r]))[0]
    return out, ends
