"""Periodic runs of words: stretches that repeat themselves with a fixed period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and
length max(``LEAST``, 2 q) or more, that no neighbouring word extends.

1. Recursive frequency splitting. Every word of a run is in it twice at least, so a word
   that occurs once in a segment is in none of its runs, and splits it. Parts of fewer than
   ``LEAST`` words hold no run. The parts are counted anew and split on, until none changes.
   Splitting only saves work: a text that has not settled after ``ROUNDS`` rounds is scanned
   as it is, with the same result.
2. Lag scan of the surviving segments. A run of period q is at least 2 q long, so it holds two
   neighbouring multiples of q. For each lag only these places are compared, and equal ones
   extended both ways over hashes of word sequences, in steps that halve. A segment of
   n words takes about n log n comparisons, whatever its periods. Each run is then checked word
   for word, so hashes decide nothing.
3. A stretch found at several lags has the least of them as period.

Texts are worked on one by one and whole, and nothing is shuffled. Null and empty texts, and
those of white space alone, have no runs and an empty collapsed text. Rows are judged
one by one, whatever their id; other columns pass through, and one named ``runs`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.llm.words import mix

LEAST = 12
ROUNDS = 100
PLACES = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period


def codes_of(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def surviving_segments(codes: np.ndarray, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(begin, end) of the parts of ``codes`` in which every word occurs twice or more."""
    place, width = np.arange(len(codes)), int(codes.max(initial=0)) + 1
    part = np.zeros(len(codes), np.int64)
    for _ in range(rounds):
        size = np.bincount(part)
        long = size[part] >= LEAST
        place, part = place[long], part[long]
        if not len(place):
            return []
        _, which, count = np.unique(part * width + codes[place], return_inverse=True, return_counts=True)
        often = count[which] > 1
        if often.all():
            break
        place = place[often]
        part = np.cumsum(np.diff(place, prepend=place[:1]) > 1)  # parts lie apart by what was taken out
    cuts = np.flatnonzero(np.diff(place) > 1) + 1
    bounds = zip(np.append(0, cuts), np.append(cuts, len(place)))
    return [(int(place[a]), int(place[z - 1]) + 1) for a, z in bounds if z - a >= LEAST]


class _Sequences:
    """Hashes of any stretch of ``codes`` for comparing stretches at a lag."""

    def __init__(self, codes: np.ndarray):
        steps = np.full(len(codes) + 1, _FACTOR, np.uint64)
        steps[0] = 1
        self.power = np.cumprod(steps)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64), 11) * self.power[:-1], out=self.total[1:])

    def equal(self, a: np.ndarray, z: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Whether the words from ``a`` to ``z`` are those from ``a + lag`` on."""
        t = self.total
        return (t[z] - t[a]) * self.power[lag] == t[z + lag] - t[a + lag]

    def reach(self, at: np.ndarray, lag: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """Number of words, ``limit`` at most, that are equal at the lag from ``at`` on (step 1) or before it (-1)."""
        low, high = np.zeros(len(at), np.int64), limit + 1
        while (open_ := high - low > 1).any():
            mid = np.where(open_, (low + high) // 2, low)
            good = self.equal(at, at + mid, lag) if step > 0 else self.equal(at - mid, at, lag)
            low, high = np.where(good, mid, low), np.where(good, high, mid)
        return low


def stretches(codes: np.ndarray, lag: int) -> list[Run]:
    """Runs of one lag by comparing every word."""
    same = np.concatenate(([0], (codes[lag:] == codes[:-lag]).astype(np.int8), [0]))
    edge = np.diff(same)
    return [
        (int(a), int(z - a) + lag, lag)
        for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))
        if z - a + lag >= max(LEAST, 2 * lag)
    ]


def lag_scan(codes: np.ndarray) -> list[Run]:
    """All runs of one segment, by start, then period."""
    n, found, lag = len(codes), set(), 1
    sequences = _Sequences(codes)
    while lag <= n // 2:
        upto, places = lag, 0
        while upto <= n // 2 and (upto == lag or places + (n - 1) // upto <= PLACES):
            places += (n - 1) // upto
            upto += 1
        lags = np.arange(lag, upto)
        counts = (n - 1) // lags
        q = np.repeat(lags, counts)
        at = (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)) * q
        hit = codes[at] == codes[at + q]
        at, q = at[hit], q[hit]
        after = sequences.reach(at, q, n - q - at, 1)
        before = sequences.reach(at, q, at, -1)
        long = after + before + q >= np.maximum(LEAST, 2 * q)
        found |= set(zip((at - before)[long].tolist(), (before + after + q)[long].tolist(), q[long].tolist()))
        lag = upto
    return sorted(_least_periods(codes, found))


def _least_periods(codes: np.ndarray, found: set[Run]) -> list[Run]:
    """The least period of each stretch, once words that far apart have been seen to be equal.

    Hashes can only make a stretch too long. Then its lag is scanned word by word. A
    multiple of a period that has been seen needs no look.
    """
    least: dict[tuple[int, int], int] = {}
    scanned: set[int] = set()
    todo = sorted(found, key=lambda r: r[2])
    for a, m, q in todo:
        known = least.get((a, m))
        if (known and q % known == 0) or q in scanned:
            continue
        if (codes[a : a + m - q] == codes[a + q : a + m]).all():
            least[a, m] = min(q, known or q)
        else:
            scanned.add(q)
    if scanned:
        exact = {r for r in found if r[2] not in scanned}.union(*(stretches(codes, q) for q in scanned))
        return _least_periods(codes, exact)
    return [(a, m, q) for (a, m), q in least.items()]


def runs_of(codes: np.ndarray) -> list[Run]:
    """All runs of a text, by start, then period."""
    return sorted((a + start, m, q) for a, z in surviving_segments(codes) for start, m, q in lag_scan(codes[a:z]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """False for the words that a run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for a, m, q in runs:
        depth[a + q] += 1
        depth[a + m] -= 1
    return np.cumsum(depth)[:-1] == 0


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("found", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
_RUN = pa.struct([(c, pa.int64()) for c in RUN.names])


@F.arrow_udf(FOUND)
def _find(texts: pa.Array) -> pa.Array:
    found, collapsed = [], []
    for text in texts:
        words = (text.as_py() or "").encode().split()  # bytes split at 20 and 09-0D only
        runs = runs_of(codes_of(words)) if len(words) >= LEAST else []
        if runs:
            words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
        found.append([dict(zip(RUN.names, r)) for r in runs])
        collapsed.append(b" ".join(words).decode())
    return pa.StructArray.from_arrays([pa.array(found, pa.list_(_RUN)), pa.array(collapsed, pa.string())], FOUND.names)


def find_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct column ``runs``: found (start, length, period of every run, by start,
    then period, in words) and collapsed (the words but those that a run repeats, joined by one space)."""
    return docs.withColumn("runs", _find(F.col("text")))
