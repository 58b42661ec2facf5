"""Uniform numbers by counter: a hash of a seed and of whole numbers, the same in any engine.

Two lanes of 32 bits, each a chain of multiplicative mixing rounds, give 53 bits. There
is no state: any number can be had anywhere, and again, whatever the partitioning. Parts
are whole numbers from 0 up to 2**32 - 1. The three forms (numpy, column, SQL) are
equal to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 32) - 1
#: Start and multipliers of each lane: odd constants that spread every bit.
LANES = ((0x243F6A88, (0x7FEB352D, 0x846CA68B, 1)), (0x85A308D3, (0x85EBCA6B, 0xC2B2AE35, 1)))


def _mix(x, factors):
    for f in factors:
        x = ((x ^ (x >> 16)) * f) & MASK
    return x


def _start(seed: int, lane: int) -> int:
    first, factors = LANES[lane]
    return _mix(_mix((first ^ seed) & MASK, factors) ^ ((seed >> 32) & MASK), factors)


def uniform(seed: int, *parts) -> np.ndarray:
    """Numbers in (0, 1) for whole-number arrays ``parts``, which are broadcast."""
    lanes = []
    for lane, (_, factors) in enumerate(LANES):
        h = np.uint64(_start(seed, lane))
        for part in parts:
            h = h ^ np.asarray(part).astype(np.uint64)
            for f in factors:
                h = ((h ^ (h >> np.uint64(16))) * np.uint64(f)) & np.uint64(MASK)
        lanes.append(h)
    whole = (lanes[0] << np.uint64(21)) + (lanes[1] >> np.uint64(11))
    return (whole.astype(np.float64) + 0.5) / float(1 << 53)


def _product(x: Column, f: Column) -> Column:
    """``x * f`` modulo 2**32 without leaving 64 bits."""
    high = (F.shiftright(x, 16) * f).bitwiseAND(0xFFFF)
    return (x.bitwiseAND(0xFFFF) * f + high * 65536).bitwiseAND(MASK)


def uniform_column(seed: int, *parts: Column) -> Column:
    """``uniform`` as a column expression."""

    def lane(k: int) -> Column:
        factors = F.array(*[F.lit(f).cast("long") for f in LANES[k][1]])
        given = F.array(*[p.cast("long") for p in parts])
        mixed = lambda h: F.aggregate(factors, h, lambda x, f: _product(x.bitwiseXOR(F.shiftright(x, 16)), f))
        return F.aggregate(given, F.lit(_start(seed, k)).cast("long"), lambda h, p: mixed(h.bitwiseXOR(p)))

    whole = lane(0) * (1 << 21) + F.shiftright(lane(1), 11)
    return (whole.cast("double") + 0.5) / float(1 << 53)


def uniform_sql(seed: int, parts: Sequence[str]) -> str:
    """``uniform`` as an SQL expression."""

    def lane(k: int) -> str:
        given = ", ".join([f"{_start(seed, k)}", *parts])
        factors = ", ".join(map(str, LANES[k][1]))
        return (
            f"list_reduce([{given}]::UBIGINT[], lambda h, p: list_reduce([xor(h, p), {factors}]::UBIGINT[], "
            f"lambda x, f: (xor(x, x >> 16) * f) & {MASK}::UBIGINT))"
        )

    return f"((({lane(0)} << 21) + ({lane(1)} >> 11))::DOUBLE + 0.5) / {1 << 53}"


def normal(seed: int, draws: np.ndarray, terms: int) -> np.ndarray:
    """Standard normal numbers (draws x ``terms``) by the Box-Muller transform of two uniform ones."""
    d, j = np.asarray(draws)[:, None], np.arange(terms)[None, :]
    return np.sqrt(-2.0 * np.log(uniform(seed, d, j, 1))) * np.cos(2.0 * np.pi * uniform(seed, d, j, 2))


def normal_column(seed: int, draw: Column, term: Column) -> Column:
    """``normal`` as a column expression."""
    u, v = (uniform_column(seed, draw, term, F.lit(k)) for k in (1, 2))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * np.pi * v)


def normal_sql(seed: int, draw: str, term: str) -> str:
    """``normal`` as an SQL expression."""
    u, v = (uniform_sql(seed, [draw, term, str(k)]) for k in (1, 2))
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"
