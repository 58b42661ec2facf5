"""Draws with replacement as a splitting tree, so that they arise where persons lie.

``n`` draws of ``n`` persons are a multinomial count. The persons' numbers 0..n-1 are halved
again and again until ``LEAF`` persons or fewer are left; the draws of a replicate that fall into
the left half of a node are a binomial number, taken by inversion from a uniform
number that belongs to (seed, replicate, node). In a leaf each draw picks a person. A task walks
only down to the leaves whose persons it holds, all replicates at once; counts of a
replicate add up to ``n`` over all tasks without any of them seeing the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from emulant.functions.counter import uniform

LEAF = 256
REACH = 9.0  # standard deviations about the mean; what lies beyond has probability below 1e-18
GROUP = 6
KEPT = 4096  # so many distributions, of so many draws at most, are kept for the next node

_LOG_FACTORIAL = np.array([math.lgamma(k + 1) for k in range(1 << 13)])


def log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k! by table, and by Stirling's series beyond it."""
    if not len(k) or k.max() < len(_LOG_FACTORIAL):
        return _LOG_FACTORIAL[k]
    x = np.maximum(k, 64).astype(np.float64)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(k < 64, _LOG_FACTORIAL[np.minimum(k, 63)], series)


def _distribution(m: int, left: int, size: int) -> tuple[int, np.ndarray]:
    """(first number, distribution function from there on) of the binomial numbers of (m, left / size)."""
    p = left / size
    spread = REACH * math.sqrt(m * p * (1 - p)) + 2 * REACH
    k = np.arange(max(0, math.floor(m * p - spread)), min(m, math.ceil(m * p + spread)) + 1)
    log_p = log_factorial(np.array([m])) - log_factorial(k) - log_factorial(m - k) + k * math.log(p) + (m - k) * math.log1p(-p)
    return int(k[0]), np.cumsum(np.exp(log_p))


def binomial(u: np.ndarray, m: np.ndarray, left: np.ndarray, size: np.ndarray, kept: dict) -> np.ndarray:
    """Inverse of the binomial distribution function of (m, left / size) at ``u``; rows of ``u`` and ``m`` are nodes.

    ``kept`` holds distributions for the next call.
    """
    halves, kind = np.unique(np.stack([left, size]), axis=1, return_inverse=True)
    u, m, kind, shape = u.ravel(), m.ravel(), np.repeat(kind, m.shape[1]), m.shape
    out = np.empty(len(u), np.int64)
    order = np.lexsort((m, kind))
    new = (np.diff(m[order]) != 0) | (np.diff(kind[order]) != 0)
    cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(m)]))
    for a, z in zip(cuts[:-1], cuts[1:]):
        at = order[a:z]
        draws, half = int(m[at[0]]), halves[:, kind[at[0]]]
        name = (draws, int(half[0]), int(half[1]))
        found = kept.get(name) or _distribution(*name)
        if draws <= KEPT and len(kept) < KEPT:
            kept[name] = found
        first, reached = found
        out[at] = np.minimum(first + np.searchsorted(reached, u[at]), draws)
    return out.reshape(shape)


def depth(n: int, leaf: int = LEAF) -> int:
    """Halvings until a node holds ``leaf`` persons or fewer."""
    levels = 0
    while n > leaf << levels:
        levels += 1
    return levels


class Tree:
    """Counts of replicates first..last-1 over the persons of one leaf after the other.

    The path to a group of ``GROUP`` levels is walked node by node and kept; below it all
    nodes of a level are split at once. Memory is a path and a group of counts, whatever ``n``.
    """

    def __init__(self, n: int, first: int, last: int, seed: int, leaf: int = LEAF):
        self.n, self.seed, self.levels = n, seed, depth(n, leaf)
        self.top = max(self.levels - GROUP, 0)
        self.rep = np.arange(first, last)
        self.path = [(0, np.full((1, last - first), n, np.int64))]  # nodes (number, counts) from the root down
        self.group: tuple[int, np.ndarray] = (-1, None)
        self.kept: dict = {}

    def start(self, level: int, node):
        """First person of a node; node k of a level is the k-th of 2**level."""
        return self.n * node >> level

    def leaf_of(self, idx):
        """Leaf of a person's number."""
        return (((idx + 1) << self.levels) - 1) // self.n

    def _halved(self, level: int, nodes: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Counts of both children of each node, in order."""
        low, mid, high = self.start(level, nodes), self.start(level + 1, 2 * nodes + 1), self.start(level, nodes + 1)
        u = uniform(self.seed, self.rep, ((1 << level) + nodes)[:, None], 0)
        left = binomial(u, m, mid - low, high - low, self.kept)
        return np.stack([left, m - left], axis=1).reshape(-1, m.shape[1])

    def counts(self, leaf: int) -> np.ndarray:
        """Number of draws that fall into a leaf, by replicate. Leaves are best asked for in order."""
        below = self.levels - self.top
        group = leaf >> below
        if group != self.group[0]:
            while len(self.path) > 1 and group >> (self.top - len(self.path) + 1) != self.path[-1][0]:
                self.path.pop()
            while len(self.path) <= self.top:
                level = len(self.path) - 1
                node, m = self.path[-1]
                child = group >> (self.top - level - 1)
                self.path.append((child, self._halved(level, np.array([node]), m)[child & 1][None, :]))
            nodes, m = np.array([group]), self.path[-1][1]
            for level in range(self.top, self.levels):
                m = self._halved(level, nodes, m)
                nodes = (2 * nodes[:, None] + np.arange(2)).ravel()
            self.group = (group, m)
        return self.group[1][leaf & ((1 << below) - 1)]

    def draws(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """(person, replicate) of every draw that falls into a leaf."""
        m = self.counts(leaf)
        low, high = self.start(self.levels, leaf), self.start(self.levels, leaf + 1)
        rep = np.repeat(self.rep, m)
        draw = np.arange(len(rep)) - np.repeat(np.cumsum(m) - m, m)
        u = uniform(self.seed, rep, (1 << self.levels) + leaf, 1 + draw)
        return low + np.minimum((u * (high - low)).astype(np.int64), high - low - 1), rep


def drawn(idx: np.ndarray, tree: Tree) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For sorted person numbers, pieces (begin, end, place in the piece, replicate) of one leaf each."""
    if not len(idx):
        return
    leaf = tree.leaf_of(idx)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(leaf)) + 1, [len(idx)]))
    for a, z in zip(cuts[:-1], cuts[1:]):
        person, rep = tree.draws(int(leaf[a]))
        place = np.searchsorted(idx[a:z], person)
        place[place == z - a] = 0
        here = idx[a:z][place] == person
        yield int(a), int(z), place[here], rep[here]
