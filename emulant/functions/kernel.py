"""Weighted logistic sums in numpy, and the Newton steps that use them.

Spark partitions the rows and adds the partial sums; what happens here is the
arithmetic of one batch and the small p x p algebra on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from emulant.functions import counter

ROWS_PER_CHUNK = 2048
TAIL = 4  # deviance, sum of weights, weighted responses, rows used


def width(p: int) -> int:
    """Length of the flat sums of a model with ``p`` terms."""
    return p * (p + 1) // 2 + p + TAIL


def logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums for each column of ``b`` (p x R), one flat row per column.

    ``w`` is m x R, or m x 1 shared by every column. A row holds the upper triangle
    of the information matrix, the score and the tail entries.
    """
    m, p = x.shape
    r = b.shape[1]
    if p == 1 and (x == 1.0).all():
        return _intercept_sums(y, w, b)
    tri = p * (p + 1) // 2
    rows, cols = np.triu_indices(p)
    out = np.zeros((r, width(p)))
    for lo in range(0, m, ROWS_PER_CHUNK):
        xs = x[lo : lo + ROWS_PER_CHUNK]
        ys = y[lo : lo + ROWS_PER_CHUNK, None]
        ws = w[lo : lo + ROWS_PER_CHUNK]
        eta = xs @ b
        prob = 1.0 / (1.0 + np.exp(-np.clip(eta, -700.0, 700.0)))
        out[:, :tri] += (ws * prob * (1.0 - prob)).T @ (xs[:, rows] * xs[:, cols])
        out[:, tri : tri + p] += (ws * (ys - prob)).T @ xs
        hit = np.where(ys == 1.0, prob, 1.0 - prob)
        out[:, tri + p] -= 2.0 * (ws * np.log(np.maximum(hit, 1e-300))).sum(axis=0)
        out[:, tri + p + 1] += ws.sum(axis=0)
        out[:, tri + p + 2] += (ws * ys).sum(axis=0)
        out[:, tri + p + 3] += (ws > 0).sum(axis=0)
    return out


def _intercept_sums(y: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``logistic_sums`` of an intercept alone: only the weighted counts matter."""
    prob = 1.0 / (1.0 + np.exp(-np.clip(b[0], -700.0, 700.0)))
    total, events = w.sum(axis=0), y @ w
    tail = np.log(np.maximum(prob, 1e-300)), np.log(np.maximum(1.0 - prob, 1e-300))
    out = np.zeros((b.shape[1], width(1)))
    out[:, 0] = total * prob * (1.0 - prob)
    out[:, 1] = events - total * prob
    out[:, 2] = -2.0 * (events * tail[0] + (total - events) * tail[1])
    out[:, 3], out[:, 4], out[:, 5] = total, events, (w > 0).sum(axis=0)
    return out


def unpack(flat: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Information matrix, score and tail of one flat row."""
    tri = p * (p + 1) // 2
    gram = np.zeros((p, p))
    gram[np.triu_indices(p)] = flat[:tri]
    gram = gram + np.triu(gram, 1).T
    return gram, flat[tri : tri + p], flat[tri + p :]


def independent_terms(gram: np.ndarray, tol: float = 1e-9, scale: np.ndarray | None = None) -> np.ndarray:
    """Terms that are no linear combination of the ones before them.

    A factor that reveals the rank in the given order: a term is kept if what the terms before
    leave of it is more than ``tol``, in units of ``scale`` (by default the term's own).
    """
    p = len(gram)
    own = np.sqrt(np.maximum(np.diag(gram), 0.0))
    scale = own if scale is None else scale
    keep = np.zeros(p, dtype=bool)
    top = own.max(initial=0.0)
    safe = np.where(scale > 0, scale, 1.0)
    s = gram / np.outer(safe, safe)
    basis = np.zeros((p, p))
    for j in range(p):
        if scale[j] <= 1e-12 * top:
            continue
        rest = s[j].copy()
        rest -= basis.T @ basis[:, j]
        if rest[j] > tol:
            keep[j] = True
            basis[j] = rest / np.sqrt(rest[j])
    return keep


def inverse_on(gram: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Inverse over the kept terms, zero elsewhere."""
    out = np.zeros_like(gram)
    idx = np.flatnonzero(keep)
    if len(idx):
        out[np.ix_(idx, idx)] = np.linalg.inv(gram[np.ix_(idx, idx)])
    return out


def positive_definite(matrix: np.ndarray, tol: float = 1e-10) -> bool:
    """Whether every direction has variance, measured in units of the terms' own; rounding is none."""
    if not np.isfinite(matrix).all() or (np.diag(matrix) <= 0).any():
        return False
    scale = np.sqrt(np.diag(matrix))
    values = np.linalg.eigvalsh((matrix + matrix.T) / 2 / np.outer(scale, scale))
    return bool((values > tol).all())


def cholesky(cov: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Lower factor of a covariance that may be singular: a pivot of next to 0 gives a column of zeros."""
    p = len(cov)
    out = np.zeros((p, p))
    for j in range(p):
        rest = cov[j:, j] - out[j:] @ out[j]
        if rest[0] > tol * cov[j, j]:
            out[j:, j] = rest / np.sqrt(rest[0])
    return out


def normal_draws(mean: np.ndarray, cov: np.ndarray, size: int, seed: int) -> np.ndarray:
    """``size`` draws of a normal vector; ``cov`` may be singular.

    Draw ``d`` depends on seed, ``d`` and the covariance alone, so it can be had again in any engine.
    """
    return mean + counter.normal(seed, np.arange(size), len(mean)) @ cholesky(cov).T


def separated(first: np.ndarray, step: np.ndarray, coef: np.ndarray) -> bool:
    """Whether a fit that has settled still runs away along ``step``.

    Where an outcome is certain, a coefficient grows by about one unit of the linear predictor with every
    step while the deviance no longer falls; at a finite maximum the last step is next to nothing.
    ``first`` is the information at the start, which gives the size of the terms; one that had next to none
    there already is taken as it is.
    """
    size = np.sqrt(np.maximum(np.diag(first), 0.0) / max(float(np.diag(first).max(initial=0.0)), 1e-300))
    size = np.where(size < 1e-3, 1.0, size)
    far = (np.abs(step) > 0.02 * np.abs(coef)) & (np.abs(step) * size > 1e-4)
    return bool(far.any())


@dataclass
class Newton:
    """Newton iterations of ``r`` fits that share a design.

    The first information matrix shows which terms are aliased; where a start other
    than 0 makes any look so, the fit begins anew at 0 and is tested there. A fit stops when the
    deviance changes by less than ``tol`` (relative), so its information matrix belongs
    to the final coefficients. With ``last_step`` a fit already stops once the next
    step promises no larger change, and takes that step: one pass less where the
    matrix is not needed.

    Each fit counts its own passes, from where it began anew, and ends in one of the
    states of ``converged``, ``separated`` (converged in the deviance, with a coefficient that still
    grows) and ``finite``.
    """

    p: int
    r: int = 1
    tol: float = 1e-10
    max_iter: int = 30
    names: tuple[str, ...] = ()
    drop_order: tuple[str, ...] = ()
    start: np.ndarray | None = None
    last_step: bool = False
    coef: np.ndarray = field(init=False)
    keep: np.ndarray = field(init=False)
    done: np.ndarray = field(init=False)

    def __post_init__(self):
        self.coef = np.zeros((self.p, self.r))
        if self.start is not None:
            self.coef += self.start.reshape(self.p, -1)
        self.prev = self.coef.copy()
        self.keep = np.ones((self.p, self.r), dtype=bool)
        self.done = np.zeros(self.r, dtype=bool)
        self.converged = np.zeros(self.r, dtype=bool)
        self.separated = np.zeros(self.r, dtype=bool)
        self.spent = np.zeros(self.r, dtype=bool)
        self.finite = np.ones(self.r, dtype=bool)
        self.tested = np.zeros(self.r, dtype=bool)
        self.deviance = np.full(self.r, np.nan)
        self.gram = np.zeros((self.r, self.p, self.p))
        self.first = np.zeros((self.r, self.p, self.p))
        self.tail = np.zeros((self.r, TAIL))
        self.fit_passes = np.zeros(self.r, dtype=int)
        self.passes = 0

    @property
    def active(self) -> np.ndarray:
        return np.flatnonzero(~self.done)

    def update(self, sums: np.ndarray) -> None:
        """Take the sums of the active fits at their coefficients and step on."""
        self.passes += 1
        for row, r in zip(sums, self.active):
            self._update_one(r, row)
            if self.fit_passes[r] >= 2 * self.max_iter:
                self.done[r] = True

    def _begin_anew(self, r: int) -> None:
        self.coef[:, r] = self.prev[:, r] = 0.0
        self.fit_passes[r], self.tested[r], self.deviance[r] = 0, False, np.nan

    def _step(self, r: int, gram: np.ndarray, score: np.ndarray) -> np.ndarray | None:
        """Newton step over the kept terms; a term without information left, at a probability of 0 or 1, stays."""
        step = np.zeros(self.p)
        idx = np.flatnonzero(self.keep[:, r])
        live = independent_terms(gram[np.ix_(idx, idx)], 1e-12, np.sqrt(np.diag(self.first[r])[idx]))
        self.spent[r] = not live.all()
        idx = idx[live]
        try:
            step[idx] = np.linalg.solve(gram[np.ix_(idx, idx)], score[idx])
        except np.linalg.LinAlgError:
            return None
        return step if np.isfinite(step).all() else None

    def _settle(self, r: int, step: np.ndarray | None) -> None:
        self.done[r] = self.converged[r] = True
        self.separated[r] = step is None or self.spent[r] or separated(self.first[r], step, self.coef[:, r])

    def _update_one(self, r: int, row: np.ndarray) -> None:
        gram, score, tail = unpack(row, self.p)
        dev, old = tail[0], self.deviance[r]
        if not np.isfinite(row).all():
            self.done[r], self.finite[r] = True, False
            return
        self.fit_passes[r] += 1
        self.gram[r], self.tail[r] = gram, tail
        if not self.tested[r]:
            keep = independent_terms(gram)
            if not keep.all() and self.coef[:, r].any():
                # Where the start predicts next to 0 or 1, a term only looks aliased;
                # at 0 all rows weigh alike, so the test is made there.
                self._begin_anew(r)
                return
            self.keep[:, r], self.tested[r], self.first[r] = keep, True, gram
            if not keep.any():
                # No row has weight: there is nothing to fit.
                self.done[r] = self.converged[r] = True
                return
        elif not np.isfinite(old):
            pass
        elif abs(dev - old) <= self.tol * (abs(dev) + 0.1):
            self.deviance[r] = dev
            self._settle(r, self._step(r, gram, score))
            return
        elif dev > old + 1e-7 * (abs(old) + 0.1):
            if self.start is not None and self.fit_passes[r] == 2 and self.prev[:, r].any():
                self._begin_anew(r)  # the first step from a given start leads away
                return
            self.coef[:, r] = (self.coef[:, r] + self.prev[:, r]) / 2.0
            return
        self.deviance[r] = dev
        step = self._step(r, gram, score)
        if step is None or self.fit_passes[r] >= self.max_iter:
            self.done[r] = True
            return
        self.prev[:, r] = self.coef[:, r]
        self.coef[:, r] += step
        if self.last_step and abs(score @ step) <= self.tol * (abs(dev) + 0.1):
            self._settle(r, step)

    def dropped(self, r: int) -> list[str]:
        """Aliased terms that are removed: the run of ``drop_order`` found aliased."""
        out = []
        for name in self.drop_order:
            if name not in self.names:
                continue  # removed before
            if self.keep[self.names.index(name), r]:
                break
            out.append(name)
        return out
