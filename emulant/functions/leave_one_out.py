"""Leave-one-person-out fits from sums over all persons, without a pass for each person.

A fit without a person solves "score of all minus score of the person = 0". The person's
own part is exact. The part of all persons is needed only close to the full fit, where it is a
polynomial in the change of the coefficients, whose tensors are sums over persons: one pass
adds them up, then each person's fits are small systems solved where the person lies. Work
grows with the number of persons, not with its square.

Weights are part of the expansion: a change of the weight models' coefficients changes the weight
of every row, by the gradient and Hessian of its logarithm.

Each system is solved to one order after the other. What higher orders would change is judged by the
ratio of the last two changes; a person for whom this, or the person's share of the
information, is too large is marked, and is left to exact passes over all persons.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from emulant.functions.persons import Layout, People, _model_rows, _sigmoid

NEAR = 2e-9  # by so much the orders left out may change a coefficient, as estimated; a few times that in fact
SHARE = 0.5  # largest share of the information in any direction that one person may have
STEPS = 12


def _pairs(x: np.ndarray) -> np.ndarray:
    """Products of two columns, each pair once."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j]


def _square(d: np.ndarray) -> np.ndarray:
    """Products of two entries of each row, pairs that stand for two of them doubled: contracts ``_pairs``."""
    i, j = np.triu_indices(d.shape[1])
    return d[:, i] * d[:, j] * np.where(i == j, 1.0, 2.0)


def _full(pairs: np.ndarray, p: int) -> np.ndarray:
    """Rows of pairs as symmetric matrices."""
    out = np.zeros((len(pairs), p, p))
    i, j = np.triu_indices(p)
    out[:, i, j] = pairs
    out[:, j, i] = pairs
    return out


def _by_person(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, values.shape[1]))
    np.add.at(out, owner, values)
    return out


@dataclass(frozen=True)
class Fits:
    """The full fits: a layout, the kept terms and coefficients of every weight model, and of the outcome model."""

    lay: Layout
    models: tuple[np.ndarray, ...]  # coefficients, 0 where aliased
    model_terms: tuple[np.ndarray, ...]  # numbers of the kept terms
    outcome: np.ndarray
    outcome_terms: np.ndarray

    @cached_property
    def sizes(self) -> list[int]:
        return [len(t) for t in self.model_terms]

    @cached_property
    def shapes(self) -> list[tuple[int, ...]]:
        """Shapes of all sums, in order."""
        out: list[tuple[int, ...]] = []
        for p in self.sizes:
            pp = p * (p + 1) // 2
            out += [(p,), (pp,), (p, pp), (pp, pp)]
        p, q, k = len(self.outcome_terms), sum(self.sizes), self.lay.visits
        pp, qq = p * (p + 1) // 2, q * (q + 1) // 2
        out += [(p,), (pp,), (p, q), (p, qq), (pp, q), (p, pp), (pp, qq), (p * q, pp), (pp, pp)]
        return [*out, (2 * k, 1), (2 * k, p), (2 * k, pp), (2 * k, 1)]

    @cached_property
    def length(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes)

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes:
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out


def _likelihood(y: np.ndarray, eta: np.ndarray) -> np.ndarray:
    return y * eta - np.logaddexp(0.0, eta)


def _weight_rows(p: People, fits: Fits):
    """For each weight model with its sign, the visits where it bears on the weight, its terms there, and the response."""
    lay, v = fits.lay, p.visit
    prev, taken = v[lay.prev_treatment], v[lay.treatment]
    counted = np.ones(len(taken), bool)
    for stratum, flag in lay.eligible_wts:
        counted &= ~((prev == stratum) & (v[flag] == 0))
    for m, (name, design, response, stratum) in enumerate(lay.models):
        x = design.matrix(v, len(taken))[:, fits.model_terms[m]]
        use = np.isfinite(x).all(axis=1)
        if stratum is not None:
            use &= prev == stratum
        if response == "treatment":
            use &= counted & np.isin(taken, (0.0, 1.0))
            y = taken
        else:
            y = np.ones(len(taken))  # what is weighted is staying
        at = np.flatnonzero(use)
        yield m, 1.0 if name.split("_")[1].startswith("n") else -1.0, at, x[at], y[at]


def _missing(p: People, fits: Fits) -> np.ndarray:
    """Visits without a weight, as in the replicates' weights."""
    lay, v = fits.lay, p.visit
    gone = np.zeros(len(p.visit_person), bool)
    if not any(name.startswith("switch") for name, _, _, _ in lay.models):
        return gone
    prev = v[lay.prev_treatment]
    seen = np.zeros((2, len(gone)), bool)
    counted = np.ones(len(gone), bool)
    for stratum, flag in lay.eligible_wts:
        counted &= ~((prev == stratum) & (v[flag] == 0))
    for name, design, response, stratum in lay.models:
        if response == "treatment":
            fine = np.isfinite(design.matrix(v, len(gone))).all(axis=1) & (prev == stratum) & np.isin(v[lay.treatment], (0.0, 1.0))
            seen[int(name.split("_")[1].startswith("n"))] |= fine
    return counted & ~seen.all(axis=0)


def _along_trials(p: People, lay: Layout, per_visit: np.ndarray) -> np.ndarray:
    """Sums of a quantity of visits from after the start of a trial up to each trial row."""
    grid = np.zeros((p.size, lay.visits, per_visit.shape[1]))
    grid[p.visit_person, p.visit[lay.period].astype(np.int64)] = per_visit
    grid = np.cumsum(grid, axis=1)
    start = p.row["trial_period"].astype(np.int64)
    return grid[p.row_person, start + p.row["followup_time"].astype(np.int64)] - grid[p.row_person, start]


def _log_weights(p: People, fits: Fits, change: Sequence[np.ndarray] | None) -> np.ndarray:
    """Logarithm of the weight of every trial row, NaN where missing; ``change`` moves each person's coefficients."""
    out = np.zeros((len(p.visit_person), 1))
    for m, sign, at, x, y in _weight_rows(p, fits):
        b = fits.models[m][fits.model_terms[m]]
        eta = x @ b if change is None else (x * (b + change[m][p.visit_person[at]])).sum(axis=1)
        out[at, 0] += sign * _likelihood(y, eta)
    out[_missing(p, fits)] = np.nan
    return _along_trials(p, fits.lay, out)[:, 0]


def _outcome_design(p: People, fits: Fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = fits.lay.outcome.matrix(p.row, len(p.row_person))[:, fits.outcome_terms]
    y = p.row["outcome"]
    return x, y, np.isfinite(y) & np.isfinite(x).all(axis=1)


def sums(p: People, fits: Fits) -> np.ndarray:
    """The tensors of a batch of persons, one after the other."""
    parts: list[np.ndarray] = []
    lay = fits.lay
    for (name, design, response, stratum), b, terms in zip(lay.models, fits.models, fits.model_terms):
        _, x, y = _model_rows(p, lay, design, response, stratum)
        prob = _sigmoid(x @ b)
        v = prob * (1 - prob)
        x = x[:, terms]
        xx = _pairs(x)
        parts += [(y - prob) @ x, v @ xx, (x * (v * (1 - 2 * prob))[:, None]).T @ xx, (xx * (v * (1 - 6 * v))[:, None]).T @ xx]
    q = sum(fits.sizes)
    grad, hess = np.zeros((len(p.visit_person), q)), np.zeros((len(p.visit_person), q, q))
    first = np.concatenate(([0], np.cumsum(fits.sizes))).astype(int)
    for m, sign, at, x, y in _weight_rows(p, fits):
        prob = _sigmoid(x @ fits.models[m][fits.model_terms[m]])
        a, z = first[m], first[m + 1]
        grad[at, a:z] += sign * (y - prob)[:, None] * x
        hess[at, a:z, a:z] -= sign * (prob * (1 - prob))[:, None, None] * x[:, :, None] * x[:, None, :]
    i, j = np.triu_indices(q)
    along = _along_trials(p, lay, np.concatenate([grad, hess[:, i, j]], axis=1))
    x, y, use = _outcome_design(p, fits)
    logw = _log_weights(p, fits, None)
    use &= np.isfinite(logw)
    x, y, w, g = x[use], y[use], np.exp(logw[use]), along[use, :q]
    gg = _pairs(g) + along[use, q:]
    prob = _sigmoid(x @ fits.outcome[fits.outcome_terms])
    v = prob * (1 - prob)
    xx, e = _pairs(x), w * (y - prob)
    v1, v2 = w * v * (1 - 2 * prob), w * v * (1 - 6 * v)
    wv = (w * v)[:, None]
    xg = (x[:, :, None] * g[:, None, :]).reshape(len(x), -1)
    parts += [
        e @ x,
        (w * v) @ xx,
        (x * e[:, None]).T @ g,
        (x * e[:, None]).T @ gg,
        (xx * wv).T @ g,
        (x * v1[:, None]).T @ xx,
        (xx * wv).T @ gg,
        (xg * v1[:, None]).T @ xx,
        (xx * v2[:, None]).T @ xx,
    ]
    parts += _survival_sums(p, fits)
    return np.concatenate([a.ravel() for a in parts])[None, :]


def _baseline(p: People, lay: Layout) -> np.ndarray:
    base = p.row["followup_time"] == 0
    if lay.trials is not None:
        base &= np.isin(p.row["trial_period"], lay.trials)
    return np.flatnonzero(base)


def _survival(p: People, fits: Fits, at: np.ndarray, beta: np.ndarray):
    """For both arms and every visit: survival of the baseline rows, and the hazards' terms; ``beta`` has a row for each."""
    lay = fits.lay
    data = {c: a[at] for c, a in p.row.items()}
    for treated in (1.0, 0.0):
        alive = np.ones(len(at))
        for j in range(lay.visits):
            data["assigned_treatment"] = np.full(len(at), treated)
            data["followup_time"] = np.full(len(at), float(j))
            x = lay.outcome.matrix(data, len(at))[:, fits.outcome_terms]
            hazard = _sigmoid((x * beta).sum(axis=1))
            alive = alive * (1.0 - hazard)
            yield j, alive, hazard, x


def _survival_sums(p: People, fits: Fits) -> list[np.ndarray]:
    """Sums of survival, of its gradient and Hessian, and rows, by arm and visit."""
    at, k = _baseline(p, fits.lay), fits.lay.visits
    n = len(fits.outcome_terms)
    beta = np.broadcast_to(fits.outcome[fits.outcome_terms], (len(at), n))
    horizon = k - p.row["trial_period"][at]
    value, slope, bend, rows = np.zeros((2 * k, 1)), np.zeros((2 * k, n)), np.zeros((2 * k, n * (n + 1) // 2)), np.zeros((2 * k, 1))
    for arm_visit, (j, alive, hazard, x) in enumerate(_survival(p, fits, at, beta)):
        if j == 0:
            g, h = np.zeros((len(at), n)), np.zeros((len(at), n * (n + 1) // 2))
        g = g - hazard[:, None] * x
        h = h - (hazard * (1 - hazard))[:, None] * _pairs(x)
        s = np.where(horizon > j, alive, 0.0)
        value[arm_visit], slope[arm_visit], bend[arm_visit] = s.sum(), s @ g, s @ (_pairs(g) + h)
        rows[arm_visit] = (horizon > j).sum()
    return [value, slope, bend, rows]


class Solver:
    """Fits without each person of a batch, from the sums over all persons."""

    def __init__(self, fits: Fits, flat: np.ndarray):
        self.fits = fits
        parts = fits.split(flat)
        self.models = [parts[4 * m : 4 * m + 4] for m in range(len(fits.sizes))]
        self.outcome = parts[4 * len(fits.sizes) : -4]
        self.curve = parts[-4:]

    def _solve(self, score, info, own, size: int, p: int, orders: Sequence[int]):
        """Changes (persons x terms) at the highest order, and which persons they hold for.

        ``score(d, order)`` and ``info(d, order)`` belong to all persons, ``own(d)`` gives both for the person alone.
        """
        found: list[np.ndarray] = []
        good = np.ones(size, bool)
        d = np.zeros((size, p))
        for order in orders:
            for _ in range(STEPS):
                own_score, own_info = own(d)
                rest = info(d, order) - own_info
                with np.errstate(all="ignore"):
                    step = _solved(rest, score(d, order) - own_score)
                good &= np.isfinite(step).all(axis=1)
                d = d + np.where(good[:, None], step, 0.0)
                if np.abs(step[good]).max(initial=0.0) < 1e-13:
                    break
            found.append(d)
        last, before = (np.abs(found[-k] - found[-k - 1]).max(axis=1, initial=0.0) for k in (1, 2))
        return d, good & _falls(before, last) & np.isfinite(d).all(axis=1)

    def solve(self, p: People):
        """(coefficients of the weight models, of the outcome model, survival, persons they hold for) without each person.

        For other persons the coefficients are starts for exact fits.
        """
        fits, size = self.fits, p.size
        good = np.ones(size, bool)
        change = []
        for m, (name, design, response, stratum) in enumerate(fits.lay.models):
            d, fine = self._model(p, m, design, response, stratum)
            change.append(d)
            good &= fine
        d, fine = self._outcome(p, change)
        theta = [np.zeros((size, 0))]
        for b, terms, moved in [*zip(fits.models, fits.model_terms, change), (fits.outcome, fits.outcome_terms, d)]:
            theta.append(np.tile(b, (size, 1)))
            theta[-1][:, terms] += moved
        means, near = self._means(p, d)
        return np.concatenate(theta[:-1], axis=1), theta[-1], means, good & fine & near

    def _model(self, p: People, m: int, design, response: str, stratum):
        fits = self.fits
        s0, t2, t3, t4 = self.models[m]
        terms, b = fits.model_terms[m], fits.models[m][fits.model_terms[m]]
        n = len(terms)
        at, x, y = _model_rows(p, fits.lay, design, response, stratum)
        owner, x = p.visit_person[at], x[:, terms]
        xx, full = _pairs(x), _full(t2[None, :], n)[0]

        def own(d):
            prob = _sigmoid((x * (b + d[owner])).sum(axis=1))
            s = _by_person((y - prob)[:, None] * x, owner, p.size)
            return s, _full(_by_person((prob * (1 - prob))[:, None] * xx, owner, p.size), n)

        def score(d, order):
            out = s0 - d @ full
            if order > 2:
                out = out - 0.5 * _square(d) @ t3.T
            if order > 3:
                out = out - np.einsum("ij,ijk->ik", d, _full(_square(d) @ t4, n)) / 6
            return out

        def info(d, order):
            out = np.broadcast_to(full, (p.size, n, n))
            if order > 2:
                out = out + _full(d @ t3, n)
            if order > 3:
                out = out + 0.5 * _full(_square(d) @ t4, n)
            return out

        d, good = self._solve(score, info, own, p.size, n, (2, 3, 4))
        return d, good & _light(full, own(np.zeros((p.size, n)))[1])

    def _outcome(self, p: People, change: Sequence[np.ndarray]):
        fits = self.fits
        u0, a, bg, c1, c2, c3, d1, d2, d3 = self.outcome
        n, q = len(fits.outcome_terms), sum(fits.sizes)
        theta = np.concatenate(change, axis=1) if change else np.zeros((p.size, 0))
        x, y, use = _outcome_design(p, fits)
        logw = _log_weights(p, fits, change)
        use &= np.isfinite(logw)
        x, y, w, owner = x[use], y[use], np.exp(logw[use]), p.row_person[use]
        xx, b, full = _pairs(x), fits.outcome[fits.outcome_terms], _full(a[None, :], n)[0]
        theta2 = _square(theta)
        # What the weights' change does to the score and to the information.
        shift = u0 + theta @ bg.T + 0.5 * theta2 @ c1.T
        tilt2, tilt3 = _full(theta @ c2.T, n), _full(0.5 * theta2 @ d1.T, n)
        bend3 = np.einsum("it,ptk->ipk", theta, d2.reshape(n, q, n * (n + 1) // 2))

        def own(d):
            prob = _sigmoid((x * (b + d[owner])).sum(axis=1))
            s = _by_person((w * (y - prob))[:, None] * x, owner, p.size)
            return s, _full(_by_person((w * prob * (1 - prob))[:, None] * xx, owner, p.size), n)

        def score(d, order):
            out = shift - d @ full - np.einsum("ij,ijk->ik", d, tilt2) - 0.5 * _square(d) @ c3.T if order > 1 else u0 + theta @ bg.T - d @ full
            if order > 2:
                out = out - np.einsum("ij,ijk->ik", d, tilt3) - 0.5 * np.einsum("ik,ipk->ip", _square(d), bend3)
                out = out - np.einsum("ij,ijk->ik", d, _full(_square(d) @ d3, n)) / 6
            return out

        def info(d, order):
            out = full + tilt2 + _full(d @ c3, n) if order > 1 else np.broadcast_to(full, (p.size, n, n))
            if order > 2:
                out = out + tilt3 + 0.5 * _full(_square(d) @ d3, n)
            return out

        d, good = self._solve(score, info, own, p.size, n, (1, 2, 3))
        # The third order in the weights' coefficients alone is left out; the first two tell how large it is.
        inverse = np.linalg.pinv(full)
        good &= _falls(np.abs(theta @ bg.T @ inverse).max(axis=1, initial=0.0), np.abs(0.5 * theta2 @ c1.T @ inverse).max(axis=1, initial=0.0))
        return d, good & _light(full, own(np.zeros((p.size, n)))[1])

    def _means(self, p: People, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of survival over the others at each person's coefficients, rows of all and of the others; and for whom they hold."""
        fits, k = self.fits, self.fits.lay.visits
        value, slope, bend, rows = self.curve
        first, second = d @ slope.T, 0.5 * _square(d) @ bend.T
        total = value[:, 0] + first + second
        with np.errstate(all="ignore"):
            near = _falls(*(np.nan_to_num(np.abs(x) / rows[:, 0]).max(axis=1) for x in (first, second)))
        at = _baseline(p, fits.lay)
        owner = p.row_person[at]
        horizon = k - p.row["trial_period"][at]
        own, own_rows = np.zeros((p.size, 2 * k)), np.zeros((p.size, 2 * k))
        beta = fits.outcome[fits.outcome_terms] + d[owner]
        for column, (j, alive, _, _) in enumerate(_survival(p, fits, at, beta)):
            own[:, column] = np.bincount(owner, np.where(horizon > j, alive, 0.0), p.size)
            own_rows[:, column] = np.bincount(owner, horizon > j, p.size)
        return np.stack([total - own, np.broadcast_to(rows[:, 0], own.shape), rows[:, 0] - own_rows], axis=2), near


def _falls(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether what follows two terms of a series, by their ratio, is next to nothing."""
    with np.errstate(all="ignore"):
        return np.where(last > 0, last * np.minimum(last / before, 1.0), 0.0) <= NEAR


def _solved(matrices: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of many systems; NaN for singular ones."""
    try:
        return np.linalg.solve(matrices, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        out = np.full(right.shape, np.nan)
        for i, (m, r) in enumerate(zip(matrices, right)):
            try:
                out[i] = np.linalg.solve(m, r)
            except np.linalg.LinAlgError:
                pass
        return out


def _light(full: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether a person has less than ``SHARE`` of the information in every direction (bounded by the trace)."""
    if not len(full):
        return np.ones(len(own), bool)
    share = np.einsum("jk,ikj->i", np.linalg.pinv(full), own)
    return np.isfinite(share) & (share < SHARE)
