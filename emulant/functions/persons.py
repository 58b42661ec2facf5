"""Batches of persons as numpy arrays, and what replicates need from them.

A person row holds the person's visits and trial rows as short lists (their length
is bounded by the number of visits) and, for a bootstrap block, the replicates that
drew the person. Every sum a replicate needs is a sum over persons, so one pass over
person rows serves all replicates of a block at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from emulant.functions import kernel
from emulant.functions.design import Design

CELLS = 1 << 21  # persons x visits x replicates held at once


@dataclass(frozen=True)
class Layout:
    """What a pass has to know about the person rows."""

    visits: int
    replicates: int
    first: int
    counts: str  # "drawn": listed draws, "left_out": all but one of the persons ``left_out``, "ones"
    treatment: str
    prev_treatment: str
    period: str
    censor: str | None
    models: tuple[tuple[str, Design, str, int | None], ...]
    eligible_wts: tuple[tuple[int, str], ...]
    outcome: Design
    trials: tuple[int, ...] | None
    left_out: tuple[int, ...] = ()  # persons' numbers in ascending order, one for each replicate


@dataclass
class People:
    """A slice of persons: counts, visits and trial rows."""

    size: int
    n: np.ndarray  # persons x replicates
    visit_person: np.ndarray
    visit: dict[str, np.ndarray]
    row_person: np.ndarray
    row: dict[str, np.ndarray]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    values = column.flatten()
    fields = {
        f.name: values.field(i).to_numpy(zero_copy_only=False).astype(np.float64)
        for i, f in enumerate(values.type)
    }
    return owner, fields


def _counts(column: pa.ListArray, m: int, lay: Layout) -> np.ndarray:
    """Persons x replicates counts from the lists of replicates that drew a person."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(m), lengths)
    rep = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - lay.first
    cells = np.bincount(owner * lay.replicates + rep, minlength=m * lay.replicates)
    return cells.reshape(m, lay.replicates).astype(np.float64)


def people(batches: Iterator[pa.RecordBatch], lay: Layout, most: int = CELLS) -> Iterator[People]:
    """Cut batches into slices of ``most`` persons at most, that keep persons x visits x replicates bounded."""
    step = min(max(8, CELLS // (lay.visits * lay.replicates)), most)
    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            m = batch.num_rows
            if lay.counts == "drawn":
                n = _counts(batch.column("drawn"), m, lay)
            else:
                n = np.ones((m, lay.replicates))
                if lay.counts == "left_out":
                    left_out, idx = np.asarray(lay.left_out), batch.column("idx").to_numpy()
                    at = np.minimum(np.searchsorted(left_out, idx), len(left_out) - 1)
                    hit = np.flatnonzero(left_out[at] == idx)
                    n[hit, at[hit]] = 0.0
            visit_person, visit = _lists(batch.column("visits"))
            row_person, row = _lists(batch.column("rows"))
            yield People(m, n, visit_person, visit, row_person, row)


def _sigmoid(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -700.0, 700.0)))


def _model_rows(p: People, lay: Layout, design: Design, response: str, stratum: int | None):
    y = p.visit[lay.treatment] if response == "treatment" else 1.0 - p.visit[lay.censor]
    use = np.isfinite(y)
    if stratum is not None:
        use &= p.visit[lay.prev_treatment] == stratum
    x = design.matrix(p.visit, len(y))
    use &= np.isfinite(x).all(axis=1)
    at = np.flatnonzero(use)
    return at, x[at], y[at]


def weight_model_sums(p: People, lay: Layout, jobs: Sequence[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Sums of the weight models for (model number, active replicates, coefficients)."""
    out = []
    for i, active, b in jobs:
        _, design, response, stratum = lay.models[i]
        at, x, y = _model_rows(p, lay, design, response, stratum)
        n = p.n if len(active) == lay.replicates else p.n[:, active]
        out.append(kernel.logistic_sums(x, y, n[p.visit_person[at]], b))
    return out


def weight_model_scores(p: People, lay: Layout, full: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Scores of the weight models at the full-data coefficients, per replicate."""
    out = []
    for (_, design, response, stratum), b in zip(lay.models, full):
        at, x, y = _model_rows(p, lay, design, response, stratum)
        e = y - _sigmoid(x @ b)
        out.append((p.n[p.visit_person[at]] * e[:, None]).T @ x)
    return out


def replicate_weights(p: People, lay: Layout, coefs: Mapping[str, np.ndarray]) -> np.ndarray:
    """Trial-row weights (rows x replicates); NaN where a probability is missing."""
    v = p.visit
    nv = len(p.visit_person)
    r = lay.replicates
    designs = {name: design for name, design, _, _ in lay.models}
    prev = v[lay.prev_treatment][:, None]
    taken = v[lay.treatment][:, None]

    def linear(name: str) -> np.ndarray:
        design = designs[name]
        rows = nv if design.columns else 1  # an intercept is the same for every row
        return design.matrix(v, rows) @ coefs[name]

    def by_stratum(kind: str) -> np.ndarray:
        eta = np.where(prev == 1, linear(f"{kind}1"), linear(f"{kind}0"))
        return _sigmoid(np.where((prev == 0) | (prev == 1), eta, np.nan))

    if "switch_d0" in designs:
        pn, pd = by_stratum("switch_n"), by_stratum("switch_d")
        wt = np.where(taken == 1, pn / pd, (1.0 - pn) / (1.0 - pd))
        wt[~np.isin(v[lay.treatment], (0.0, 1.0))] = np.nan
        for stratum, flag in lay.eligible_wts:
            wt = np.where((prev == stratum) & (v[flag][:, None] == 0), 1.0, wt)
    else:
        wt = np.ones((nv, r))
    if "censor_d" in designs:
        cn, cd = _sigmoid(linear("censor_n")), _sigmoid(linear("censor_d"))
    elif "censor_d0" in designs:
        cn, cd = by_stratum("censor_n"), by_stratum("censor_d")
    else:
        cn = cd = None
    if cn is not None:
        wt = wt * (np.nan_to_num(cn, nan=1.0) / np.nan_to_num(cd, nan=1.0))
    t = v[lay.period].astype(np.int64)
    missing = np.isnan(wt)
    cum = np.ones((p.size, lay.visits, r))
    cum[p.visit_person, t] = np.where(missing, 1.0, wt)
    cum = np.cumprod(cum, axis=1)
    if missing.any():
        gone = np.zeros((p.size, lay.visits, r), dtype=bool)
        gone[p.visit_person, t] = missing
        cum = np.where(gone, np.nan, cum)
    start = p.row["trial_period"].astype(np.int64)
    now = start + p.row["followup_time"].astype(np.int64)
    return cum[p.row_person, now] / cum[p.row_person, start]


def _outcome_rows(p: People, lay: Layout, coefs: Mapping[str, np.ndarray]):
    w = replicate_weights(p, lay, coefs)
    n = p.n[p.row_person]
    w = np.where(n > 0, w * n, 0.0)
    x = lay.outcome.matrix(p.row, len(w))
    y = p.row["outcome"]
    use = np.isfinite(y) & np.isfinite(x).all(axis=1)
    return x[use], y[use], np.nan_to_num(w[use], nan=0.0)


def outcome_sums(p: People, lay: Layout, coefs: Mapping[str, np.ndarray], active: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y, w = _outcome_rows(p, lay, coefs)
    return kernel.logistic_sums(x, y, w if len(active) == lay.replicates else w[:, active], b)


def outcome_scores(p: People, lay: Layout, coefs: Mapping[str, np.ndarray], full: np.ndarray) -> np.ndarray:
    """Outcome scores at the full-data coefficients under each replicate's weights."""
    x, y, w = _outcome_rows(p, lay, coefs)
    return (w * (y - _sigmoid(x @ full))[:, None]).T @ x


def curve_sums(p: People, lay: Layout, b: np.ndarray) -> np.ndarray:
    """Per replicate: survival sums per visit for both arms, rows and draws per visit."""
    k = lay.visits
    base = p.row["followup_time"] == 0
    if lay.trials is not None:
        base &= np.isin(p.row["trial_period"], lay.trials)
    at = np.flatnonzero(base)
    n = p.n[p.row_person[at]]
    data = {c: a[at] for c, a in p.row.items()}
    horizon = k - data["trial_period"]
    out = np.zeros((lay.replicates, 4 * k))
    for arm, treated in enumerate((1.0, 0.0)):
        alive = np.ones((len(at), lay.replicates))
        for j in range(k):
            data["assigned_treatment"] = np.full(len(at), treated)
            data["followup_time"] = np.full(len(at), float(j))
            alive = alive * (1.0 - _sigmoid(lay.outcome.matrix(data, len(at)) @ b))
            inside = horizon > j
            out[:, arm * k + j] = (alive[inside] * n[inside]).sum(axis=0)
            if arm == 0:
                out[:, 2 * k + j] = inside.sum()
                out[:, 3 * k + j] = n[inside].sum(axis=0)
    return out
