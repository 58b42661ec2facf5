"""A full analysis: weights, outcome model, risk-difference curve, and replicates.

Replicates are a dimension of the data. A block of them shares every pass over the
person rows; the driver holds the coefficients of one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from itertools import islice
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.functions import kernel
from emulant.functions import leave_one_out as loo
from emulant.functions import persons as people
from emulant.functions.design import Design
from emulant.functions.sums import add_partitions, list_column, list_matrix
from emulant.operators import gcomp, regression, resample, trials, weights
from emulant.operators.weights import WeightDesigns
from emulant.session import keep, new_table_path, written
from emulant.spec import PanelSpec

#: What became of a replicate: a term of ``drop_order`` lost that the full fit kept, a coefficient
#: that grows without end, a fit that ran out of passes, a result that is no number.
STATUS = ("failed", "separated", "not_converged", "not_finite")
REPLICATE_SCHEMA = (
    f"method string, rep int, {', '.join(f'{c} int' for c in STATUS)}, followup_time int, survival_treatment double,"
    " survival_control double, survival_difference double, survival_ratio double, mrd double"
)
COEF_SCHEMA = "method string, rep int, term string, estimate double"
PERSONS_PER_TASK = 20_000
PERSONS_AT_ONCE = 512  # of which the tensors of one slice are made


@dataclass(frozen=True)
class Plan:
    """Everything that defines an analysis besides the data."""

    spec: PanelSpec
    weights: WeightDesigns
    outcome: Design
    covariates: tuple[str, ...] = ()
    estimand: str = "PP"
    drop_order: tuple[str, ...] = ()
    trials: tuple[int, ...] | None = (0,)
    eligible_wts: tuple[tuple[int, str], ...] = ()
    normalise: str = "rows"
    block: int = 256
    tol: float = 1e-10
    max_iter: int = 30
    storage: str = "memory"  # "memory" persists tables, "shared" writes them to the shared folder

    @property
    def weight_designs(self) -> WeightDesigns:
        """Designs in use: intention to treat follows switchers, so switching has no weight."""
        return replace(self.weights, switch_d=None) if self.estimand == "ITT" else self.weights


@dataclass
class Status:
    """What became of each replicate of a block."""

    failed: np.ndarray
    separated: np.ndarray
    not_converged: np.ndarray
    not_finite: np.ndarray

    @staticmethod
    def good(r: int) -> Status:
        return Status(*(np.zeros(r, dtype=bool) for _ in STATUS))

    @staticmethod
    def of(s: kernel.Newton) -> Status:
        lost = np.array([bool(s.dropped(k)) for k in range(s.r)], dtype=bool)
        nothing = ~s.keep.any(axis=0)
        return Status(lost, s.separated.copy(), ~s.converged & s.finite, ~s.finite | nothing)

    def __or__(self, other: Status) -> Status:
        return Status(*(getattr(self, c) | getattr(other, c) for c in STATUS))

    def row(self, r: int) -> tuple[int, ...]:
        return tuple(int(getattr(self, c)[r]) for c in STATUS)


@dataclass
class Replicates:
    """Curves (and coefficients) of the replicates of one or more methods."""

    curves: DataFrame
    coefficients: DataFrame
    moments: dict[str, Moments] = field(default_factory=dict)


@dataclass
class Moments:
    """Running first and second moments of replicate coefficients about a centre."""

    centre: np.ndarray
    count: int = 0
    failed: int = 0
    total: np.ndarray = None
    outer: np.ndarray = None

    def add(self, coefs: np.ndarray, failed: np.ndarray) -> None:
        d = coefs.T - self.centre
        self.count += len(d)
        self.failed += int(failed.sum())
        self.total = d.sum(axis=0) if self.total is None else self.total + d.sum(axis=0)
        self.outer = d.T @ d if self.outer is None else self.outer + d.T @ d

    def merge(self, other: Moments | None) -> None:
        if other is not None:
            self.count, self.failed = self.count + other.count, self.failed + other.failed
            self.total, self.outer = self.total + other.total, self.outer + other.outer

    def about_centre(self) -> np.ndarray:
        """Mean outer product of deviations from the centre."""
        return self.outer / self.count

    def jackknife(self) -> np.ndarray:
        """Jackknife covariance: (n-1)/n times the scatter about the replicate mean.

        Equal to the covariance of the mean of the pseudo-values
        n b - (n-1) b_k.
        """
        scatter = self.outer - np.outer(self.total, self.total) / self.count
        return (self.count - 1) / self.count * scatter


def _near(starts: Mapping[str, np.ndarray] | None, name: str, fit: regression.LogitFit) -> np.ndarray:
    """Starts of the replicates of a model: the full fit where none is given, or one far from it."""
    full = fit.filled[:, None]
    if starts is None:
        return full
    given = starts[name]
    far = ~np.isfinite(given).all(axis=0) | (np.abs(np.nan_to_num(given) - full) > 1.0).any(axis=0)
    return np.where(far, full, given)


class _Sink:
    """Collects block results: in memory for one block, in the shared folder for more."""

    def __init__(self, spark, schema: str, name: str, blocks: int):
        self.spark, self.schema, self.blocks = spark, schema, blocks
        self.path = new_table_path(spark, name) if blocks > 1 else None
        self.rows: list = []

        if self.path is not None:  # a table without rows can be read, too
            spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows: list) -> None:
        if self.path is None:
            self.rows += rows
        elif rows:
            self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        if self.path is None:
            return self.spark.createDataFrame(self.rows, self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)


class TrialAnalysis:
    """Sequential trial emulation of a panel.

    The panel is read once per pass of the weight models; the expanded table and the
    person rows are persisted for as long as the object is used (``close`` frees
    them).
    """

    def __init__(self, panel: DataFrame, plan: Plan):
        self.plan = plan
        self.spark = panel.sparkSession
        self._held: list[DataFrame] = []
        self.panel = self._hold(panel, "panel")

    def _hold(self, df: DataFrame, name: str) -> DataFrame:
        """Keep a table that several passes read.

        "memory" persists it: a lost executor costs the recomputation of its part.
        "shared" writes it, which ends the lineage for long runs.
        """
        if self.plan.storage == "shared":
            return written(df, name)
        self._held.append(keep(df))
        return self._held[-1]

    def close(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held = []

    def __enter__(self) -> TrialAnalysis:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # ---- point estimate -------------------------------------------------

    @cached_property
    def weight_fits(self) -> dict[str, regression.LogitFit]:
        p = self.plan
        if not p.weight_designs.models():
            return {}
        return weights.fit_weight_models(self.panel, p.spec, p.weight_designs, tol=p.tol, max_iter=p.max_iter)

    @cached_property
    def expanded(self) -> DataFrame:
        """Trial rows with their weights; visits without a weight are part of the trials, with NULL."""
        p = self.plan
        weighted = weights.ip_weights(self.panel, p.spec, self.weight_fits, dict(p.eligible_wts) or None, keep_missing=True)
        return self._hold(trials.emulate_trials(weighted, p.spec, p.covariates, p.estimand), "trials")

    @cached_property
    def fit(self) -> regression.LogitFit:
        """Outcome model, with aliased terms of ``drop_order`` removed."""
        p = self.plan
        first = regression.fit_logit(
            self.expanded, p.outcome, "outcome", "weight", drop_order=p.drop_order, tol=p.tol, max_iter=p.max_iter
        )
        if not first.dropped:
            return first
        kept = [i for i, n in enumerate(first.design.names) if n not in first.dropped]
        return replace(
            first,
            design=first.design.without(first.dropped),
            coef=first.coef[kept],
            vcov=first.vcov[np.ix_(kept, kept)],
            dropped=[],
        )

    def curve(self) -> DataFrame:
        return gcomp.marginal_curves(self.expanded, self.fit, self.plan.spec.visits, self.plan.trials)

    @cached_property
    def robust(self) -> np.ndarray:
        return regression.sandwich(self.expanded, self.fit, "outcome", "weight")

    # ---- person rows ----------------------------------------------------

    @cached_property
    def person_count(self) -> int:
        return self.persons.count()

    @cached_property
    def persons(self) -> DataFrame:
        """One row per person with a trial: number, visits, trial rows.

        Partitioned by the person number, which is also the key of the draws, so
        attaching counts to persons moves the draws only.
        """
        p, spec = self.plan, self.plan.spec
        visit_cols = [spec.period, spec.treatment, spec.prev_treatment]
        visit_cols += [spec.censor] if p.weights.censor_d is not None else []
        visit_cols += [c for _, d, _, _ in p.weight_designs.models() for c in d.columns]
        visit_cols += [flag for _, flag in p.eligible_wts]
        visit_cols = list(dict.fromkeys(visit_cols))
        row_cols = ["trial_period", "followup_time", "assigned_treatment", "outcome"]
        row_cols += [c for c in p.outcome.columns if c not in row_cols]

        def number(c: str) -> Column:
            if c not in self._codes:
                return F.col(c).cast("double")
            values = F.array(*[F.lit(v) for v in self._codes[c]])
            return F.when(F.col(c).isNotNull(), F.array_position(values, F.col(c)) - 1.0)

        def packed(df: DataFrame, columns: Sequence[str], name: str, limit: int) -> DataFrame:
            item = F.struct(*[number(c).alias(c) for c in columns])
            rows = df.groupBy(spec.id if name == "visits" else "id").agg(F.collect_list(item).alias(name))
            within = F.assert_true(
                F.size(name) <= limit, F.lit(f"more than {limit} {name} for one person: key not unique")
            )
            return rows.filter(within.isNull())

        k = spec.visits
        visits = packed(self.panel, visit_cols, "visits", k).withColumnRenamed(spec.id, "id")
        rows = packed(self.expanded, row_cols, "rows", k * (k + 1) // 2)
        both = visits.join(rows, "id")
        index = self._hold(resample.person_index(self.expanded, "id"), "index")
        count = index.count()
        tasks = max(min(self.spark.sparkContext.defaultParallelism, -(-count // 250)), -(-count // PERSONS_PER_TASK), 1)
        numbered = both.join(index, "id").select("idx", "visits", "rows")
        # Neighbours in number share a task, so that a task walks down one part of the tree of draws.
        part = (F.col("idx") * tasks / max(count, 1)).cast("int")
        return self._hold(numbered.repartitionById(tasks, part).sortWithinPartitions("idx"), "persons")

    @cached_property
    def _codes(self) -> dict[str, list]:
        """Levels of string covariates, by whose position persons carry them."""
        designs = [d for _, d, _, _ in self.plan.weight_designs.models()] + [self.fit.design]
        strings = {f.name for f in self.panel.schema if isinstance(f.dataType, T.StringType)}
        return {c: list(dict.fromkeys(v for d in designs for v in d.levels(c))) for c in strings if any(d.levels(c) for d in designs)}

    def _layout(self, replicates: int, first: int, counts: str) -> people.Layout:
        p, spec = self.plan, self.plan.spec
        return people.Layout(
            visits=spec.visits,
            replicates=replicates,
            first=first,
            counts=counts,
            treatment=spec.treatment,
            prev_treatment=spec.prev_treatment,
            period=spec.period,
            censor=spec.censor,
            models=tuple((n, d.coded(self._codes), y, s) for n, d, y, s in p.weight_designs.models()),
            eligible_wts=p.eligible_wts,
            outcome=self.fit.design.coded(self._codes),
            trials=p.trials,
        )

    def _with_draws(self, first: int, last: int, seed: int) -> DataFrame:
        """Person rows with the replicates of the block that drew the person.

        The draws arise in the task that holds the person. A person is drawn about once per
        replicate, so its list is about as long as the block.
        """
        return resample.with_draws(self.persons, self.person_count, first, last, seed)

    # ---- passes ---------------------------------------------------------

    def _total(self, rows: DataFrame, lay: people.Layout, keys: int, size: int, sums: Callable, most: int = people.CELLS) -> np.ndarray:
        def partial(batches):
            out = None
            for group in people.people(batches, lay, most):
                add = sums(group)
                out = add if out is None else out + add
            return out

        return add_partitions(rows, keys, size, partial)

    def _refit_weights(self, rows: DataFrame, lay: people.Layout, starts: Mapping[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], Status]:
        """Weight-model coefficients of every replicate (terms x replicates), and what became of them."""
        p = self.plan
        state = [
            kernel.Newton(
                len(design), lay.replicates, p.tol, p.max_iter, start=_near(starts, name, self.weight_fits[name]), last_step=True
            )
            for name, design, _, _ in lay.models
        ]
        size = max((kernel.width(s.p) for s in state), default=0)
        while any(len(s.active) for s in state):
            jobs = [(i, s.active, s.coef[:, s.active]) for i, s in enumerate(state) if len(s.active)]

            def sums(group, jobs=jobs):
                parts = people.weight_model_sums(group, lay, jobs)
                return np.concatenate([np.pad(a, ((0, 0), (0, size - a.shape[1]))) for a in parts])

            got = self._total(rows, lay, sum(len(a) for _, a, _ in jobs), size, sums)
            at = 0
            for i, active, _ in jobs:
                state[i].update(got[at : at + len(active), : kernel.width(state[i].p)])
                at += len(active)
        status = reduce(or_, map(Status.of, state), Status.good(lay.replicates))
        return {name: np.where(s.keep, s.coef, 0.0) for (name, _, _, _), s in zip(lay.models, state)}, status

    def _step_weights(self, rows: DataFrame, lay: people.Layout) -> dict[str, np.ndarray]:
        """One-step weight-model coefficients: full fit plus covariance times score."""
        if not lay.models:
            return {}
        fits = [self.weight_fits[name] for name, _, _, _ in lay.models]
        full = [f.filled for f in fits]
        sizes = [len(b) for b in full]

        def sums(group):
            return np.concatenate(people.weight_model_scores(group, lay, full), axis=1)

        got = self._total(rows, lay, lay.replicates, sum(sizes), sums)
        out, at = {}, 0
        for fit, (name, _, _, _), size in zip(fits, lay.models, sizes):
            out[name] = fit.filled[:, None] + fit.vcov @ got[:, at : at + size].T
            at += size
        return out

    def _refit_outcome(self, rows, lay, coefs, starts: Mapping[str, np.ndarray] | None = None) -> tuple[np.ndarray, Status]:
        """Outcome coefficients of every replicate, and what became of them."""
        p = self.plan
        s = kernel.Newton(
            len(lay.outcome),
            lay.replicates,
            p.tol,
            p.max_iter,
            names=tuple(lay.outcome.names),
            drop_order=p.drop_order,
            start=_near(starts, "outcome", self.fit),
            last_step=True,
        )
        while len(s.active):
            active, b = s.active, s.coef[:, s.active]

            def sums(group, active=active, b=b):
                return people.outcome_sums(group, lay, coefs, active, b)

            s.update(self._total(rows, lay, len(active), kernel.width(s.p), sums))
        return np.where(s.keep, s.coef, 0.0), Status.of(s)

    def _step_outcome(self, rows, lay, coefs) -> np.ndarray:
        full = self.fit.filled

        def sums(group):
            return people.outcome_scores(group, lay, coefs, full)

        got = self._total(rows, lay, lay.replicates, len(full), sums)
        return full[:, None] + self.fit.vcov @ got.T

    def _curves(self, rows, lay, b: np.ndarray) -> np.ndarray:
        """Mean survival per replicate: replicates x (treated visits, control visits)."""
        k = lay.visits
        got = self._total(rows, lay, lay.replicates, 4 * k, lambda group: people.curve_sums(group, lay, b))
        rows_ = got[:, 2 * k : 3 * k] if self.plan.normalise == "rows" else got[:, 3 * k :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return got[:, : 2 * k] / np.concatenate([rows_, rows_], axis=1)

    def _curve_rows(self, method: str, reps: Sequence[int], status: Status, means: np.ndarray) -> list:
        k = self.plan.spec.visits
        status.not_finite = status.not_finite | ~np.isfinite(means).all(axis=1)
        out = []
        for r, row in enumerate(means):
            head = (method, reps[r], *status.row(r))
            for j in range(k):
                t, c = float(row[j]), float(row[k + j])
                if not np.isfinite([t, c]).all():
                    out.append((*head, j, None, None, None, None, None))
                    continue
                ratio = t / c if c else None
                out.append((*head, j, t, c, t - c, ratio, c - t))
        return out

    def _coef_rows(self, method: str, reps: Sequence[int], b: np.ndarray) -> list:
        names = self.fit.design.names
        return [(method, reps[r], name, float(b[i, r])) for r in range(b.shape[1]) for i, name in enumerate(names)]

    # ---- methods --------------------------------------------------------

    def bootstrap(
        self, replicates: int, seed: int, methods: Sequence[str] = ("bootstrap", "lef_outcome", "lef_both")
    ) -> Replicates:
        """Bootstrap replicates of persons for several methods on the same draws.

        "bootstrap" refits weights and outcome; "lef_outcome" refits the weights and
        takes one step for the outcome; "lef_both" takes one step for both. Refitted
        weights are shared by the first two.
        """
        blocks = [(lo, min(lo + self.plan.block, replicates)) for lo in range(0, replicates, self.plan.block)]

        def prepared() -> Iterator[tuple[DataFrame, people.Layout]]:
            for lo, hi in blocks:
                rows = keep(self._with_draws(lo, hi, seed))
                yield rows, self._layout(hi - lo, lo, "drawn")
                rows.unpersist()

        return self._run(prepared(), methods, len(blocks))

    def jackknife(self) -> Replicates:
        """Leave-one-person-out fits, one replicate per person.

        One pass adds up how the scores of all persons change with the coefficients; then each person's fits
        are solved where the person lies, and its rows are made there. Persons for whom that isn't
        exact to ``leave_one_out.NEAR`` are refitted by passes over all persons, in blocks.
        """
        fits = self._full_fits()
        lay = fits.lay
        keys = max(1, -(-fits.length // 4096))

        def tensors(group):
            flat = np.zeros(keys * 4096)
            flat[: fits.length] = loo.sums(group, fits)[0]
            return flat.reshape(keys, 4096)

        flat = self._total(self.persons, lay, keys, 4096, tensors, most=PERSONS_AT_ONCE).ravel()[: fits.length]
        solved = self._hold(self._solved_without(fits, flat), "left-out")
        names = self.fit.design.names
        coefs = solved.filter("good").select(
            F.lit("jackknife").alias("method"), F.col("idx").cast("int").alias("rep"), F.posexplode("coef").alias("_i", "estimate")
        )
        term = F.get(F.array(*[F.lit(c) for c in names]), F.col("_i"))
        coefs = coefs.select("method", "rep", term.alias("term"), "estimate")
        moments = self._moments(solved)
        exact = self._run(self._left_out_blocks(solved), ("bootstrap",), 2, label="jackknife")
        moments.merge(exact.moments.get("jackknife"))
        curves = self._left_out_curves(solved).unionByName(exact.curves)
        return Replicates(curves, coefs.unionByName(exact.coefficients), {"jackknife": moments})

    def _full_fits(self) -> loo.Fits:
        lay = self._layout(1, 0, "ones")

        def kept(fit: regression.LogitFit) -> np.ndarray:
            return np.flatnonzero(~np.isnan(fit.coef))

        used = [self.weight_fits[name] for name, _, _, _ in lay.models]
        return loo.Fits(lay, tuple(f.filled for f in used), tuple(kept(f) for f in used), self.fit.filled, kept(self.fit))

    def _solved_without(self, fits: loo.Fits, flat: np.ndarray) -> DataFrame:
        """(idx, good, theta, coef, means) of every person: coefficients and mean survival without the person."""
        divisor = 1 if self.plan.normalise == "rows" else 2

        def run(batches):
            solver = loo.Solver(fits, flat)
            for batch in batches:
                done = [solver.solve(group) for group in people.people(iter([batch]), fits.lay, PERSONS_AT_ONCE)]
                if not done:
                    continue
                theta, coef, means, good = (np.concatenate(parts) for parts in zip(*done))
                with np.errstate(all="ignore"):
                    means = means[:, :, 0] / means[:, :, divisor]
                good &= np.isfinite(means).all(axis=1)
                lists = [list_column(a) for a in (theta, coef, means)]
                yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(good), *lists], ["idx", "good", "theta", "coef", "means"])

        return self.persons.mapInArrow(run, "idx long, good boolean, theta array<double>, coef array<double>, means array<double>")

    def _left_out_curves(self, solved: DataFrame) -> DataFrame:
        k = self.plan.spec.visits
        rows = solved.filter("good").select("idx", "means", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("followup_time"))
        t, c = F.get("means", F.col("followup_time")), F.get("means", F.col("followup_time") + k)
        return rows.select(
            F.lit("jackknife").alias("method"),
            F.col("idx").cast("int").alias("rep"),
            *[F.lit(0).alias(s) for s in STATUS],
            "followup_time",
            t.alias("survival_treatment"),
            c.alias("survival_control"),
            (t - c).alias("survival_difference"),
            F.when(c != 0, t / c).alias("survival_ratio"),
            (c - t).alias("mrd"),
        )

    def _moments(self, solved: DataFrame) -> Moments:
        """Moments of the solved coefficients, added up on executors."""
        centre, p = self.fit.filled, len(self.fit.filled)

        def run(batches):
            out = None
            for batch in batches:
                d = list_matrix(batch.column("coef"), p) - centre
                add = np.concatenate([d.sum(axis=0), (d.T @ d).ravel(), [len(d)]])[None, :]
                out = add if out is None else out + add
            return out

        got = add_partitions(solved.filter("good").select("coef"), 1, p * p + p + 1, run)[0]
        return Moments(centre, int(got[-1]), 0, got[:p], got[p:-1].reshape(p, p))

    def _left_out_blocks(self, solved: DataFrame) -> Iterator[tuple[DataFrame, people.Layout]]:
        """Blocks of the persons that are left to exact passes, with coefficients close to theirs as starts.

        The driver holds the coefficients of one block, as for any replicates.
        """
        rest = solved.filter("NOT good").select("idx", "theta", "coef").toLocalIterator()
        while block := sorted(islice(rest, self.plan.block)):
            lay = replace(self._layout(len(block), 0, "left_out"), left_out=tuple(r["idx"] for r in block))
            starts, at = {}, 0
            theta, coef = (np.array([r[c] for r in block]).T.reshape(-1, len(block)) for c in ("theta", "coef"))
            for name, design, _, _ in lay.models:
                starts[name] = theta[at : at + len(design)]
                at += len(design)
            yield self.persons, lay, starts | {"outcome": coef}

    def _run(self, prepared, methods: Sequence[str], blocks: int, label: str | None = None) -> Replicates:
        curves = _Sink(self.spark, REPLICATE_SCHEMA, "replicates", blocks)
        coefs = _Sink(self.spark, COEF_SCHEMA, "coefficients", blocks)
        moments = {}
        for rows, lay, *given in prepared:
            starts = given[0] if given else None
            refit, unfit = None, Status.good(lay.replicates)
            if {"bootstrap", "lef_outcome"} & set(methods):
                refit, unfit = self._refit_weights(rows, lay, starts)
            for method in methods:
                if method == "bootstrap":
                    b, status = self._refit_outcome(rows, lay, refit, starts)
                    # A term can be lost by the outcome model only; a weight model predicts without it.
                    status |= replace(unfit, failed=status.failed)
                elif method == "lef_outcome":
                    b, status = self._step_outcome(rows, lay, refit), replace(unfit)
                elif method == "lef_both":
                    b, status = self._step_outcome(rows, lay, self._step_weights(rows, lay)), Status.good(lay.replicates)
                else:
                    raise ValueError(f"unknown method {method!r}")
                status.not_finite = status.not_finite | ~np.isfinite(b).all(axis=0)
                name = label or method
                moments.setdefault(name, Moments(self.fit.filled)).add(b, status.failed)
                reps = lay.left_out or range(lay.first, lay.first + lay.replicates)
                curves.add(self._curve_rows(name, reps, status, self._curves(rows, lay, b)))
                coefs.add(self._coef_rows(name, reps, b))
        return Replicates(curves.table(), coefs.table(), moments)

    def normal_replicates(self, covariance: np.ndarray, size: int, seed: int, method: str) -> DataFrame | None:
        """Curves of coefficients drawn from a normal law about the fit.

        The draws (size x terms) travel with the task; every person row is read once
        for a block of draws.
        """
        b = kernel.normal_draws(self.fit.filled, covariance, size, seed)
        blocks = [(lo, min(lo + self.plan.block, size)) for lo in range(0, size, self.plan.block)]
        sink = _Sink(self.spark, REPLICATE_SCHEMA, method, len(blocks))
        for lo, hi in blocks:
            lay = self._layout(hi - lo, lo, "ones")
            means = self._curves(self.persons, lay, b[lo:hi].T)
            sink.add(self._curve_rows(method, range(lo, hi), Status.good(hi - lo), means))
        return sink.table()

