"""Weighted logistic regression with covariance, robust covariance and alias repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.functions import kernel
from emulant.functions.design import Design
from emulant.functions.sums import add_partitions, list_matrix
from emulant.session import keep, written

COEFFICIENT_SCHEMA = "model string, term string, estimate double, std_error double"
COVARIANCE_SCHEMA = "model string, term_i string, term_j string, value double"
STATISTICS_SCHEMA = (
    "model string, n bigint, sum_weight double, deviance double, null_deviance double,"
    " log_lik double, aic double, terms int, passes int, converged boolean"
)


@dataclass(frozen=True)
class ModelSpec:
    """One logistic model: design, response, optional weight and stratum."""

    design: Design
    y: Column
    weight: Column | None = None
    where: Column | None = None
    drop_order: tuple[str, ...] = ()


@dataclass
class LogitFit:
    """Result of one fit. Aliased terms have coefficient NaN and zero covariance."""

    design: Design
    coef: np.ndarray
    vcov: np.ndarray
    deviance: float = float("nan")
    sum_weight: float = float("nan")
    sum_response: float = float("nan")
    n: int = 0
    passes: int = 0
    converged: bool = True
    dropped: list[str] = field(default_factory=list)

    @property
    def filled(self) -> np.ndarray:
        """Coefficients with 0 for aliased terms, as prediction uses them."""
        return np.nan_to_num(self.coef, nan=0.0)

    @property
    def terms(self) -> int:
        """Number of terms left after repair."""
        return len(self.design) - len(self.dropped)

    @property
    def std_error(self) -> np.ndarray:
        return np.where(np.isnan(self.coef), np.nan, np.sqrt(np.diag(self.vcov)))

    def statistics(self) -> dict:
        rate = self.sum_response / self.sum_weight if self.sum_weight else float("nan")
        null = 0.0
        for part, share in ((self.sum_response, rate), (self.sum_weight - self.sum_response, 1 - rate)):
            if part > 0:
                null -= 2.0 * part * np.log(share)
        used = int((~np.isnan(self.coef)).sum())
        return {
            "n": self.n,
            "sum_weight": self.sum_weight,
            "deviance": self.deviance,
            "null_deviance": float(null),
            "log_lik": -self.deviance / 2.0,
            "aic": self.deviance + 2.0 * used,
            "terms": used,
            "passes": self.passes,
            "converged": self.converged,
        }


def fit_models(
    df: DataFrame, models: Mapping[str, ModelSpec], tol: float = 1e-10, max_iter: int = 30
) -> dict[str, LogitFit]:
    """Fit several logistic models over the same rows.

    All models advance together: one pass over the persisted rows per Newton
    iteration, whatever the number of models. Rows outside a model's stratum, with
    zero or missing weight, or with a missing value are left out of that model.
    Sizes that reach the driver depend on the number of terms only.
    """
    names = list(models)
    designs: list[Design] = []
    for m in models.values():
        if m.design not in designs:
            designs.append(m.design)
    columns = [d.vector().alias(f"x{i}") for i, d in enumerate(designs)]
    for i, m in enumerate(models.values()):
        w = F.lit(1.0) if m.weight is None else m.weight.cast("double")
        if m.where is not None:
            w = F.when(m.where, w).otherwise(0.0)
        columns += [m.y.cast("double").alias(f"y{i}"), w.alias(f"w{i}")]
    rows = keep(df.select(*columns))
    which = [designs.index(m.design) for m in models.values()]
    sizes = [len(d) for d in designs]
    state = {
        n: kernel.Newton(
            len(models[n].design),
            tol=tol,
            max_iter=max_iter,
            names=tuple(models[n].design.names),
            drop_order=models[n].drop_order,
        )
        for n in names
    }
    try:
        while any(not s.done.all() for s in state.values()):
            live = [i for i, n in enumerate(names) if not state[n].done.all()]
            plan = [(i, which[i], sizes[which[i]], state[names[i]].coef) for i in live]
            longest = max(kernel.width(p) for _, _, p, _ in plan)
            sums = add_partitions(rows, len(plan), longest, _model_sums(plan, longest))
            for row, (i, _, p, _) in zip(sums, plan):
                state[names[i]].update(row[None, : kernel.width(p)])
    finally:
        rows.unpersist()
    return {n: _finish(models[n].design, state[n]) for n in names}


def _model_sums(plan, longest):
    def run(batches):
        out = None
        for batch in batches:
            if out is None:
                out = np.zeros((len(plan), longest))
            matrices: dict[int, np.ndarray] = {}
            for row, (i, d, p, b) in enumerate(plan):
                if d not in matrices:
                    matrices[d] = list_matrix(batch.column(f"x{d}"), p)
                x = matrices[d]
                y = batch.column(f"y{i}").to_numpy(zero_copy_only=False)
                w = batch.column(f"w{i}").to_numpy(zero_copy_only=False)
                use = (w > 0) & np.isfinite(y) & np.isfinite(x).all(axis=1)
                out[row, : kernel.width(p)] += kernel.logistic_sums(x[use], y[use], w[use, None], b)[0]
        return out

    return run


def _finish(design: Design, s: kernel.Newton) -> LogitFit:
    keep = s.keep[:, 0]
    return LogitFit(
        design=design,
        coef=np.where(keep, s.coef[:, 0], np.nan),
        vcov=kernel.inverse_on(s.gram[0], keep),
        deviance=float(s.tail[0, 0]),
        sum_weight=float(s.tail[0, 1]),
        sum_response=float(s.tail[0, 2]),
        n=int(s.tail[0, 3]),
        passes=s.passes,
        converged=bool(s.converged[0]),
        dropped=s.dropped(0),
    )


def fit_logit(
    df: DataFrame,
    design: Design,
    y: str | Column,
    weight: str | Column | None = None,
    where: Column | None = None,
    drop_order: Sequence[str] = (),
    tol: float = 1e-10,
    max_iter: int = 30,
) -> LogitFit:
    """One weighted logistic regression.

    Aliased terms get no coefficient. If those named first in ``drop_order`` are
    aliased they count as removed (``fit.dropped``), which is how a replicate that
    lost a term is told from the full fit.
    """
    y = F.col(y) if isinstance(y, str) else y
    weight = F.col(weight) if isinstance(weight, str) else weight
    spec = ModelSpec(design, y, weight, where, tuple(drop_order))
    return fit_models(df, {"model": spec}, tol, max_iter)["model"]


def fit_groups(
    df: DataFrame,
    by: Sequence[str],
    design: Design,
    y: str | Column,
    weight: str | Column | None = None,
    tol: float = 1e-10,
    max_iter: int = 30,
    most: int = 10_000,
) -> GroupFits:
    """One weighted logistic regression for each group of ``by``, all groups in the same passes.

    A pass adds up the sums of every group that hasn't settled, at the group's own coefficients: a task's
    rows are summed by group first, and only sums are shuffled, so that a group may hold any share of the rows. The
    driver holds groups x terms; more than ``most`` groups are refused. Rows with a missing value or without
    weight are left out; a group of such rows alone has no coefficients.
    """
    by, spark = list(by), df.sparkSession
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    response = F.col(y) if isinstance(y, str) else y
    names = written(df.select(*by).distinct(), "groups")
    count = names.count()
    if count > most:
        raise ValueError(f"{count} groups are more than {most}")
    names = names.withColumn("_g", F.row_number().over(Window.orderBy(*by)) - 1)  # ``most`` rows at most
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    known = names.select("_g", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)])
    rows = df.join(F.broadcast(known), same).select("_g", design.vector().alias("x"), response.cast("double").alias("y"), w.cast("double").alias("w"))
    rows = keep(rows)
    state = kernel.Newton(len(design), count, tol, max_iter, tuple(design.names))
    try:
        while len(state.active):
            sums = add_partitions(rows, len(state.active), kernel.width(state.p), _group_sums(state.active, state.coef, count))
            state.update(sums)
    finally:
        rows.unpersist()
    levels = [tuple(r[c] for c in by) for r in names.orderBy("_g").collect()]
    return GroupFits(by, [names.schema[c] for c in by], design, levels, state)


def _group_sums(active: np.ndarray, coef: np.ndarray, count: int):
    place = np.full(count, -1)
    place[active] = np.arange(len(active))
    p = len(coef)

    def run(batches):
        out = None
        for batch in batches:
            if out is None:
                out = np.zeros((len(active), kernel.width(p)))
            g = batch.column("_g").to_numpy()
            x = list_matrix(batch.column("x"), p)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            use = np.flatnonzero((place[g] >= 0) & (w > 0) & np.isfinite(y) & np.isfinite(x).all(axis=1))
            use = use[np.argsort(g[use], kind="stable")]
            for part in np.split(use, np.flatnonzero(np.diff(g[use])) + 1):
                if len(part):
                    b = coef[:, g[part[0]]][:, None]
                    out[place[g[part[0]]]] += kernel.logistic_sums(x[part], y[part], w[part, None], b)[0]
        return out

    return run


@dataclass
class GroupFits:
    """Fits of ``fit_groups``; the k-th of ``levels`` has the k-th coefficients of ``state``."""

    by: list[str]
    fields: list[T.StructField]
    design: Design
    levels: list[tuple]
    state: kernel.Newton

    def fit(self, level: tuple) -> LogitFit:
        """The fit of one group."""
        k, s = self.levels.index(level), self.state
        kept = s.keep[:, k]
        return LogitFit(
            self.design,
            np.where(kept, s.coef[:, k], np.nan),
            kernel.inverse_on(s.gram[k], kept),
            float(s.tail[k, 0]),
            float(s.tail[k, 1]),
            float(s.tail[k, 2]),
            int(s.tail[k, 3]),
            int(s.fit_passes[k]),
            bool(s.converged[k]),
        )

    def tidy(self, spark: SparkSession) -> DataFrame:
        """Rows (``by``, term, estimate, std_error, n, separated, converged); no numbers where a group is separated."""
        rows = []
        for k, level in enumerate(self.levels):
            fit, separated = self.fit(level), bool(self.state.separated[k])
            for name, b, e in zip(self.design.names, fit.coef, fit.std_error):
                numbers = (None, None) if separated else (_nullable(b), _nullable(e))
                rows.append((*level, name, *numbers, fit.n, separated, fit.converged))
        tail = "term string, estimate double, std_error double, n bigint, separated boolean, converged boolean"
        return spark.createDataFrame(rows, T.StructType([*self.fields, *T.StructType.fromDDL(tail).fields]))


def linear_predictor(fit: LogitFit, fixed: Mapping[str, float] | None = None) -> Column:
    """The linear predictor as a column expression.

    Columns named in ``fixed`` are replaced by constants and folded into the
    coefficients, so a term that only depends on them costs nothing per row.
    """
    fixed = fixed or {}
    grouped: dict[tuple, float] = {}
    for term, beta in zip(fit.design.terms, fit.filled):
        free, value = [], float(beta)
        for factor in term.factors:
            if factor.column in fixed:
                value *= float(factor.numpy({factor.column: np.asarray([fixed[factor.column]])})[0])
            else:
                free.append(factor)
        grouped[tuple(free)] = grouped.get(tuple(free), 0.0) + value
    out = F.lit(grouped.pop((), 0.0))
    for factors, value in grouped.items():
        if value != 0.0:
            product = F.lit(value)
            for factor in factors:
                product = product * factor.spark()
            out = out + product
    return out


def predict(fit: LogitFit, fixed: Mapping[str, float] | None = None) -> Column:
    """Fitted probability as a column expression."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_predictor(fit, fixed)))


def score_columns(fit: LogitFit, y: Column, weight: Column) -> list[Column]:
    """Per-row contributions ``w (y - p) x_j`` to the score."""
    residual = weight * (y - predict(fit))
    return [(residual * t.spark()).alias(f"s{j}") for j, t in enumerate(fit.design.terms)]


def score_vector(df: DataFrame, fit: LogitFit, y: str, weight: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """Score of ``fit`` under other weights, one row per group of ``by``."""
    w = F.col(weight) if isinstance(weight, str) else weight
    parts = df.select(*by, *score_columns(fit, F.col(y), w))
    sums = [F.sum(f"s{j}").alias(name) for j, name in enumerate(fit.design.names)]
    return parts.groupBy(*by).agg(*sums)


def sandwich(
    df: DataFrame,
    fit: LogitFit,
    y: str,
    weight: str | Column | None = None,
    cluster: str = "id",
    adjust: str = "clusters",
) -> np.ndarray:
    """Robust covariance with the score added up per cluster.

    Scores are summed per cluster by a plain aggregation (partial sums before the
    shuffle, so a cluster with a large share of the rows is no bottleneck). The
    outer products of those sums are then added partition by partition.
    ``adjust``: "clusters" multiplies by G/(G-1), "none" leaves the plain formula.
    """
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    p = len(fit.design)
    scores = df.select(cluster, *score_columns(fit, F.col(y), w)).groupBy(cluster)
    scores = scores.agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(p)])
    vectors = scores.select(F.array(*[F.coalesce(F.col(f"s{j}"), F.lit(0.0)) for j in range(p)]).alias("s"))

    def outer(batches):
        out = None
        for batch in batches:
            s = list_matrix(batch.column("s"), p)
            add = np.concatenate([(s.T @ s).ravel(), [len(s)]])[None, :]
            out = add if out is None else out + add
        return out

    rows = keep(vectors)
    try:
        sums = add_partitions(rows, 1, p * p + 1, outer)[0]
    finally:
        rows.unpersist()
    return sandwich_from(fit.vcov, sums[: p * p].reshape(p, p), sums[-1], adjust)


def sandwich_from(bread: np.ndarray, meat: np.ndarray, clusters: float, adjust: str) -> np.ndarray:
    factor = clusters / (clusters - 1.0) if adjust == "clusters" and clusters > 1 else 1.0
    return factor * (bread @ meat @ bread)


def _nullable(value: float) -> float | None:
    return None if value is None or not np.isfinite(value) else float(value)


def tidy(spark: SparkSession, fits: Mapping[str, LogitFit], covariance: Mapping[str, np.ndarray] | None = None) -> DataFrame:
    """Coefficient rows of fitted models; ``covariance`` replaces the model SEs."""
    rows = []
    for name, fit in fits.items():
        se = fit.std_error
        if covariance and name in covariance:
            se = np.where(np.isnan(fit.coef), np.nan, np.sqrt(np.diag(covariance[name])))
        rows += [(name, t, _nullable(b), _nullable(s)) for t, b, s in zip(fit.design.names, fit.coef, se)]
    return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)


def covariance_rows(spark: SparkSession, matrices: Mapping[str, tuple[Design, np.ndarray]]) -> DataFrame:
    rows = [
        (name, design.names[i], design.names[j], float(m[i, j]))
        for name, (design, m) in matrices.items()
        for i in range(len(design))
        for j in range(len(design))
    ]
    return spark.createDataFrame(rows, COVARIANCE_SCHEMA)


def glance(spark: SparkSession, fits: Mapping[str, LogitFit]) -> DataFrame:
    """Fit statistics, one row per model. AIC counts estimated terms."""
    rows = []
    for name, fit in fits.items():
        s = fit.statistics()
        rows.append(
            (
                name,
                int(s["n"]),
                float(s["sum_weight"]),
                float(s["deviance"]),
                float(s["null_deviance"]),
                float(s["log_lik"]),
                float(s["aic"]),
                int(s["terms"]),
                int(s["passes"]),
                bool(s["converged"]),
            )
        )
    return spark.createDataFrame(rows, STATISTICS_SCHEMA)


def fit_from_tables(design: Design, coefficients: DataFrame, covariance: DataFrame, model: str) -> LogitFit:
    """Rebuild a stored fit; both tables hold a row per term or pair of terms."""
    place = {n: i for i, n in enumerate(design.names)}
    coef = np.full(len(design), np.nan)
    vcov = np.zeros((len(design), len(design)))
    for r in coefficients.filter(F.col("model") == model).collect():
        if r["estimate"] is not None:
            coef[place[r["term"]]] = r["estimate"]
    for r in covariance.filter(F.col("model") == model).collect():
        vcov[place[r["term_i"]], place[r["term_j"]]] = r["value"]
    return LogitFit(design, coef, vcov)


def treatment_effect(coefficients: DataFrame, term: str = "assigned_treatment") -> DataFrame:
    """Treatment coefficient (log odds ratio) per model and its exponential."""
    return coefficients.filter(F.col("term") == term).select(
        "model",
        F.col("estimate").alias("log_odds_ratio"),
        F.exp("estimate").alias("hazard_ratio"),
    )
