"""Confidence limits from replicates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulant.functions import kernel

CURVE_MEASURES = ("survival_treatment", "survival_control", "survival_difference", "survival_ratio")


def percentile_ci(
    reps: DataFrame, by: Sequence[str] = ("method", "followup_time"), value: str = "mrd", level: float = 0.95
) -> DataFrame:
    """Limits at the outer percentiles of the replicates.

    A group holds one value per replicate, a number set by the analyst, so the
    built-in percentile serves.
    """
    tail = (1.0 - level) / 2.0
    both = F.percentile(value, [tail, 1.0 - tail])
    return reps.groupBy(*by).agg(both.alias("_q")).select(
        *by, F.col("_q")[0].alias("lb"), F.col("_q")[1].alias("ub")
    )


def measure_ci(
    reps: DataFrame,
    by: Sequence[str] = ("followup_time",),
    measures: Sequence[str] = CURVE_MEASURES,
    level: float = 0.95,
) -> DataFrame:
    """Percentile limits for both survival curves, their difference and ratio."""
    long = reps.unpivot([F.col(c) for c in by], [F.col(m) for m in measures], "measure", "value")
    return percentile_ci(long, (*by, "measure"), "value", level)


def pivotal_limits(est: Column, lb: Column, ub: Column) -> tuple[Column, Column]:
    """Limits mirrored about the estimate."""
    return F.lit(2.0) * est - ub, F.lit(2.0) * est - lb


def pivotal_ci(limits: DataFrame, estimates: DataFrame, on: Sequence[str] = ("followup_time",), est: str = "mrd") -> DataFrame:
    """Replace percentile limits by pivotal ones."""
    joined = limits.join(estimates.select(*on, F.col(est).alias("est")), list(on))
    low, high = pivotal_limits(F.col("est"), F.col("lb"), F.col("ub"))
    return joined.withColumns({"_l": low, "_u": high}).select(
        *[c for c in limits.columns if c not in ("lb", "ub")], "est", F.col("_l").alias("lb"), F.col("_u").alias("ub")
    )


def replicate_se(reps: DataFrame, by: Sequence[str] = ("method", "followup_time"), value: str = "mrd") -> DataFrame:
    """SD of the replicates."""
    return reps.groupBy(*by).agg(F.stddev_samp(value).alias("se"))


def failed_replicates(reps: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Number of replicates, and of those that lost a term."""
    per_rep = reps.groupBy(*by, "rep").agg(F.max("failed").alias("failed"))
    return per_rep.groupBy(*by).agg(
        F.count(F.lit(1)).alias("replicates"), F.sum("failed").cast("bigint").alias("failed")
    )


def replicate_status(reps: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Number of replicates, and of those that lost a term (failed), are separated, have not converged or are no number."""
    kinds = ("failed", "separated", "not_converged", "not_finite")
    per_rep = reps.groupBy(*by, "rep").agg(*[F.max(k).alias(k) for k in kinds])
    return per_rep.groupBy(*by).agg(F.count(F.lit(1)).alias("replicates"), *[F.sum(k).cast("bigint").alias(k) for k in kinds])


def jackknife_wald_ci(
    reps: DataFrame,
    estimates: DataFrame,
    center: str = "estimate",
    value: str = "mrd",
    on: str = "followup_time",
    z: float = 1.96,
) -> DataFrame:
    """Wald limits with the jackknife standard error.

    ``center``: deviations from the full "estimate", or from the replicate "mean".
    Both come from running sums, so no replicate is gathered.
    """
    d = reps.join(estimates.select(on, F.col(value).alias("est")), on).withColumn("_d", F.col(value) - F.col("est"))
    n = F.count(F.lit(1))
    squares = F.sum(F.col("_d") * F.col("_d")) if center == "estimate" else F.var_pop("_d") * n
    out = d.groupBy(on).agg(
        F.first("est").alias("est"), F.sqrt((n - 1) / n * squares).alias("se"), n.alias("replicates")
    )
    return out.select(
        on,
        "est",
        "se",
        (F.col("est") - z * F.col("se")).alias("lb"),
        (F.col("est") + z * F.col("se")).alias("ub"),
        "replicates",
    )


def ci_bootstrap(analysis, replicates: int, seed: int, kind: str = "percentile") -> DataFrame:
    """Direct bootstrap: weights and outcome model refitted per replicate."""
    return _from_draws(analysis, "bootstrap", replicates, seed, kind)


def ci_lef(analysis, replicates: int, seed: int, kind: str = "both", limits: str = "percentile", draws: int = 500) -> DataFrame:
    """Linearised bootstrap. ``kind``: "outcome", "both", or "mvn" (normal draws with
    the variance of the one-step coefficients)."""
    if kind in ("outcome", "both"):
        return _from_draws(analysis, f"lef_{kind}", replicates, seed, limits)
    reps = analysis.bootstrap(replicates, seed, ("lef_outcome",))
    cov = reps.moments["lef_outcome"].about_centre()
    return percentile_ci(analysis.normal_replicates(cov, draws, seed, "lef_mvn"))


def _from_draws(analysis, method: str, replicates: int, seed: int, kind: str) -> DataFrame:
    limits = percentile_ci(analysis.bootstrap(replicates, seed, (method,)).curves)
    return limits if kind == "percentile" else pivotal_ci(limits, analysis.curve())


def ci_jackknife(analysis, center: str = "estimate") -> DataFrame:
    """Jackknife Wald limits."""
    return jackknife_wald_ci(analysis.jackknife().curves, analysis.curve(), center)


def _null_limits(analysis, method: str) -> DataFrame:
    visits = analysis.spark.range(analysis.plan.spec.visits)
    none = F.lit(None).cast("double")
    return visits.select(
        F.lit(method).alias("method"), F.col("id").cast("int").alias("followup_time"), none.alias("lb"), none.alias("ub")
    )


def ci_jackknife_mvn(analysis, draws: int = 500, seed: int = 1) -> DataFrame:
    """Normal draws with the jackknife covariance; NULL limits if a replicate lost a term."""
    moments = analysis.jackknife().moments["jackknife"]
    if moments.failed:
        return _null_limits(analysis, "jackknife_mvn")
    return percentile_ci(analysis.normal_replicates(moments.jackknife(), draws, seed, "jackknife_mvn"))


def ci_sandwich(analysis, draws: int = 500, seed: int = 1) -> DataFrame:
    """Normal draws with the robust covariance; NULL limits if it is not positive definite."""
    cov = analysis.robust
    used = ~np.isnan(analysis.fit.coef)
    if not kernel.positive_definite(cov[np.ix_(used, used)]):
        return _null_limits(analysis, "sandwich")
    return percentile_ci(analysis.normal_replicates(cov, draws, seed, "sandwich"))
