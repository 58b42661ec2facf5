"""Standardisation: survival under "always treated" and "never treated"."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulant.operators.regression import LogitFit, predict

ARMS = (("survival_treatment", 1), ("survival_control", 0))


def baselines(expanded: DataFrame, trials: Sequence[int] | None = (0,)) -> DataFrame:
    """First row of each (person, trial), for the named trials or all of them."""
    rows = expanded.filter(F.col("followup_time") == 0)
    return rows if trials is None else rows.filter(F.col("trial_period").isin(list(trials)))


def prediction_grid(expanded: DataFrame, visits: int, trials: Sequence[int] | None = (0,)) -> DataFrame:
    """Every follow-up 0 .. visits-1-trial of each observed (person, trial).

    Covariates stay at their baseline value, so nothing has to be filled down.
    """
    return baselines(expanded, trials).withColumn(
        "followup_time", F.explode(F.sequence(F.lit(0), F.lit(visits - 1) - F.col("trial_period")))
    )


def fill_down(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("id", "trial_period")) -> DataFrame:
    """Carry the last known value forward within ``keys``, by follow-up."""
    w = (
        Window.partitionBy(*keys)
        .orderBy("followup_time")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def predict_arms(grid: DataFrame, fit: LogitFit, treatment: str = "assigned_treatment") -> DataFrame:
    """Hazard of each grid row under both strategies."""
    return grid.withColumns(
        {
            "hazard_treatment": predict(fit, {treatment: 1}),
            "hazard_control": predict(fit, {treatment: 0}),
        }
    )


def cum_survival(df: DataFrame, keys: Sequence[str] = ("id", "trial_period")) -> DataFrame:
    """Running product of one minus hazard within ``keys``.

    A product, not the exponential of summed logarithms: a hazard of 1 must give 0.
    """
    w = (
        Window.partitionBy(*keys)
        .orderBy("followup_time")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumns(
        {
            "survival_treatment": F.product(F.lit(1.0) - F.col("hazard_treatment")).over(w),
            "survival_control": F.product(F.lit(1.0) - F.col("hazard_control")).over(w),
        }
    )


def curve_columns(treated: Column, control: Column) -> list[Column]:
    return [
        treated.alias("survival_treatment"),
        control.alias("survival_control"),
        (treated - control).alias("survival_difference"),
        (treated / control).alias("survival_ratio"),
        (control - treated).alias("mrd"),
    ]


def mean_curves(
    survival: DataFrame, by: Sequence[str] = ("followup_time",), count: str | None = None, normalise: str = "rows"
) -> DataFrame:
    """Average survival per visit, with difference, ratio and risk difference.

    With ``count`` each person counts as often as drawn. ``normalise`` divides by
    the number of rows ("rows", as a bootstrap mean over the original persons) or by
    the number of draws ("counts").
    """
    n = F.lit(1.0) if count is None else F.col(count)
    divisor = F.count(F.lit(1)) if normalise == "rows" else F.sum(n)
    means = [F.sum(F.col(c) * n) / divisor for c, _ in ARMS]
    means = survival.groupBy(*by).agg(*[m.alias(c) for m, (c, _) in zip(means, ARMS)])
    return means.select(*by, *curve_columns(F.col("survival_treatment"), F.col("survival_control")))


def marginal_curves(
    expanded: DataFrame,
    fit: LogitFit,
    visits: int,
    trials: Sequence[int] | None = (0,),
    count: str | None = None,
    normalise: str = "rows",
    treatment: str = "assigned_treatment",
) -> DataFrame:
    """Survival curves under both strategies and the marginal risk difference.

    A baseline row carries all it needs for its own curve, so each row computes its
    survival at every visit and only sums per visit are shuffled: no grid, join or
    window over persons.
    """
    base = baselines(expanded, trials)
    hazards = {}
    for name, arm in ARMS:
        for k in range(visits):
            hazards[f"_{name}_{k}"] = predict(fit, {treatment: arm, "followup_time": k})
    extra = [F.col(count).alias("_n")] if count else [F.lit(1.0).alias("_n")]
    rows = base.select("trial_period", *extra, *[h.alias(c) for c, h in hazards.items()])

    def survival(name: str, k: int) -> Column:
        return reduce(lambda a, b: a * b, [F.lit(1.0) - F.col(f"_{name}_{i}") for i in range(k + 1)])

    points = F.array(
        *[
            F.struct(F.lit(k).alias("followup_time"), *[survival(name, k).alias(name) for name, _ in ARMS])
            for k in range(visits)
        ]
    )
    inside = F.slice(points, F.lit(1), F.greatest(F.lit(visits) - F.col("trial_period"), F.lit(0)))
    long = rows.select("_n", F.inline(inside))
    return mean_curves(long, count="_n" if count else None, normalise=normalise)


def strategy_curves(
    expanded: DataFrame,
    fit: LogitFit,
    strategies: Mapping[str, Sequence[float]],
    trials: Sequence[int] | None = (0,),
    treatment: str = "treatment",
) -> DataFrame:
    """Mean survival per visit under strategies that set the treatment visit by visit: (strategy, followup_time, survival).

    For models whose terms follow the treatment of a row, as in an as-treated analysis. As in
    ``marginal_curves`` a baseline row computes its own curves, and only sums per visit are shuffled.
    """
    points = []
    for name, path in strategies.items():
        alive = F.lit(1.0)
        for k, value in enumerate(path):
            alive = alive * (F.lit(1.0) - predict(fit, {treatment: value, "followup_time": k}))
            points.append(F.struct(F.lit(name).alias("strategy"), F.lit(k).alias("followup_time"), F.lit(len(path)).alias("_k"), alive.alias("_s")))
    rows = baselines(expanded, trials).select("trial_period", F.inline(F.array(*points)))
    inside = rows.filter(F.col("followup_time") < F.col("_k") - F.col("trial_period"))
    return inside.groupBy("strategy", "followup_time").agg(F.avg("_s").alias("survival"))


def km(df: DataFrame, by: Sequence[str] = (), id: str = "id", time: str = "t", status: str = "Y") -> DataFrame:
    """Kaplan-Meier curve from the last row of each person.

    Counts per time are aggregated first; the running parts then work on one row per
    time.
    """
    by = list(by)
    last = df.groupBy(*by, id).agg(F.max(time).alias("time"), F.max_by(status, time).alias("status"))
    per_time = last.groupBy(*by, "time").agg(
        F.count(F.lit(1)).alias("n_leaving"), F.sum("status").cast("long").alias("n_event")
    )
    order = Window.partitionBy(*by).orderBy("time")
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_risk = per_time.withColumn("n_risk", F.sum("n_leaving").over(from_here))
    return at_risk.withColumn(
        "survival", F.product(F.lit(1.0) - F.col("n_event") / F.col("n_risk")).over(so_far)
    ).select(*by, "time", "n_risk", "n_event", "survival")


def km_difference(df: DataFrame, arm: str, id: str = "id", time: str = "t", status: str = "Y") -> DataFrame:
    """Kaplan-Meier curves of both arms side by side, with difference and risk difference.

    Every time at which a person of either arm leaves has both curves: an arm that nobody
    leaves then keeps its survival, 1 before its first time. An arm without persons is NULL.
    """
    last = df.groupBy(arm, id).agg(F.max(time).alias("time"), F.max_by(status, time).alias("status"))
    counts = {}
    for side in (0, 1):
        here = F.when(F.col(arm) == side, 1)
        counts[f"_leaving{side}"] = F.count(here)
        counts[f"_event{side}"] = F.coalesce(F.sum(here * F.col("status")), F.lit(0)).cast("long")
    per_time = last.filter(F.col(arm).isin(0, 1)).groupBy("time").agg(*[c.alias(n) for n, c in counts.items()])
    order = Window.orderBy("time")
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    risk = per_time.withColumns({f"_risk{s}": F.sum(f"_leaving{s}").over(from_here) for s in (0, 1)})
    sides = risk.select("time", *[
        F.when(
            F.sum(f"_leaving{s}").over(everyone) > 0,
            F.product(F.when(F.col(f"_risk{s}") > 0, F.lit(1.0) - F.col(f"_event{s}") / F.col(f"_risk{s}")).otherwise(F.lit(1.0))).over(so_far),
        ).alias(name)
        for s, name in ((1, "survival_treatment"), (0, "survival_control"))
    ])
    return sides.select(
        F.col("time").alias("followup_time"),
        *curve_columns(F.col("survival_treatment"), F.col("survival_control")),
    )
