"""Evaluation of estimators over long tables of replicates.

Result tables are long: one row per outcome, scenario, iteration, visit and method.
Groups of these columns are few and their rows many, so everything here is built
from aggregates with partial sums; medians and quartiles use the split quantiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulant.operators.intervals import pivotal_limits
from emulant.operators.joins import SMALL_ROWS, beside
from emulant.operators.quantiles import quantile_table
from emulant.spec import METHODS

CELL = ("outcome", "scenario", "visit")
METHOD_CELL = (*CELL, "method")


def _truth(truth: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    return truth.select(*on, F.col(value).alias("_truth"))


def bias(
    est: DataFrame,
    truth: DataFrame,
    by: Sequence[str] = CELL,
    values: Mapping[str, str] | None = None,
    on: Sequence[str] | None = None,
) -> DataFrame:
    """Mean estimate minus truth, missing estimates left out.

    ``values`` maps estimate columns to truth columns. Estimates are averaged before
    the truth is joined.
    """
    values = values or {"est": "mrd"}
    on = list(on or by)
    means = est.groupBy(*by).agg(*[F.avg(e).alias(f"_m_{e}") for e in values])
    known = truth.select(*on, *[F.col(t).alias(f"_t_{e}") for e, t in values.items()])
    return means.join(known, on).select(
        *by, *[(F.col(f"_m_{e}") - F.col(f"_t_{e}")).alias(f"bias_{e}") for e in values]
    )


def empirical_sd(est: DataFrame, by: Sequence[str] = CELL, value: str = "est") -> DataFrame:
    return est.groupBy(*by).agg(F.stddev_samp(value).alias("sd"))


def accuracy(
    est: DataFrame, truth: DataFrame, by: Sequence[str] = CELL, value: str = "est", truth_value: str = "mrd", on: Sequence[str] | None = None
) -> DataFrame:
    """Bias, SD, root mean squared error and bias/SD in one aggregation."""
    on = list(on or by)
    both = est.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("sd"))
    b = F.col("_mean") - F.col("_truth")
    return both.join(_truth(truth, on, truth_value), on).select(
        *by,
        b.alias("bias"),
        "sd",
        F.sqrt(b * b + F.col("sd") * F.col("sd")).alias("rmse"),
        (b / F.col("sd")).alias("bias_sd_ratio"),
    )


def rmse(est: DataFrame, truth: DataFrame, **kw) -> DataFrame:
    return accuracy(est, truth, **kw).drop("bias", "sd", "bias_sd_ratio")


def bias_se_ratio(est: DataFrame, truth: DataFrame, **kw) -> DataFrame:
    return accuracy(est, truth, **kw).drop("bias", "sd", "rmse")


def se_ratio(standard_errors: DataFrame, est: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Replicate standard error over the empirical SD of the estimates."""
    return standard_errors.join(empirical_sd(est, by), list(by)).withColumn(
        "se_ratio", F.col("se") / F.col("sd")
    )


def _limits(pivot: Sequence[str]) -> tuple[Column, Column]:
    if not pivot:
        return F.col("lb"), F.col("ub")
    mirrored = pivotal_limits(F.col("est"), F.col("lb"), F.col("ub"))
    chosen = F.col("method").isin(list(pivot))
    return tuple(F.when(chosen, m).otherwise(F.col(c)) for m, c in zip(mirrored, ("lb", "ub")))


def _inside(low: Column, high: Column, target: Column, closed: bool) -> Column:
    return (low <= target) & (high >= target) if closed else (low < target) & (high > target)


def coverage(
    ci: DataFrame,
    truth: DataFrame,
    by: Sequence[str] = METHOD_CELL,
    on: Sequence[str] = CELL,
    truth_value: str = "mrd",
    pivot: Sequence[str] = (),
    closed: bool = True,
    shift: DataFrame | None = None,
    bound: int = SMALL_ROWS,
) -> DataFrame:
    """Share of intervals that hold the target, among intervals that exist.

    Targets are counted: up to ``bound`` they are broadcast, beyond it intervals are dealt out by iteration.
    ``pivot`` names methods whose limits are mirrored about the estimate first.
    ``shift`` is a table of biases (column ``bias_est``) added to the target.
    """
    target = _truth(truth, on, truth_value)
    if shift is not None:
        target = target.join(shift, list(on)).withColumn("_truth", F.col("_truth") + F.col("bias_est"))
    low, high = _limits(pivot)
    hit = F.when(
        F.col("lb").isNotNull(), F.when(_inside(low, high, F.col("_truth"), closed), 1.0).otherwise(0.0)
    )
    return beside(ci, target.select(*on, "_truth"), on, ["iter"], bound).groupBy(*by).agg(
        F.avg(hit).alias("coverage"), F.count("lb").alias("intervals")
    )


def coverage_simultaneous(
    ci: DataFrame,
    truth: DataFrame,
    last_visit: int,
    by: Sequence[str] = ("outcome", "scenario", "method"),
    on: Sequence[str] = CELL,
    truth_value: str = "mrd",
    closed: bool = False,
    bound: int = SMALL_ROWS,
) -> DataFrame:
    """Share of iterations whose intervals hold the target at every visit.

    Bounds are strict. An iteration counts as a success of the method if it has
    an interval at the last visit.
    """
    target = _truth(truth, on, truth_value)
    ok = F.coalesce(_inside(F.col("lb"), F.col("ub"), F.col("_truth"), closed), F.lit(False))
    per_iter = beside(ci, target, on, ["iter"], bound).groupBy(*by, "iter").agg(
        F.min(ok.cast("int")).alias("_all"),
        F.max(F.when((F.col("visit") == last_visit) & F.col("lb").isNotNull(), 1).otherwise(0)).alias("_ok"),
    )
    done = per_iter.filter("_ok = 1")
    return done.groupBy(*by).agg(
        F.avg(F.col("_all").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("iterations")
    )


def ci_width(ci: DataFrame, stat: str = "mean", by: Sequence[str] = METHOD_CELL) -> DataFrame:
    """Width of the intervals: "mean" (with mean -/+ SD), "sd" or "median"."""
    width = F.abs(F.col("ub") - F.col("lb"))
    if stat == "median":
        return quantile_table(ci.withColumn("_width", width), by, "_width", {"median_width": 0.5})
    mean, sd = F.avg(width), F.stddev_samp(width)
    if stat == "sd":
        return ci.groupBy(*by).agg(sd.alias("sd_width"))
    return ci.groupBy(*by).agg(
        mean.alias("mean_width"), (mean - sd).alias("low_width"), (mean + sd).alias("high_width")
    )


def ci_width_two_level(ci: DataFrame, by: Sequence[str] = ("outcome", "scenario", "method")) -> DataFrame:
    """Mean and SD over visits of the mean width at each visit."""
    rows = ci.groupBy(*by, "visit").agg(F.avg(F.col("ub") - F.col("lb")).alias("_w"))
    return rows.groupBy(*by).agg(F.avg("_w").alias("mean_width"), F.stddev_samp("_w").alias("sd_width"))


def failure_rate(
    ci: DataFrame,
    iters: int | str,
    grid: DataFrame,
    by: Sequence[str] = ("outcome", "size", "treat", "method"),
    jackknife_size: int | None = 200,
    methods: Sequence[str] = METHODS,
    outcomes: Sequence[str] = (),
) -> DataFrame:
    """Share of planned iterations without an interval at visit 0, averaged over scenarios.

    ``grid`` has a row for each planned scenario, and each of ``methods`` is planned for it (and each of
    ``outcomes``, where ``grid`` doesn't name the outcome): a cell without any result has failed in all its
    iterations. ``iters`` is the planned number of iterations, or a column of ``grid`` holding it. Jackknife methods
    exist for samples of ``jackknife_size`` (None: all); elsewhere the rate is NULL.
    """
    total = F.lit(iters) if isinstance(iters, int) else F.col(iters)
    planned = grid.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    if "outcome" not in grid.columns:
        planned = planned.withColumn("outcome", F.explode(F.array(*[F.lit(o) for o in outcomes])))
    per = ci.filter("visit = 0").groupBy("outcome", "scenario", "method").agg(F.count("lb").alias("_ok"))
    rate = (total - F.coalesce("_ok", F.lit(0))) / total
    mean = planned.join(per, ["outcome", "scenario", "method"], "left").groupBy(*by).agg(F.avg(rate).alias("_rate"))
    if jackknife_size is None:
        return mean.withColumnRenamed("_rate", "failure_rate")
    absent = F.col("method").startswith("jackknife") & (F.col("size") != jackknife_size)
    return mean.select(*by, F.when(~absent, F.col("_rate")).alias("failure_rate"))


def mc_se(cov: DataFrame, iters: int | Column) -> DataFrame:
    """Monte-Carlo standard error of a coverage."""
    n = F.lit(iters) if isinstance(iters, int) else iters
    return cov.withColumn("mc_se", F.sqrt(F.col("coverage") * (1 - F.col("coverage")) / n))


def mean_time(times: DataFrame, by: Sequence[str], value: str = "seconds") -> DataFrame:
    return times.groupBy(*by).agg(F.avg(value).alias("mean_seconds"))


def rank_methods(cov: DataFrame, by: Sequence[str] = ("visit", "scenario")) -> DataFrame:
    """Dense rank of the methods by coverage, best first; a group holds one row per method."""
    return cov.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("coverage"))))


def to_long(df: DataFrame, id_cols: Sequence[str], name: str = "method", value: str = "value") -> DataFrame:
    """All other columns as rows."""
    rest = [c for c in df.columns if c not in id_cols]
    return df.unpivot([F.col(c) for c in id_cols], [F.col(c) for c in rest], name, value)


def to_bounds(df: DataFrame, id_cols: Sequence[str], separator: str = "_") -> DataFrame:
    """Columns named ``LB<sep>method`` and ``UB<sep>method`` as rows with both bounds."""
    long = to_long(df, id_cols, "_name", "_value")
    at = F.instr("_name", separator)
    bound = F.substring(F.col("_name"), F.lit(1), at - 1)
    method = F.substring(F.col("_name"), at + len(separator), F.length("_name"))
    return long.select(*id_cols, bound.alias("_bound"), method.alias("method"), "_value").groupBy(
        *id_cols, "method"
    ).agg(
        F.max(F.when(F.col("_bound") == "LB", F.col("_value"))).alias("lb"),
        F.max(F.when(F.col("_bound") == "UB", F.col("_value"))).alias("ub"),
    )


def pair_bounds(lb: DataFrame, ub: DataFrame, on: Sequence[str] = ("visit", "method")) -> DataFrame:
    """Lower and upper bounds of two long tables side by side."""
    return lb.join(ub, list(on))


def compare_runs(new: DataFrame, old: DataFrame, on: Sequence[str] = ("visit", "scenario")) -> DataFrame:
    """Two rankings side by side, the k-th best of one with the k-th best of the other.

    Ties are put in order of the method name, so that each place exists once.
    """
    order = Window.partitionBy(*on).orderBy(F.desc("coverage"), "method")

    def placed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            *on,
            F.row_number().over(order).alias("place"),
            F.col("method").alias(f"method{suffix}"),
            F.col("coverage").alias(f"coverage{suffix}"),
        )

    return placed(new, "_new").join(placed(old, "_old"), [*on, "place"])


def quartile_summary(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Mean and quartiles per group."""
    mean = df.groupBy(*by).agg(F.avg(column).alias("mean"))
    return mean.join(quantile_table(df, by, column, {"q1": 0.25, "q3": 0.75}), list(by))


def replicate_mean(est: DataFrame, by: Sequence[str], value: str = "est") -> DataFrame:
    """Mean over iterations as a stand-in for the truth."""
    return est.groupBy(*by).agg(F.avg(value).alias("mrd"))


def pool_truth(
    truths: Sequence[DataFrame], weights: Sequence[float], on: Sequence[str], value: str = "mrd"
) -> DataFrame:
    """Weighted mean of the truths of several runs, by key; NULL where one of them is."""
    parts = None
    for df, w in zip(truths, weights):
        part = df.select(*on, (F.col(value) * w).alias("_v"), F.lit(float(w)).alias("_w"))
        parts = part if parts is None else parts.unionByName(part)
    known = F.count("_v") == F.count(F.lit(1))
    return parts.groupBy(*on).agg(F.when(known, F.sum("_v") / F.sum("_w")).alias(value))


def truth_diff(a: DataFrame, b: DataFrame, on: Sequence[str], digits: int = 3, value: str = "mrd") -> DataFrame:
    """Rounded difference of two truths (halves to even)."""
    return a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), list(on)).select(
        *on, F.bround(F.col("_a") - F.col("_b"), digits).alias("difference")
    )
