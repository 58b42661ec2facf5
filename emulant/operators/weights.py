"""Inverse-probability weights for treatment switching and drop-out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulant.functions.design import Design
from emulant.operators.quantiles import quantile_table
from emulant.operators.regression import LogitFit, ModelSpec, fit_models, predict
from emulant.spec import PanelSpec

INTERCEPT = Design.of()


@dataclass(frozen=True)
class WeightDesigns:
    """Designs of the weight models.

    Switch models are fitted apart for persons untreated and treated at the
    previous visit; with ``switch_d`` None there are none, and switching is not
    weighted. Censor models, if any, are apart too, unless ``pooled``.
    """

    switch_d: Design | None
    switch_n: Design = INTERCEPT
    censor_d: Design | None = None
    censor_n: Design = INTERCEPT
    pooled: bool = False

    def models(self) -> list[tuple[str, Design, str, int | None]]:
        """(name, design, response kind, stratum) of every model."""
        out: list[tuple[str, Design, str, int | None]] = []
        for stratum in (0, 1) if self.switch_d is not None else ():
            out.append((f"switch_d{stratum}", self.switch_d, "treatment", stratum))
            out.append((f"switch_n{stratum}", self.switch_n, "treatment", stratum))
        if self.censor_d is not None:
            for stratum in (None,) if self.pooled else (0, 1):
                tag = "" if stratum is None else str(stratum)
                out.append((f"censor_d{tag}", self.censor_d, "stays", stratum))
                out.append((f"censor_n{tag}", self.censor_n, "stays", stratum))
        return out


def fit_weight_models(
    panel: DataFrame,
    spec: PanelSpec,
    designs: WeightDesigns,
    count: str | None = None,
    tol: float = 1e-10,
    max_iter: int = 30,
) -> dict[str, LogitFit]:
    """Fit every weight model, all of them in the same passes over the panel.

    ``count`` weights each row by the number of times its person was drawn.
    """
    models = {}
    for name, design, response, stratum in designs.models():
        y = F.col(spec.treatment) if response == "treatment" else 1 - F.col(spec.censor)
        where = None if stratum is None else F.col(spec.prev_treatment) == stratum
        models[name] = ModelSpec(design, y, F.col(count) if count else None, where)
    return fit_models(panel, models, tol, max_iter)


def fit_switch_models(panel: DataFrame, spec: PanelSpec, denominator: Design, numerator: Design = INTERCEPT) -> dict[str, LogitFit]:
    """P(treated now | previous treatment): denominator and numerator per stratum."""
    return fit_weight_models(panel, spec, WeightDesigns(denominator, numerator))


def fit_censor_models(
    panel: DataFrame, spec: PanelSpec, denominator: Design, numerator: Design = INTERCEPT, pooled: bool = False
) -> dict[str, LogitFit]:
    """P(no drop-out), by previous treatment or pooled."""
    designs = WeightDesigns(INTERCEPT, INTERCEPT, denominator, numerator, pooled)
    fits = fit_weight_models(panel, spec, designs)
    return {n: f for n, f in fits.items() if n.startswith("censor")}


def score(df: DataFrame, fits: Mapping[str, LogitFit], prefix: str = "p_") -> DataFrame:
    """Add the fitted probability of each model under its coefficients."""
    return df.withColumns({f"{prefix}{name}": predict(fit) for name, fit in fits.items()})


def row_weight(
    treatment: Column, numerator: Column, denominator: Column, applies: Column | None = None
) -> Column:
    """Weight of one visit: ratio of the probabilities of the treatment taken.

    Missing probabilities give a missing weight. Where ``applies`` is false the
    weight is 1.
    """
    ratio = F.when(treatment == 1, numerator / denominator).when(
        treatment == 0, (F.lit(1.0) - numerator) / (F.lit(1.0) - denominator)
    )
    return ratio if applies is None else F.when(applies, ratio).otherwise(F.lit(1.0))


def censor_weight(numerator: Column, denominator: Column) -> Column:
    """Ratio of staying probabilities; a missing one counts as 1."""
    return F.coalesce(numerator, F.lit(1.0)) / F.coalesce(denominator, F.lit(1.0))


def visit_weights(
    panel: DataFrame,
    spec: PanelSpec,
    fits: Mapping[str, LogitFit],
    eligible_wts: Mapping[int, str] | None = None,
    name: str = "wt",
) -> DataFrame:
    """Add the weight of each visit.

    ``eligible_wts`` maps a stratum (previous treatment) to a flag column; rows of
    that stratum with flag 0 get switch weight 1. Without switch models every switch
    weight is 1.
    """
    prev = F.col(spec.prev_treatment)

    def by_stratum(kind: str) -> Column:
        return F.when(prev == 0, predict(fits[f"{kind}0"])).when(prev == 1, predict(fits[f"{kind}1"]))

    applies = None
    if eligible_wts:
        applies = F.lit(True)
        for stratum, flag in eligible_wts.items():
            applies = applies & ~((prev == stratum) & (F.col(flag) == 0))
    if "switch_d0" in fits:
        wt = row_weight(F.col(spec.treatment), by_stratum("switch_n"), by_stratum("switch_d"), applies)
    else:
        wt = F.lit(1.0)
    if "censor_d" in fits:
        wt = wt * censor_weight(predict(fits["censor_n"]), predict(fits["censor_d"]))
    elif "censor_d0" in fits:
        wt = wt * censor_weight(by_stratum("censor_n"), by_stratum("censor_d"))
    return panel.withColumn(name, wt)


def cum_weight(
    df: DataFrame, spec: PanelSpec, weight: str = "wt", name: str = "cum_weight", keep_missing: bool = False
) -> DataFrame:
    """Running product of visit weights by person, in visit order.

    Rows without a weight are dropped, or stay with a NULL product (``keep_missing``, for
    a panel whose trials are emulated next); the product passes over them. The first visit keeps its own ratio;
    it cancels once weights are taken relative to the start of a trial.
    """
    known, running = F.col(weight).isNotNull(), F.product(F.col(weight)).over(spec.so_far())
    if keep_missing:
        return df.withColumn(name, F.when(known, running))
    return df.filter(known).withColumn(name, running)


def ip_weights(
    panel: DataFrame,
    spec: PanelSpec,
    fits: Mapping[str, LogitFit],
    eligible_wts: Mapping[int, str] | None = None,
    keep_missing: bool = False,
) -> DataFrame:
    """Visit weights and their running product."""
    return cum_weight(visit_weights(panel, spec, fits, eligible_wts), spec, keep_missing=keep_missing)


def start_weight(weights: DataFrame, spec: PanelSpec) -> DataFrame:
    """Cumulative weight at the start of a trial, keyed ``(id, trial_period)``."""
    return weights.select(
        F.col(spec.id).alias("id"),
        F.col(spec.period).alias("trial_period"),
        F.col("cum_weight").alias("start_weight"),
    )


def trial_weights(weights: DataFrame, spec: PanelSpec) -> DataFrame:
    """Weight of every possible trial row: cumulative weight now over that at its start.

    Keyed ``(id, trial_period, followup_time)``; equal to 1 at follow-up 0.
    """
    now = weights.select(
        F.col(spec.id).alias("id"),
        F.explode(F.sequence(F.lit(0), F.col(spec.period))).alias("trial_period"),
        F.col(spec.period).alias("_t"),
        "cum_weight",
    )
    return now.join(start_weight(weights, spec), ["id", "trial_period"]).select(
        "id",
        "trial_period",
        (F.col("_t") - F.col("trial_period")).alias("followup_time"),
        (F.col("cum_weight") / F.col("start_weight")).alias("weight"),
    )


def attach_weights(expanded: DataFrame, weights: DataFrame) -> DataFrame:
    """Put new weights on an expansion made earlier; every expanded row stays."""
    keys = ["id", "trial_period", "followup_time"]
    return expanded.drop("weight").join(weights.select(*keys, "weight"), keys, "left")


def resample_weight(weight: Column, count: Column) -> Column:
    """Weight times number of draws; 0 for a person not drawn."""
    return F.when(count != 0, weight * count).otherwise(F.lit(0.0))


def single_trial(
    panel: DataFrame,
    spec: PanelSpec,
    fits: Mapping[str, LogitFit],
    baseline: Sequence[str] = (),
) -> DataFrame:
    """Table of the traditional single-trial model.

    Persons with no treatment before their first visit, covariates frozen at that
    visit, weights accumulated from the second visit on (the first is 1), and the
    running count of treated visits ``CA``. From a visit without a weight on, the
    accumulated weight is NULL.
    """
    first = F.row_number().over(spec.person()) == 1
    weighted = visit_weights(panel, spec, fits).withColumn("wt", F.when(first, 1.0).otherwise(F.col("wt")))
    out = weighted.withColumns(
        {
            "weight": F.when(~F.max(F.col("wt").isNull()).over(spec.so_far()), F.product("wt").over(spec.so_far())),
            "CA": F.sum(spec.treatment).over(spec.so_far()),
            "_start": F.first("CAp").over(spec.so_far()),
            **{c: F.first(c).over(spec.so_far()) for c in baseline},
        }
    )
    return out.filter("_start = 0").drop("_start", "wt")


def weight_summary(df: DataFrame, by: Sequence[str] = ("assigned_treatment",), weight: str = "weight") -> DataFrame:
    """Minimum, quartiles, mean and maximum of the weights per group."""
    simple = df.groupBy(*by).agg(
        F.min(weight).alias("minimum"), F.avg(weight).alias("mean"), F.max(weight).alias("maximum")
    )
    quartiles = quantile_table(df, by, weight, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return simple.join(quartiles, list(by)).select(*by, "minimum", "q1", "mean", "median", "q3", "maximum")


def weight_moments(df: DataFrame, by: Sequence[str], weight: str = "weight") -> DataFrame:
    """Mean, SD and maximum of the weights per scenario."""
    return df.groupBy(*by).agg(
        F.avg(weight).alias("mean"), F.stddev_samp(weight).alias("sd"), F.max(weight).alias("maximum")
    )


def weight_tails(df: DataFrame, by: Sequence[str] = (), weight: str = "weight", share: float = 0.01) -> DataFrame:
    """Lower and upper tail quantiles of the weights."""
    return quantile_table(df, by, weight, {"lower": share, "upper": 1.0 - share})
