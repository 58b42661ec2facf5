"""Queries over weights, regression, standardisation, resampling and intervals.

Models with a saturated design have closed-form fits (group means), which SQL can
check; the same code fits any other design.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from emulant.functions.kernel import positive_definite
from emulant.functions.design import Design, Level, Term, cell_terms, linear_time_terms, visit_terms
from emulant.operators import gcomp as G
from emulant.operators import intervals as I
from emulant.operators import regression as M
from emulant.operators import resample as R
from emulant.operators import scenarios as X
from emulant.operators import trials as E
from emulant.operators import weights as W
from emulant.plans import sql as Q
from emulant.plans.analysis import STATUS, Plan, TrialAnalysis
from emulant.plans.queries_panel import COVARIATES, SPEC, VISITS, censored_panel, panel, trial_rows
from emulant.plans.registry import query, rounded
from emulant.session import new_table_path
from emulant.sources import adapters as S
from emulant.sources import tables as IO
from emulant.spec import PanelSpec

SEGMENT_CELLS = cell_terms(("c_mktsegment", S.SEGMENTS))
OUTCOME_CELLS = cell_terms(("assigned_treatment", (0, 1)), ("followup_time", range(VISITS)))
SATURATED = Plan(SPEC, W.WeightDesigns(SEGMENT_CELLS), OUTCOME_CELLS, COVARIATES)
REGRESSION = Plan(
    SPEC,
    W.WeightDesigns(Design.of("X2", "X4")),
    visit_terms(VISITS, ["X2", "X4"]),
    COVARIATES,
    drop_order=("t_4A", "t_3A"),
)
EVENT_PLAN = Plan(
    PanelSpec(visits=3),
    W.WeightDesigns(cell_terms(("first", (0, 1)))),
    cell_terms(("assigned_treatment", (0, 1)), ("followup_time", range(3))),
    ("X2",),
)
REPLICATES, SEED = 20, 11
DRAWS = 500

_WEIGHTED = f"WITH {Q.PANEL} {Q.WEIGHTED}"
_CURVE = f"{_WEIGHTED} {Q.CELLS}"
_CURVE_COLUMNS = """followup_time, round(survival_treatment, 6) AS survival_treatment, round(survival_control, 6) AS survival_control,
    round(survival_difference, 6) AS survival_difference, round(survival_ratio, 6) AS survival_ratio, round(mrd, 6) AS mrd"""
_DIRECT = f"{_CURVE} {Q.draws(REPLICATES, SEED)} {Q.REFIT_WEIGHTS} {Q.REPLICATE_ROWS} {Q.REFIT_CELLS} {Q.REPLICATE_CURVES}"
_LEF_OUTCOME = f"{_CURVE} {Q.draws(REPLICATES, SEED)} {Q.REFIT_WEIGHTS} {Q.REPLICATE_ROWS} {Q.STEP_CELLS} {Q.REPLICATE_CURVES}"
_LEF_BOTH = f"{_CURVE} {Q.draws(REPLICATES, SEED)} {Q.STEP_WEIGHTS} {Q.REPLICATE_ROWS} {Q.STEP_CELLS} {Q.REPLICATE_CURVES}"
_JACKKNIFE = (
    f"WITH {Q.EVENT_PANEL} {Q.WEIGHTED} {Q.CELLS} {Q.leave_one_out()} {Q.REFIT_WEIGHTS} {Q.REPLICATE_ROWS}"
    f" {Q.REFIT_CELLS} {Q.REPLICATE_CURVES}"
)
_REGRESSION = f"WITH {Q.PANEL} {Q.weighted_by(Design.of('X2', 'X4'))} {Q.outcome_by(REGRESSION.outcome)}"
_LIMITS = "followup_time, round(quantile_cont(mrd, 0.025), 6) AS lb, round(quantile_cont(mrd, 0.975), 6) AS ub"


def weighted_rows(spark, folder):
    """Trial rows weighted by saturated switch models."""
    return TrialAnalysis(panel(spark, folder), SATURATED).expanded


def event_rows(spark, folder):
    return S.event_panel(spark, folder).filter("t <= 2").withColumn("first", F.when(F.col("t") == 0, 0).otherwise(1))


# ---- weights ----------------------------------------------------------------


@query(
    "switch_models",
    f"""WITH {Q.PANEL}, d AS (SELECT Ap, c_mktsegment, avg(A) AS p, count(*) AS n FROM panel GROUP BY 1, 2),
    m AS (SELECT Ap, avg(A) AS p, count(*) AS n FROM panel GROUP BY 1)
    SELECT 'switch_d' || Ap AS model, 'c_mktsegment=' || c_mktsegment AS term, round(ln(p / (1 - p)), 5) AS estimate,
      round(1 / sqrt(n * p * (1 - p)), 5) AS std_error FROM d
    UNION ALL SELECT 'switch_n' || Ap, '(Intercept)', round(ln(p / (1 - p)), 5), round(1 / sqrt(n * p * (1 - p)), 5) FROM m""",
)
def switch_models(spark, folder):
    fits = W.fit_switch_models(panel(spark, folder), SPEC, SEGMENT_CELLS)
    return rounded(M.tidy(spark, fits), 5)


_CENSOR_SPEC = PanelSpec(visits=VISITS, censor="C")


@query(
    "censor_models",
    f"""WITH {Q.CENSORED}, d AS (SELECT Ap, c_mktsegment, avg(1 - C) AS p FROM panel GROUP BY 1, 2),
    m AS (SELECT Ap, avg(1 - C) AS p FROM panel GROUP BY 1)
    SELECT 'censor_d' || Ap AS model, 'c_mktsegment=' || c_mktsegment AS term, round(ln(p / (1 - p)), 4) AS estimate FROM d
    UNION ALL SELECT 'censor_n' || Ap, '(Intercept)', round(ln(p / (1 - p)), 4) FROM m""",
)
def censor_models(spark, folder):
    fits = W.fit_censor_models(censored_panel(spark, folder), _CENSOR_SPEC, SEGMENT_CELLS)
    return rounded(M.tidy(spark, fits).drop("std_error"), 4)


@query(
    "pooled_censor_models",
    f"""WITH {Q.CENSORED}, d AS (SELECT c_mktsegment, avg(1 - C) AS p FROM panel GROUP BY 1), m AS (SELECT avg(1 - C) AS p FROM panel)
    SELECT 'censor_d' AS model, 'c_mktsegment=' || c_mktsegment AS term, round(ln(p / (1 - p)), 4) AS estimate FROM d
    UNION ALL SELECT 'censor_n', '(Intercept)', round(ln(p / (1 - p)), 4) FROM m""",
)
def pooled_censor_models(spark, folder):
    fits = W.fit_censor_models(censored_panel(spark, folder), _CENSOR_SPEC, SEGMENT_CELLS, pooled=True)
    return rounded(M.tidy(spark, fits).drop("std_error"), 4)


# Coefficients used where a query scores rows with given models.
GIVEN = {
    "switch_d0": (Design.of("X2", "X4"), (-0.2, 0.01, 0.002)),
    "switch_n0": (Design.of(), (-0.15,)),
    "switch_d1": (Design.of("X2", "X4"), (0.1, -0.03, 0.005)),
    "switch_n1": (Design.of(), (-0.2,)),
}
GIVEN_OUTCOME = (
    Design.of("X2", "X4", "assigned_treatment", Term("t_1", (Level("followup_time", 1),))),
    (-2.4, 0.02, -0.01, 1.1, 0.15),
)


def _given(design, coef):
    return M.LogitFit(design, np.array(coef), np.zeros((len(design), len(design))))


def given_fits():
    return {name: _given(d, c) for name, (d, c) in GIVEN.items()}


_SCORED = f"""WITH {Q.PANEL}, scored AS (SELECT *, 1 / (1 + exp(-(-0.2 + 0.01 * X2 + 0.002 * X4))) AS d0, 1 / (1 + exp(0.15)) AS n0,
    1 / (1 + exp(-(0.1 - 0.03 * X2 + 0.005 * X4))) AS d1, 1 / (1 + exp(0.2)) AS n1 FROM panel),
  vw AS (SELECT *, CASE WHEN Ap = 0 AND A = 1 THEN n0 / d0 WHEN Ap = 0 AND A = 0 THEN (1 - n0) / (1 - d0)
    WHEN Ap = 1 AND A = 1 THEN n1 / d1 WHEN Ap = 1 AND A = 0 THEN (1 - n1) / (1 - d1) END AS wt FROM scored)"""


@query("scored_with_given_models", f"{_SCORED} SELECT id, t, round(d0, 6) AS p_switch_d0, round(n0, 6) AS p_switch_n0, round(d1, 6) AS p_switch_d1, round(n1, 6) AS p_switch_n1 FROM scored")
def scored_with_given_models(spark, folder):
    out = W.score(panel(spark, folder), given_fits())
    return rounded(out.select("id", "t", *[f"p_{n}" for n in GIVEN]))


@query("visit_weights", f"{_SCORED} SELECT id, t, round(wt, 6) AS wt FROM vw")
def visit_weights(spark, folder):
    return rounded(W.visit_weights(panel(spark, folder), SPEC, given_fits()).select("id", "t", "wt"))


@query(
    "visit_weights_of_eligible",
    f"{_SCORED} SELECT id, t, round(CASE WHEN Ap = 1 AND eligible = 0 THEN 1 ELSE wt END, 6) AS wt FROM vw",
)
def visit_weights_of_eligible(spark, folder):
    """Switch weights only where the visit is eligible for weighting (stratum 1)."""
    out = W.visit_weights(panel(spark, folder), SPEC, given_fits(), {1: "eligible"})
    return rounded(out.select("id", "t", "wt"))


@query(
    "censor_adjusted_weights",
    f"""WITH {Q.CENSORED}, m AS (SELECT *, avg(A) OVER s AS pd, avg(A) OVER (PARTITION BY Ap) AS pn, avg(1 - C) OVER s AS cd,
      avg(1 - C) OVER (PARTITION BY Ap) AS cn FROM panel WINDOW s AS (PARTITION BY Ap, c_mktsegment))
    SELECT id, t, round(CASE WHEN A = 1 THEN pn / pd ELSE (1 - pn) / (1 - pd) END * cn / cd, 6) AS wt FROM m""",
)
def censor_adjusted_weights(spark, folder):
    rows = censored_panel(spark, folder)
    fits = W.fit_weight_models(rows, _CENSOR_SPEC, W.WeightDesigns(SEGMENT_CELLS, censor_d=SEGMENT_CELLS))
    return rounded(W.visit_weights(rows, _CENSOR_SPEC, fits).select("id", "t", "wt"))


@query(
    "weights_with_missing_probability",
    f"""{_SCORED}, k AS (SELECT * FROM vw WHERE NOT (CAp = 2)) SELECT id, t, round(product(wt) OVER (PARTITION BY id ORDER BY t), 6)
    AS cum_weight FROM k""",
)
def weights_with_missing_probability(spark, folder):
    """Rows without a weight are dropped before weights accumulate."""
    rows = panel(spark, folder).withColumn("X2", F.when(F.col("CAp") != 2, F.col("X2")))
    fits = given_fits()
    return rounded(W.ip_weights(rows, SPEC, fits).select("id", "t", "cum_weight"))


@query("cumulative_weights", f"{_SCORED} SELECT id, t, round(product(wt) OVER (PARTITION BY id ORDER BY t), 6) AS cum_weight FROM vw")
def cumulative_weights(spark, folder):
    return rounded(W.ip_weights(panel(spark, folder), SPEC, given_fits()).select("id", "t", "cum_weight"))


_CUM = f"{_SCORED}, cum AS (SELECT id, t, product(wt) OVER (PARTITION BY id ORDER BY t) AS cw FROM vw)"


@query("weights_at_trial_start", f"{_CUM} SELECT id, t AS trial_period, round(cw, 6) AS start_weight FROM cum")
def weights_at_trial_start(spark, folder):
    return rounded(W.start_weight(W.ip_weights(panel(spark, folder), SPEC, given_fits()), SPEC))


@query(
    "weights_of_possible_trials",
    f"{_CUM} SELECT a.id, b.t AS trial_period, a.t - b.t AS followup_time, round(a.cw / b.cw, 6) AS weight FROM cum a JOIN cum b ON a.id = b.id AND b.t <= a.t",
)
def weights_of_possible_trials(spark, folder):
    return rounded(W.trial_weights(W.ip_weights(panel(spark, folder), SPEC, given_fits()), SPEC))


@query(
    "reweighted_expansion",
    f"""{_CUM} {Q.TRIALS} SELECT pp.id, trial_period, followup_time, outcome, round(a.cw / b.cw, 6) AS weight FROM pp
    JOIN cum a ON a.id = pp.id AND a.t = pp.now JOIN cum b ON b.id = pp.id AND b.t = pp.trial_period""",
)
def reweighted_expansion(spark, folder):
    """New weights joined to an expansion made before."""
    weights = W.trial_weights(W.ip_weights(panel(spark, folder), SPEC, given_fits()), SPEC)
    rows = trial_rows(spark, folder).select("id", "trial_period", "followup_time", "outcome")
    return rounded(W.attach_weights(rows, weights))


@query("weighted_trials", f"{_WEIGHTED} SELECT id, trial_period, followup_time, outcome, round(weight, 6) AS weight FROM wpp")
def weighted_trials(spark, folder):
    """Per-protocol trials with saturated switch weights, in one pass over the person."""
    rows = weighted_rows(spark, folder)
    return rounded(rows.select("id", "trial_period", "followup_time", "outcome", "weight"))


@query(
    "resample_weights",
    f"""{_WEIGHTED} {Q.draws(3, 7)} SELECT rep, id, trial_period, followup_time, n::BIGINT AS n,
    round(CASE WHEN n <> 0 THEN weight * n ELSE 0 END, 6) AS weight FROM wpp JOIN counts USING (id)""",
)
def resample_weights(spark, folder):
    """Weights times counts of three replicates; persons carry their draws until rows are asked for."""
    rows = weighted_rows(spark, folder)
    carried = R.attach_draws(rows, R.sparse_counts(rows, 3, 7))
    out = R.unfold(carried, 3).withColumn("weight", W.resample_weight(F.col("weight"), F.col("n")))
    return rounded(out.select("rep", "id", "trial_period", "followup_time", "n", "weight"))


@query(
    "resampled_weight_totals",
    f"""{_WEIGHTED} {Q.draws(50, 7)} SELECT rep, round(sum(weight * n), 4) AS total, round(sum(weight * n * outcome) / sum(weight * n), 6) AS event_share
    FROM wpp JOIN counts USING (id) GROUP BY 1""",
)
def resampled_weight_totals(spark, folder):
    """Sums over fifty replicates from the lists of draws: a row meets only the replicates that drew its person."""
    rows = weighted_rows(spark, folder).select("id", "outcome", "weight")
    met = R.attach_draws(rows, R.sparse_counts(rows, 50, 7)).withColumn("rep", F.explode("drawn"))
    w = F.sum("weight")
    out = met.groupBy("rep").agg(w.alias("total"), (F.sum(F.col("weight") * F.col("outcome")) / w).alias("event_share"))
    return out.select("rep", F.round("total", 4).alias("total"), F.round("event_share", 6).alias("event_share"))


@query(
    "merged_replicate_weights",
    f"""{_CUM} {Q.TRIALS} {Q.draws(1, 7)}, c AS (SELECT id, n FROM drawn) SELECT pp.id, trial_period, followup_time, 1.0::DOUBLE AS old_weight,
    round(a.cw / b.cw, 6) AS new_weight, coalesce(n, 0)::BIGINT AS n,
    round(CASE WHEN coalesce(n, 0) <> 0 THEN a.cw / b.cw * n ELSE 0 END, 6) AS weight
    FROM pp JOIN cum a ON a.id = pp.id AND a.t = pp.now JOIN cum b ON b.id = pp.id AND b.t = pp.trial_period LEFT JOIN c ON c.id = pp.id""",
)
def merged_replicate_weights(spark, folder):
    """Weights, expansion and counts of one replicate merged by key."""
    rows = trial_rows(spark, folder).select("id", "trial_period", "followup_time", F.lit(1.0).alias("weight"))
    weights = W.trial_weights(W.ip_weights(panel(spark, folder), SPEC, given_fits()), SPEC)
    counts = R.bootstrap_counts(rows, 1, 7).select("id", "n")
    return rounded(X.merge_weights(weights, rows, counts))


@query(
    "model_counts",
    f"""WITH {Q.PANEL} {Q.TRIALS} {Q.draws(2, 7)} SELECT rep, id, t, A, n FROM panel JOIN drawn USING (id) WHERE Ap = 0""",
)
def model_counts(spark, folder):
    """Rows of one stratum of drawn persons with the number of draws."""
    counts = R.bootstrap_counts(trial_rows(spark, folder), 2, 7)
    return panel(spark, folder).filter("Ap = 0").join(counts, "id").select("rep", "id", "t", "A", "n")


@query(
    "weight_summary",
    f"""{_WEIGHTED} SELECT assigned_treatment, round(min(weight), 6) AS minimum, round(quantile_cont(weight, 0.25), 6) AS q1,
    round(avg(weight), 6) AS mean, round(median(weight), 6) AS median, round(quantile_cont(weight, 0.75), 6) AS q3,
    round(max(weight), 6) AS maximum FROM wpp GROUP BY 1""",
)
def weight_summary(spark, folder):
    return rounded(W.weight_summary(weighted_rows(spark, folder)))


@query(
    "weight_moments",
    f"{_WEIGHTED} SELECT c_mktsegment, round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS sd, round(max(weight), 6) AS maximum FROM wpp GROUP BY 1",
)
def weight_moments(spark, folder):
    return rounded(W.weight_moments(weighted_rows(spark, folder), ["c_mktsegment"]))


@query("weight_tails", f"{_WEIGHTED} SELECT round(quantile_cont(weight, 0.01), 6) AS lower, round(quantile_cont(weight, 0.99), 6) AS upper FROM wpp")
def weight_tails(spark, folder):
    return rounded(W.weight_tails(weighted_rows(spark, folder)))


@query(
    "single_trial_rows",
    f"""{_SCORED}, s AS (SELECT *, row_number() OVER p AS r, first_value(CAp) OVER p AS c0, first_value(X2) OVER p AS base,
      sum(A) OVER p AS "CA" FROM vw WINDOW p AS (PARTITION BY id ORDER BY t))
    SELECT id, t, Y, "CA"::BIGINT AS "CA", round(base, 6) AS "X2", round(product(CASE WHEN r = 1 THEN 1 ELSE wt END)
      OVER (PARTITION BY id ORDER BY t), 6) AS weight FROM s WHERE c0 = 0""",
)
def single_trial_rows(spark, folder):
    out = W.single_trial(panel(spark, folder), SPEC, given_fits(), ["X2"])
    return rounded(out.select("id", "t", "Y", "CA", "X2", "weight"))


_SINGLE = Design.of("CA", "X2", "X4", ("CA", "X2"))


def _tidied(design: Design, source: str, digits: int, error: str, drop: tuple[str, ...] = ()) -> str:
    """Terms with estimate and standard error; NULL where the fit left a term out, no row where it is one of ``drop``."""
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(design.names))
    gone = "".join(f" AND NOT (term = '{d}' AND cov[t.i + 1][t.i + 1] = 0)" for d in drop)
    kept = "CASE WHEN cov[t.i + 1][t.i + 1] > 0 THEN round({}, {}) END"
    return (
        f"term, {kept.format('b[t.i + 1]', digits)} AS estimate, {kept.format(error, digits)} AS std_error "
        f"FROM {source}, (VALUES {names}) t(i, term) WHERE true{gone}"
    )


@query(
    "single_trial_model",
    f"""{_SCORED}, s AS (SELECT *, row_number() OVER p AS r, first_value(CAp) OVER p AS c0, first_value(X2) OVER p AS b2,
      first_value(X4) OVER p AS b4, sum(A) OVER p AS "CA" FROM vw WINDOW p AS (PARTITION BY id ORDER BY t)),
    k AS (SELECT Y, "CA"::DOUBLE AS "CA", b2 AS X2, b4 AS X4, product(CASE WHEN r = 1 THEN 1 ELSE wt END) OVER (PARTITION BY id ORDER BY t) AS weight
      FROM s WHERE c0 = 0)
    {Q.logit("st", f"SELECT 0 AS g, {Q.design_list(_SINGLE)} AS x, Y AS y, weight AS w FROM k", len(_SINGLE))}
    SELECT 'single_trial' AS model, {_tidied(_SINGLE, "st", 6, "sqrt(cov[t.i + 1][t.i + 1])")}""",
)
def single_trial_model(spark, folder):
    """Weighted model of the traditional single-trial analysis."""
    rows = W.single_trial(panel(spark, folder), SPEC, given_fits(), ["X2", "X4"])
    return rounded(M.tidy(spark, {"single_trial": M.fit_logit(rows, _SINGLE, "Y", "weight")}))


# ---- regression ---------------------------------------------------------------

_CELL_NAME = "'assigned_treatment=' || assigned_treatment || ':followup_time=' || followup_time"


@query(
    "outcome_cells",
    f"""{_CURVE} SELECT {_CELL_NAME} AS term, round(ln(p / (1 - p)), 5) AS estimate,
    round(1 / sqrt(sw * p * (1 - p)), 5) AS std_error FROM cell""",
)
def outcome_cells(spark, folder):
    """Weighted outcome model with a saturated design."""
    fit = M.fit_logit(weighted_rows(spark, folder), OUTCOME_CELLS, "outcome", "weight")
    return rounded(M.tidy(spark, {"outcome": fit}).drop("model"), 5)


@query(
    "outcome_covariance",
    f"""{_CURVE}, v AS (SELECT {_CELL_NAME} AS term, 1 / (sw * p * (1 - p)) AS v FROM cell)
    SELECT a.term AS term_i, b.term AS term_j, round(CASE WHEN a.term = b.term THEN a.v ELSE 0 END, 5) AS value FROM v a, v b""",
)
def outcome_covariance(spark, folder):
    fit = M.fit_logit(weighted_rows(spark, folder), OUTCOME_CELLS, "outcome", "weight")
    return rounded(M.covariance_rows(spark, {"outcome": (fit.design, fit.vcov)}).drop("model"), 5)


@query(
    "robust_covariance",
    f"""{_CURVE}, sc AS (SELECT id, {_CELL_NAME} AS term, sum(weight * (outcome - p)) AS s FROM wpp
      JOIN cell USING (assigned_treatment, followup_time) GROUP BY 1, 2),
    inf AS (SELECT {_CELL_NAME} AS term, sw * p * (1 - p) AS d FROM cell),
    m AS (SELECT a.term AS term_i, b.term AS term_j, sum(a.s * b.s) AS m FROM sc a JOIN sc b USING (id) GROUP BY 1, 2),
    n AS (SELECT count(DISTINCT id) AS n FROM wpp)
    SELECT x.term AS term_i, y.term AS term_j, round(coalesce(m, 0) / (x.d * y.d) * n / (n - 1), 5) AS value
    FROM inf x CROSS JOIN inf y CROSS JOIN n LEFT JOIN m ON m.term_i = x.term AND m.term_j = y.term""",
)
def robust_covariance(spark, folder):
    """Covariance with scores added up per person."""
    rows = weighted_rows(spark, folder)
    fit = M.fit_logit(rows, OUTCOME_CELLS, "outcome", "weight")
    robust = M.sandwich(rows, fit, "outcome", "weight")
    return rounded(M.covariance_rows(spark, {"outcome": (fit.design, robust)}).drop("model"), 5)


@query(
    "aliased_terms",
    f"""{_CURVE} SELECT {_CELL_NAME} AS term, round(ln(p / (1 - p)), 5) AS estimate FROM cell
    UNION ALL SELECT 't_1A', NULL""",
)
def aliased_terms(spark, folder):
    """A term that repeats earlier ones gets no coefficient; the others are unchanged."""
    design = Design.of(
        *OUTCOME_CELLS.terms, Term("t_1A", (Level("followup_time", 1), Level("assigned_treatment", 1))), intercept=False
    )
    fit = M.fit_logit(weighted_rows(spark, folder), design, "outcome", "weight", drop_order=("t_1A",))
    return rounded(M.tidy(spark, {"outcome": fit}).select("term", "estimate"), 5)


@query(
    "outcome_regression",
    f"""{_REGRESSION} {Q.robust_by(REGRESSION.outcome)} SELECT 'outcome' AS model,
    {_tidied(REGRESSION.outcome, "oc", 5, "sqrt((SELECT v FROM rv WHERE rv.i = t.i AND rv.j = t.i))", REGRESSION.drop_order)}""",
)
def outcome_regression(spark, folder):
    """Pooled logistic model with visit dummies and their interactions."""
    with TrialAnalysis(panel(spark, folder), REGRESSION) as a:
        return rounded(M.tidy(spark, {"outcome": a.fit}, {"outcome": a.robust}), 5)


_LINEAR = linear_time_terms(["X2", "X4"])


@query(
    "outcome_regression_linear_time",
    f"""{_WEIGHTED} {Q.outcome_by(_LINEAR)} SELECT 'outcome' AS model, {_tidied(_LINEAR, "oc", 5, "sqrt(cov[t.i + 1][t.i + 1])")}""",
)
def outcome_regression_linear_time(spark, folder):
    """Pooled logistic model with linear and squared follow-up time."""
    rows = weighted_rows(spark, folder)
    fit = M.fit_logit(rows, _LINEAR, "outcome", "weight")
    return rounded(M.tidy(spark, {"outcome": fit}), 5)


_SCENARIO = Design.of("X2", "X4", "assigned_treatment")
_SCENARIO_ROWS = f"""WITH {Q.PANEL} {Q.TRIALS}, sc AS (SELECT *, (id % 27 + 1)::INTEGER AS scenario FROM pp)"""


def _scenarios(spark, folder):
    return trial_rows(spark, folder).withColumn("scenario", (F.col("id") % 27 + 1).cast("int"))


@query(
    "scenario_regressions",
    f"""{_SCENARIO_ROWS} {Q.logit("sf", f"SELECT scenario AS g, {Q.design_list(_SCENARIO)} AS x, outcome AS y, 1.0 AS w FROM sc", len(_SCENARIO))},
    sn AS (SELECT scenario AS g, count(*) AS n FROM sc GROUP BY 1)
    SELECT g AS scenario, term, round(b[i + 1], 5) AS estimate, round(sqrt(cov[i + 1][i + 1]), 5) AS std_error, n, false AS separated, true AS converged
    FROM sf JOIN sn USING (g), (VALUES (0, '(Intercept)'), (1, 'X2'), (2, 'X4'), (3, 'assigned_treatment')) t(i, term)""",
)
def scenario_regressions(spark, folder):
    """Outcome models of all 27 scenarios in the same passes."""
    return rounded(M.fit_groups(_scenarios(spark, folder), ["scenario"], _SCENARIO, "outcome").tidy(spark), 5)


_SCENARIO_CELLS = cell_terms(("assigned_treatment", (0, 1)))


@query(
    "scenario_visit_hazards",
    f"""{_SCENARIO_ROWS}, c AS (SELECT scenario, followup_time, assigned_treatment AS a, count(*) AS n, avg(outcome) AS p FROM sc GROUP BY ALL),
    k AS (SELECT scenario, followup_time, sum(n)::BIGINT AS n, bool_or(p = 0 OR p = 1) AS separated FROM c GROUP BY ALL),
    x AS (SELECT k.*, a.a, c.p, c.n AS own FROM k CROSS JOIN range(2) a(a) LEFT JOIN c ON c.scenario = k.scenario AND c.followup_time = k.followup_time AND c.a = a.a)
    SELECT scenario, followup_time, 'assigned_treatment=' || a AS term, CASE WHEN NOT separated THEN round(ln(p / (1 - p)), 5) END AS estimate,
      CASE WHEN NOT separated THEN round(1 / sqrt(own * p * (1 - p)), 5) END AS std_error, n, separated, true AS converged FROM x""",
)
def scenario_visit_hazards(spark, folder):
    """Hazard of each arm by scenario and visit, 135 groups at once; arms without events are told as separated."""
    fits = M.fit_groups(_scenarios(spark, folder), ["scenario", "followup_time"], _SCENARIO_CELLS, "outcome")
    return rounded(fits.tidy(spark), 5)


@query(
    "fit_statistics",
    f"""WITH {Q.PANEL}, m AS (SELECT Ap, c_mktsegment, avg(A) AS p, count(*) AS n FROM panel GROUP BY 1, 2),
    l AS (SELECT Ap, sum(n)::BIGINT AS n, -2 * sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) AS dev FROM m GROUP BY 1),
    z AS (SELECT Ap, avg(A) AS p, count(*) AS n FROM panel GROUP BY 1)
    SELECT 'switch_d' || Ap AS model, l.n, round(dev, 4) AS deviance, round(-2 * z.n * (p * ln(p) + (1 - p) * ln(1 - p)), 4)
    AS null_deviance, round(-dev / 2, 4) AS log_lik, round(dev + 10, 4) AS aic FROM l JOIN z USING (Ap)""",
)
def fit_statistics(spark, folder):
    fits = W.fit_switch_models(panel(spark, folder), SPEC, SEGMENT_CELLS)
    out = M.glance(spark, {n: f for n, f in fits.items() if "_d" in n})
    return rounded(out.select("model", "n", "deviance", "null_deviance", "log_lik", "aic"), 4)


_GIVEN_ETA = "-2.4 + 0.02 * X2 - 0.01 * X4 + 1.1 * {a} + CASE WHEN {k} = 1 THEN 0.15 ELSE 0 END"
_GIVEN_P = "1 / (1 + exp(-(" + _GIVEN_ETA + ")))"


def _given_p(a: str, k: str = "followup_time") -> str:
    return _GIVEN_P.format(a=a, k=k)


@query(
    "predicted_probabilities",
    f"WITH {Q.PANEL} {Q.TRIALS} SELECT id, trial_period, followup_time, round({_given_p('assigned_treatment')}, 6) AS p FROM pp",
)
def predicted_probabilities(spark, folder):
    rows = trial_rows(spark, folder)
    p = M.predict(_given(*GIVEN_OUTCOME)).alias("p")
    return rounded(rows.select("id", "trial_period", "followup_time", p))


@query(
    "score_per_replicate",
    f"""WITH {Q.PANEL} {Q.TRIALS} {Q.draws(4, 7)}, e AS (SELECT *, outcome - {_given_p('assigned_treatment')} AS e FROM pp)
    SELECT rep, round(sum(n * e), 5) AS "(Intercept)", round(sum(n * e * X2), 5) AS "X2", round(sum(n * e * X4), 5) AS "X4",
    round(sum(n * e * assigned_treatment), 5) AS assigned_treatment, round(sum(CASE WHEN followup_time = 1 THEN n * e ELSE 0 END), 5) AS t_1
    FROM e JOIN counts USING (id) GROUP BY 1""",
)
def score_per_replicate(spark, folder):
    """Score vector of a given model under the counts of each replicate."""
    rows = trial_rows(spark, folder)
    counted = rows.join(R.bootstrap_counts(rows, 4, 7), "id")
    return rounded(M.score_vector(counted, _given(*GIVEN_OUTCOME), "outcome", F.col("n").cast("double"), ["rep"]), 5)


@query(
    "treatment_effect",
    f"""{_WEIGHTED}, m AS (SELECT assigned_treatment AS a, sum(weight * outcome) / sum(weight) AS p FROM wpp GROUP BY 1),
    lor AS (SELECT max(CASE WHEN a = 1 THEN ln(p / (1 - p)) END) - max(CASE WHEN a = 0 THEN ln(p / (1 - p)) END) AS b FROM m)
    SELECT round(b, 5) AS log_odds_ratio, round(exp(b), 5) AS hazard_ratio FROM lor""",
)
def treatment_effect(spark, folder):
    fit = M.fit_logit(weighted_rows(spark, folder), Design.of("assigned_treatment"), "outcome", "weight")
    return rounded(M.treatment_effect(M.tidy(spark, {"outcome": fit})).drop("model"), 5)


@query(
    "treatment_effect_replicates",
    f"""{_DIRECT}, one AS (SELECT rep, assigned_treatment AS a, sum(w * outcome) / sum(w) AS p FROM rr GROUP BY 1, 2)
    SELECT rep, round(max(CASE WHEN a = 1 THEN ln(p / (1 - p)) END) - max(CASE WHEN a = 0 THEN ln(p / (1 - p)) END), 5)
    AS log_odds_ratio FROM one GROUP BY 1""",
)
def treatment_effect_replicates(spark, folder):
    """Treatment coefficient of every bootstrap replicate."""
    plan = Plan(SPEC, W.WeightDesigns(SEGMENT_CELLS), Design.of("assigned_treatment"), COVARIATES)
    with TrialAnalysis(panel(spark, folder), plan) as a:
        coefs = a.bootstrap(REPLICATES, SEED, ("bootstrap",)).coefficients
    rows = coefs.filter("term = 'assigned_treatment'")
    return rounded(rows.select("rep", F.col("estimate").alias("log_odds_ratio")), 5)


@query(
    "model_store_round_trip",
    f"""WITH {Q.PANEL}, d AS (SELECT c_mktsegment, avg(A) AS p FROM panel WHERE Ap = 0 GROUP BY 1)
    SELECT id, t, round(p, 6) AS p FROM panel JOIN d USING (c_mktsegment)""",
)
def model_store_round_trip(spark, folder):
    """Store fitted weight models, load one and score rows with it."""
    rows = panel(spark, folder)
    fits = W.fit_switch_models(rows, SPEC, SEGMENT_CELLS)
    path = new_table_path(spark, "models")
    IO.save_model(M.tidy(spark, fits), M.covariance_rows(spark, {n: (f.design, f.vcov) for n, f in fits.items()}), path)
    fit = M.fit_from_tables(SEGMENT_CELLS, *IO.load_model(spark, path), "switch_d0")
    return rounded(rows.select("id", "t", M.predict(fit).alias("p")))


# ---- standardisation -------------------------------------------------------------

_GRID_CTE = f"""WITH {Q.PANEL} {Q.TRIALS}, base AS (SELECT id, trial_period, X2, X4 FROM pp WHERE followup_time = 0),
  cf AS (SELECT id, trial_period, k.k::INTEGER AS followup_time, X2, X4 FROM base, range(0, 5) k(k) WHERE k.k < 5 - trial_period),
  hz AS (SELECT *, {_given_p('1')} AS ht, {_given_p('0')} AS hc FROM cf),
  sv AS (SELECT *, product(1 - ht) OVER w AS st, product(1 - hc) OVER w AS sc FROM hz
    WINDOW w AS (PARTITION BY id, trial_period ORDER BY followup_time))"""


def _mean_sql(st: str, sc: str) -> str:
    return (
        f"round({st}, 6) AS survival_treatment, round({sc}, 6) AS survival_control, round({st} - {sc}, 6) AS survival_difference,"
        f" round(({st}) / ({sc}), 6) AS survival_ratio, round({sc} - {st}, 6) AS mrd"
    )


@query("prediction_grid", f"{_GRID_CTE} SELECT id, trial_period, followup_time, round(X2, 6) AS \"X2\" FROM cf")
def prediction_grid(spark, folder):
    out = G.prediction_grid(trial_rows(spark, folder), VISITS, None)
    return rounded(out.select("id", "trial_period", "followup_time", "X2"))


@query("filled_down_covariates", f"{_GRID_CTE} SELECT id, trial_period, followup_time, round(X2, 6) AS \"X2\", round(X4, 6) AS \"X4\" FROM cf")
def filled_down_covariates(spark, folder):
    """Grid joined to observed rows, gaps filled from the last known value."""
    rows = trial_rows(spark, folder).select("id", "trial_period", "followup_time", "X2", "X4")
    grid = X.observed_pairs(X.cross_grid(rows, VISITS), rows)
    return rounded(G.fill_down(X.onto_grid(rows, grid), ["X2", "X4"]))


@query("counterfactual_hazards", f"{_GRID_CTE} SELECT id, trial_period, followup_time, round(ht, 6) AS hazard_treatment, round(hc, 6) AS hazard_control FROM hz")
def counterfactual_hazards(spark, folder):
    grid = G.prediction_grid(trial_rows(spark, folder), VISITS, None)
    out = G.predict_arms(grid, _given(*GIVEN_OUTCOME))
    return rounded(out.select("id", "trial_period", "followup_time", "hazard_treatment", "hazard_control"))


@query("cumulative_survival", f"{_GRID_CTE} SELECT id, trial_period, followup_time, round(st, 6) AS survival_treatment, round(sc, 6) AS survival_control FROM sv")
def cumulative_survival(spark, folder):
    grid = G.prediction_grid(trial_rows(spark, folder), VISITS, None)
    out = G.cum_survival(G.predict_arms(grid, _given(*GIVEN_OUTCOME)))
    return rounded(out.select("id", "trial_period", "followup_time", "survival_treatment", "survival_control"))


@query("marginal_curves_all_trials", f"{_GRID_CTE} SELECT followup_time, {_mean_sql('avg(st)', 'avg(sc)')} FROM sv GROUP BY 1")
def marginal_curves_all_trials(spark, folder):
    return rounded(G.marginal_curves(trial_rows(spark, folder), _given(*GIVEN_OUTCOME), VISITS, None))


@query("marginal_curves_first_trial", f"{_GRID_CTE} SELECT followup_time, {_mean_sql('avg(st)', 'avg(sc)')} FROM sv WHERE trial_period = 0 GROUP BY 1")
def marginal_curves_first_trial(spark, folder):
    return rounded(G.marginal_curves(trial_rows(spark, folder), _given(*GIVEN_OUTCOME), VISITS))


def _resampled_sql(divisor: str) -> str:
    st, sc = f"sum(st * n) / {divisor}", f"sum(sc * n) / {divisor}"
    return f"{_GRID_CTE} {Q.draws(1, 7)} SELECT followup_time, {_mean_sql(st, sc)} FROM sv JOIN counts USING (id) WHERE trial_period = 0 GROUP BY 1"


def _resampled(spark, folder, normalise):
    rows = trial_rows(spark, folder)
    counted = R.attach_counts(rows, R.bootstrap_counts(rows, 1, 7), rows)
    return rounded(G.marginal_curves(counted, _given(*GIVEN_OUTCOME), VISITS, count="n", normalise=normalise))


@query("resampled_curves", _resampled_sql("count(*)"))
def resampled_curves(spark, folder):
    """Curves of one bootstrap sample, divided by the number of original persons."""
    return _resampled(spark, folder, "rows")


@query("resampled_curves_by_draws", _resampled_sql("sum(n)"))
def resampled_curves_by_draws(spark, folder):
    return _resampled(spark, folder, "counts")


@query("risk_difference_curve", f"{_CURVE} SELECT {_CURVE_COLUMNS} FROM curve")
def risk_difference_curve(spark, folder):
    """The whole analysis: panel, weights, trials, outcome model, standardisation."""
    return rounded(TrialAnalysis(panel(spark, folder), SATURATED).curve())


@query("risk_difference_regression", f"{_REGRESSION} {Q.curves_by(REGRESSION.outcome, VISITS)} SELECT {_CURVE_COLUMNS} FROM marks")
def risk_difference_regression(spark, folder):
    """The same with regression designs that have no closed form."""
    return rounded(TrialAnalysis(panel(spark, folder), REGRESSION).curve())


_BOTH = Design.of("X2", "X4")


@query(
    "risk_difference_censored",
    f"""WITH {Q.CENSORED} {Q.weighted_by(_BOTH, _BOTH)} {Q.outcome_by(REGRESSION.outcome)} {Q.curves_by(REGRESSION.outcome, VISITS)}
    SELECT {_CURVE_COLUMNS} FROM marks""",
)
def risk_difference_censored(spark, folder):
    """The same with drop-out weights."""
    plan = Plan(_CENSOR_SPEC, W.WeightDesigns(_BOTH, censor_d=_BOTH), REGRESSION.outcome, COVARIATES)
    return rounded(TrialAnalysis(censored_panel(spark, folder), plan).curve())


@query(
    "intention_to_treat_curve",
    f"""WITH {Q.PANEL} {Q.TRIALS}, wpp AS (SELECT *, 1.0 AS weight FROM itt) {Q.CELLS} SELECT {_CURVE_COLUMNS} FROM curve""",
)
def intention_to_treat_curve(spark, folder):
    rows = trial_rows(spark, folder, "ITT")
    return rounded(G.marginal_curves(rows, M.fit_logit(rows, OUTCOME_CELLS, "outcome"), VISITS))


_TREATED_CELLS = cell_terms(("treatment", (0, 1)), ("followup_time", range(VISITS)))
_TREATED = f"""WITH {Q.PANEL} {Q.TRIALS}, tc AS (SELECT treatment, followup_time, count(*) AS n, avg(outcome) AS p FROM itt GROUP BY 1, 2)"""
#: Always, never, and treated at the first two visits only.
STRATEGIES = {"always": (1, 1, 1, 1, 1), "never": (0, 0, 0, 0, 0), "two visits": (1, 1, 0, 0, 0)}


@query(
    "as_treated_model",
    f"""{_TREATED} SELECT 'treatment=' || treatment || ':followup_time=' || followup_time AS term, round(ln(p / (1 - p)), 5) AS estimate,
    round(1 / sqrt(n * p * (1 - p)), 5) AS std_error FROM tc""",
)
def as_treated_model(spark, folder):
    """Outcome model whose treatment follows each row, persons kept in the trial whatever they take."""
    fit = M.fit_logit(trial_rows(spark, folder, "AT"), _TREATED_CELLS, "outcome")
    return rounded(M.tidy(spark, {"outcome": fit}).drop("model"), 5)


@query(
    "as_treated_curves",
    f"""{_TREATED}, st AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {k}, {v})" for n, path in STRATEGIES.items() for k, v in enumerate(path))})
      v(strategy, followup_time, treatment))
    SELECT strategy, followup_time, round(product(1 - p) OVER (PARTITION BY strategy ORDER BY followup_time), 6) AS survival
    FROM st JOIN tc USING (treatment, followup_time)""",
)
def as_treated_curves(spark, folder):
    """Survival under strategies that set the treatment visit by visit."""
    rows = trial_rows(spark, folder, "AT")
    return rounded(G.strategy_curves(rows, M.fit_logit(rows, _TREATED_CELLS, "outcome"), STRATEGIES))


_AT_DESIGN = Design.of("X2", "X4", "treatment", "followup_time", ("treatment", "followup_time"))


@query(
    "as_treated_regression_curves",
    f"""WITH {Q.PANEL} {Q.TRIALS} {Q.logit("oc", f"SELECT 0 AS g, {Q.design_list(_AT_DESIGN)} AS x, outcome AS y, 1.0 AS w FROM itt", len(_AT_DESIGN))},
    st AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {k}, {v})" for n, path in STRATEGIES.items() for k, v in enumerate(path))})
      v(strategy, followup_time, treatment)),
    hz AS (SELECT id, strategy, followup_time, 1 - 1 / (1 + exp(-list_dot_product({Q.design_list(_AT_DESIGN)}, oc.b))) AS s
      FROM (SELECT p.id, p.X2, p.X4, st.* FROM pp p, st WHERE p.trial_period = 0 AND p.followup_time = 0), oc),
    al AS (SELECT *, product(s) OVER (PARTITION BY id, strategy ORDER BY followup_time) AS alive FROM hz)
    SELECT strategy, followup_time, round(avg(alive), 6) AS survival FROM al GROUP BY 1, 2""",
)
def as_treated_regression_curves(spark, folder):
    """The same with a design of continuous covariates, standardised over the persons of the first trial."""
    rows = trial_rows(spark, folder, "AT")
    return rounded(G.strategy_curves(rows, M.fit_logit(rows, _AT_DESIGN, "outcome"), STRATEGIES))


_ITT_PLAN = replace(SATURATED, estimand="ITT")
_ITT = f"WITH {Q.PANEL} {Q.TRIALS}, wpp AS (SELECT *, 1.0 AS weight FROM itt) {Q.CELLS} {Q.draws(REPLICATES, SEED, 'itt')}"


@query(
    "intention_to_treat_limits",
    f"""{_ITT}, rr AS (SELECT c.rep, c.n, itt.*, c.n::DOUBLE AS w FROM itt JOIN counts c USING (id)) {Q.REFIT_CELLS} {Q.REPLICATE_CURVES},
    u AS (UNPIVOT reps ON survival_treatment, survival_control, survival_difference, survival_ratio INTO NAME measure VALUE v)
    SELECT followup_time, measure, round(quantile_cont(v, 0.025), 6) AS lb, round(quantile_cont(v, 0.975), 6) AS ub FROM u GROUP BY 1, 2""",
)
def intention_to_treat_limits(spark, folder):
    """Bootstrap limits of survival, difference and ratio, persons followed whatever they take."""
    with TrialAnalysis(panel(spark, folder), _ITT_PLAN) as a:
        return rounded(I.measure_ci(a.bootstrap(REPLICATES, SEED, ("bootstrap",)).curves))


_MISSING = f"""WITH {Q.HISTORY}, panel AS (SELECT * REPLACE (CASE WHEN id % 11 <> t THEN c_mktsegment END AS c_mktsegment)
    FROM hist WHERE Yp = 0 AND t <= 4) {Q.TRIALS},
  wm AS (SELECT *, avg(A) OVER (PARTITION BY Ap, c_mktsegment) AS pd, avg(A) OVER (PARTITION BY Ap) AS pn FROM panel),
  wv AS (SELECT *, CASE WHEN c_mktsegment IS NOT NULL THEN CASE WHEN A = 1 THEN pn / pd ELSE (1 - pn) / (1 - pd) END END AS wt FROM wm),
  cw AS (SELECT *, CASE WHEN wt IS NOT NULL THEN product(wt) OVER (PARTITION BY id ORDER BY t) END AS cum_weight FROM wv),
  wall AS (SELECT pp.*, a.cum_weight / b.cum_weight AS weight FROM pp
    JOIN cw a ON a.id = pp.id AND a.t = pp.now JOIN cw b ON b.id = pp.id AND b.t = pp.trial_period),
  wpp AS (SELECT * FROM wall WHERE weight IS NOT NULL) {Q.CELLS}"""


def _with_missing(spark, folder):
    return panel(spark, folder).withColumn("c_mktsegment", F.when(F.col("id") % 11 != F.col("t"), F.col("c_mktsegment")))


@query("trials_with_missing_weights", f"{_MISSING} SELECT id, trial_period, followup_time, outcome, round(weight, 6) AS weight FROM wall")
def trials_with_missing_weights(spark, folder):
    """A visit without a weight stays in its trials, with NULL; later visits have the product of the others."""
    with TrialAnalysis(_with_missing(spark, folder), SATURATED) as a:
        return rounded(a.expanded.select("id", "trial_period", "followup_time", "outcome", "weight"))


@query("risk_difference_with_missing_weights", f"{_MISSING} SELECT {_CURVE_COLUMNS} FROM curve")
def risk_difference_with_missing_weights(spark, folder):
    with TrialAnalysis(_with_missing(spark, folder), SATURATED) as a:
        return rounded(a.curve())


_KM_SQL = """last AS (SELECT {by} id, max(t) AS time, arg_max(Y, t) AS status FROM panel GROUP BY ALL),
  pt AS (SELECT {by} time, count(*) AS m, sum(status)::BIGINT AS n_event FROM last GROUP BY ALL),
  ar AS (SELECT *, sum(m) OVER ({part} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS n_risk FROM pt),
  km AS (SELECT *, product(1 - n_event / n_risk) OVER ({part} ORDER BY time) AS survival FROM ar)"""


@query(
    "kaplan_meier",
    f"WITH {Q.PANEL6}, {_KM_SQL.format(by='', part='')} SELECT time, n_risk, n_event, round(survival, 6) AS survival FROM km",
)
def kaplan_meier(spark, folder):
    return rounded(G.km(S.order_panel(spark, folder)))


@query(
    "kaplan_meier_by_segment",
    f"WITH {Q.PANEL6}, {_KM_SQL.format(by='c_mktsegment,', part='PARTITION BY c_mktsegment')} SELECT c_mktsegment, time, n_risk, n_event, round(survival, 6) AS survival FROM km",
)
def kaplan_meier_by_segment(spark, folder):
    return rounded(G.km(S.order_panel(spark, folder), ["c_mktsegment"]))


@query(
    "kaplan_meier_difference",
    f"""WITH {Q.HISTORY}, panel AS (SELECT *, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS arm FROM hist WHERE Yp = 0),
    {_KM_SQL.format(by='arm,', part='PARTITION BY arm')},
    ab AS (SELECT time AS followup_time, max(CASE WHEN arm = 1 THEN survival END) AS st, max(CASE WHEN arm = 0 THEN survival END) AS sc
      FROM km GROUP BY 1) SELECT followup_time, {_mean_sql('st', 'sc')} FROM ab""",
)
def kaplan_meier_difference(spark, folder):
    rows = S.order_panel(spark, folder).withColumn("arm", F.when(F.col("c_acctbal") > 4000, 1).otherwise(0))
    return rounded(G.km_difference(rows, "arm"))


# ---- resampling --------------------------------------------------------------------


@query("bootstrap_counts", f"WITH {Q.PANEL} {Q.TRIALS} {Q.draws(10, 3)} SELECT rep, id, n FROM drawn")
def bootstrap_counts(spark, folder):
    return R.bootstrap_counts(trial_rows(spark, folder), 10, 3)


@query(
    "bootstrap_rows",
    f"""WITH {Q.PANEL} {Q.TRIALS} {Q.draws(2, 3)}, k AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn)
    SELECT rep, id || ':' || copy AS new_id, t, A, Y FROM k JOIN panel USING (id)""",
)
def bootstrap_rows(spark, folder):
    """Copied rows of two bootstrap samples under new ids."""
    counts = R.bootstrap_counts(trial_rows(spark, folder), 2, 3)
    return R.bootstrap_rows(panel(spark, folder), counts).select("rep", "new_id", "t", "A", "Y")


@query("jackknife_counts", f"WITH {Q.PANEL} {Q.TRIALS} {Q.leave_one_out()} SELECT rep, id, n::BIGINT AS n FROM counts WHERE n = 0")
def jackknife_counts(spark, folder):
    return R.jackknife_counts(trial_rows(spark, folder))


# ---- intervals ------------------------------------------------------------------------


def _replicates(spark, folder, method):
    a = TrialAnalysis(panel(spark, folder), SATURATED)
    return a, a.bootstrap(REPLICATES, SEED, (method,)).curves


@query("bootstrap_replicates", f"{_DIRECT} SELECT rep, {_CURVE_COLUMNS} FROM reps")
def bootstrap_replicates(spark, folder):
    """Curves of every direct bootstrap replicate."""
    _, reps = _replicates(spark, folder, "bootstrap")
    return rounded(reps.drop("method", *STATUS))


@query("one_step_outcome_replicates", f"{_LEF_OUTCOME} SELECT rep, {_CURVE_COLUMNS} FROM reps")
def one_step_outcome_replicates(spark, folder):
    _, reps = _replicates(spark, folder, "lef_outcome")
    return rounded(reps.drop("method", *STATUS))


@query("one_step_both_replicates", f"{_LEF_BOTH} SELECT rep, {_CURVE_COLUMNS} FROM reps")
def one_step_both_replicates(spark, folder):
    _, reps = _replicates(spark, folder, "lef_both")
    return rounded(reps.drop("method", *STATUS))


_DROPOUT_PLAN = replace(SATURATED, spec=_CENSOR_SPEC, weights=W.WeightDesigns(SEGMENT_CELLS, censor_d=SEGMENT_CELLS))
_DROPOUT = f"WITH {Q.CENSORED} {Q.WEIGHTED_DROPOUT} {Q.CELLS} {Q.draws(REPLICATES, SEED)}"


@query(
    "bootstrap_with_dropout",
    f"{_DROPOUT} {Q.REFIT_WEIGHTS_DROPOUT} {Q.REPLICATE_ROWS} {Q.REFIT_CELLS} {Q.REPLICATE_CURVES} SELECT rep, {_CURVE_COLUMNS} FROM reps",
)
def bootstrap_with_dropout(spark, folder):
    """Direct bootstrap replicates, switch and drop-out models refitted in each."""
    with TrialAnalysis(censored_panel(spark, folder), _DROPOUT_PLAN) as a:
        return rounded(a.bootstrap(REPLICATES, SEED, ("bootstrap",)).curves.drop("method", *STATUS))


@query(
    "one_step_both_with_dropout",
    f"{_DROPOUT} {Q.STEP_WEIGHTS_DROPOUT} {Q.REPLICATE_ROWS} {Q.STEP_CELLS} {Q.REPLICATE_CURVES} SELECT rep, {_CURVE_COLUMNS} FROM reps",
)
def one_step_both_with_dropout(spark, folder):
    """One step for switch, drop-out and outcome models."""
    with TrialAnalysis(censored_panel(spark, folder), _DROPOUT_PLAN) as a:
        return rounded(a.bootstrap(REPLICATES, SEED, ("lef_both",)).curves.drop("method", *STATUS))


@query("bootstrap_percentile_limits", f"{_DIRECT} SELECT {_LIMITS} FROM reps GROUP BY 1")
def bootstrap_percentile_limits(spark, folder):
    with TrialAnalysis(panel(spark, folder), SATURATED) as a:
        return rounded(I.ci_bootstrap(a, REPLICATES, SEED).drop("method"))


@query(
    "bootstrap_pivotal_limits",
    f"""{_DIRECT}, q AS (SELECT followup_time, quantile_cont(mrd, 0.025) AS l, quantile_cont(mrd, 0.975) AS u FROM reps GROUP BY 1)
    SELECT followup_time, round(mrd, 6) AS est, round(2 * mrd - u, 6) AS lb, round(2 * mrd - l, 6) AS ub FROM q JOIN curve USING (followup_time)""",
)
def bootstrap_pivotal_limits(spark, folder):
    a = TrialAnalysis(panel(spark, folder), SATURATED)
    return rounded(I.ci_bootstrap(a, REPLICATES, SEED, "pivotal").drop("method"))


@query("one_step_outcome_limits", f"{_LEF_OUTCOME} SELECT {_LIMITS} FROM reps GROUP BY 1")
def one_step_outcome_limits(spark, folder):
    with TrialAnalysis(panel(spark, folder), SATURATED) as a:
        return rounded(I.ci_lef(a, REPLICATES, SEED, "outcome").drop("method"))


@query("one_step_both_limits", f"{_LEF_BOTH} SELECT {_LIMITS} FROM reps GROUP BY 1")
def one_step_both_limits(spark, folder):
    with TrialAnalysis(panel(spark, folder), SATURATED) as a:
        return rounded(I.ci_lef(a, REPLICATES, SEED, "both").drop("method"))


@query(
    "limits_of_all_measures",
    f"""{_DIRECT}, u AS (UNPIVOT reps ON survival_treatment, survival_control, survival_difference, survival_ratio
      INTO NAME measure VALUE v) SELECT followup_time, measure, round(quantile_cont(v, 0.025), 6) AS lb,
      round(quantile_cont(v, 0.975), 6) AS ub FROM u GROUP BY 1, 2""",
)
def limits_of_all_measures(spark, folder):
    """Limits for both survival curves, their difference and ratio."""
    _, reps = _replicates(spark, folder, "bootstrap")
    return rounded(I.measure_ci(reps))


@query("bootstrap_standard_errors", f"{_DIRECT} SELECT followup_time, round(stddev_samp(mrd), 6) AS se FROM reps GROUP BY 1")
def bootstrap_standard_errors(spark, folder):
    _, reps = _replicates(spark, folder, "bootstrap")
    return rounded(I.replicate_se(reps).drop("method"))


def _lost(k: int, n: str) -> str:
    """Whether t_kA is aliased: no row of one of the arms at follow-up k."""
    return f"""(coalesce(sum(CASE WHEN assigned_treatment = 1 AND followup_time = {k} THEN {n} END), 0) = 0
      OR coalesce(sum(CASE WHEN assigned_treatment = 0 AND followup_time = {k} THEN {n} END), 0) = 0)"""


@query(
    "failed_replicates",
    f"""WITH {Q.EVENT_PANEL5} {Q.TRIALS} {Q.draws(40, SEED)},
    f AS (SELECT {_lost(4, '1')} AS f4, {_lost(3, '1')} AS f3 FROM pp),
    l AS (SELECT rep, {_lost(4, 'n')} AS r4, {_lost(3, 'n')} AS r3 FROM pp JOIN counts USING (id) GROUP BY 1)
    SELECT count(*) AS replicates, sum(CASE WHEN NOT f4 THEN r4 WHEN NOT f3 THEN r3 ELSE false END::INTEGER)::BIGINT AS failed FROM l, f""",
)
def failed_replicates(spark, folder):
    """Replicates in which the treatment term of a late visit is lost."""
    with TrialAnalysis(S.event_panel(spark, folder).filter(F.col("t") < VISITS), _late_terms_plan()) as a:
        return I.failed_replicates(a.bootstrap(40, SEED, ("bootstrap",)).curves).drop("method")


def _late_terms_plan() -> Plan:
    """Arm by visit, saturated, with the treatment terms of the last visits to be dropped where an arm is empty."""
    levels = [Level("followup_time", k) for k in range(1, VISITS)]
    terms = [Term(f"t_{v.value}", (v,)) for v in levels]
    terms += [Term(f"t_{v.value}A", (v, Level("assigned_treatment", 1))) for v in levels]
    return Plan(SPEC, W.WeightDesigns(Design.of()), Design.of("assigned_treatment", *terms), drop_order=("t_4A", "t_3A"))


_STATUS_COLUMNS = ", ".join(f"sum({c}::INTEGER)::BIGINT AS {c}" for c in STATUS)


@query(
    "replicate_status",
    f"""WITH {Q.EVENT_PANEL5} {Q.TRIALS} {Q.draws(40, SEED)},
    f AS (SELECT {_lost(4, '1')} AS f4, {_lost(3, '1')} AS f3 FROM pp),
    l AS (SELECT rep, {_lost(4, 'n')} AS r4, {_lost(3, 'n')} AS r3 FROM pp JOIN counts USING (id) GROUP BY 1),
    c AS (SELECT rep, sum(n * outcome) AS hit, sum(n) AS n FROM pp JOIN counts USING (id) GROUP BY rep, assigned_treatment, followup_time
      UNION ALL SELECT rep, sum(n * A), sum(n) FROM panel JOIN counts USING (id) GROUP BY rep, Ap),
    e AS (SELECT rep, bool_or(n > 0 AND (hit = 0 OR hit = n)) AS separated FROM c GROUP BY 1),
    s AS (SELECT rep, CASE WHEN NOT f4 THEN r4 WHEN NOT f3 THEN r3 ELSE false END AS failed, separated, false AS not_converged, false AS not_finite
      FROM l JOIN e USING (rep), f)
    SELECT count(*) AS replicates, {_STATUS_COLUMNS} FROM s""",
)
def replicate_status(spark, folder):
    """What became of the replicates: a lost term, an arm without (or with nothing but) events at a visit, no convergence."""
    with TrialAnalysis(S.event_panel(spark, folder).filter(F.col("t") < VISITS), _late_terms_plan()) as a:
        return I.replicate_status(a.bootstrap(40, SEED, ("bootstrap",)).curves).drop("method")


_PIVOTS = Q.eliminated("list(l ORDER BY i)", 10, whole=False, tol=1e-300)


@query(
    "covariance_check",
    f"""{_LEF_OUTCOME}, d AS (SELECT rep, assigned_treatment * {VISITS} + followup_time AS i, b - ln(cell.p / (1 - cell.p)) AS d FROM rb
      JOIN cell USING (assigned_treatment, followup_time)),
    v AS (SELECT k.m, a.i, b.i AS j, avg(a.d * b.d) AS v FROM (VALUES (4), ({REPLICATES})) k(m) JOIN d a ON a.rep < k.m
      JOIN d b ON b.rep = a.rep GROUP BY 1, 2, 3),
    l AS (SELECT m, i, list(v ORDER BY j) AS l, max(CASE WHEN i = j THEN v END) AS own FROM v GROUP BY 1, 2),
    x AS (SELECT m AS replicates, list(own ORDER BY i) AS own, {_PIVOTS} AS m FROM l GROUP BY 1)
    SELECT replicates::BIGINT AS replicates, len(own)::BIGINT AS terms,
      list_bool_and(list_transform(own, lambda o, i: m[i][i] > 1e-9 * o)) AS positive_definite FROM x""",
)
def covariance_check(spark, folder):
    """Whether a covariance can be drawn from: one of fewer replicates than terms, and one of more."""
    rows = []
    with TrialAnalysis(panel(spark, folder), SATURATED) as a:
        for m in (4, REPLICATES):
            cov = a.bootstrap(m, SEED, ("lef_outcome",)).moments["lef_outcome"].about_centre()
            rows.append((m, len(cov), positive_definite(cov)))
    return spark.createDataFrame(rows, "replicates bigint, terms bigint, positive_definite boolean")


@query(
    "one_step_variance",
    f"""{_LEF_OUTCOME}, d AS (SELECT rep, {_CELL_NAME} AS term, b - ln(cell.p / (1 - cell.p)) AS d FROM rb
      JOIN cell USING (assigned_treatment, followup_time))
    SELECT a.term AS term_i, b.term AS term_j, round(avg(a.d * b.d), 5) AS value FROM d a JOIN d b USING (rep) GROUP BY 1, 2""",
)
def one_step_variance(spark, folder):
    """Mean outer product of one-step coefficients about the fit."""
    a = TrialAnalysis(panel(spark, folder), SATURATED)
    moments = a.bootstrap(REPLICATES, SEED, ("lef_outcome",)).moments["lef_outcome"]
    return rounded(M.covariance_rows(spark, {"lef": (a.fit.design, moments.about_centre())}).drop("model"), 5)


_CELL = f"assigned_treatment * {VISITS} + followup_time"
_CELL_DRAWS = f"""
    dh AS (SELECT rep, a, k, 1 - 1 / (1 + exp(-b[a * {VISITS} + k + 1])) AS s FROM drawn_b, range(2) x(a), range({VISITS}) y(k)),
    ds AS (SELECT rep, a, k::INTEGER AS followup_time, product(s) OVER (PARTITION BY rep, a ORDER BY k) AS s FROM dh),
    dm AS (SELECT rep, followup_time, max(CASE WHEN a = 0 THEN s END) - max(CASE WHEN a = 1 THEN s END) AS mrd FROM ds GROUP BY 1, 2)"""


@query(
    "one_step_normal_limits",
    f"""{_LEF_OUTCOME}, d AS (SELECT rep, {_CELL} AS i, b - ln(cell.p / (1 - cell.p)) AS d FROM rb JOIN cell USING (assigned_treatment, followup_time))
    {Q.normal_by(2 * VISITS, DRAWS, SEED, "SELECT a.i, b.i AS j, avg(a.d * b.d) AS v FROM d a JOIN d b USING (rep) GROUP BY 1, 2",
                 f"SELECT {_CELL} AS i, ln(p / (1 - p)) AS m FROM cell")},
    {_CELL_DRAWS} SELECT {_LIMITS} FROM dm GROUP BY 1""",
)
def one_step_normal_limits(spark, folder):
    """Normal draws with the variance of the one-step coefficients."""
    with TrialAnalysis(panel(spark, folder), SATURATED) as a:
        return rounded(I.ci_lef(a, REPLICATES, SEED, "mvn", draws=DRAWS).drop("method"))


def _events(spark, folder):
    return TrialAnalysis(event_rows(spark, folder), EVENT_PLAN)


@query("jackknife_replicates", f"{_JACKKNIFE} SELECT rep, followup_time, round(mrd, 6) AS mrd FROM reps")
def jackknife_replicates(spark, folder):
    """Leave-one-person-out refits of weights and outcome model."""
    return rounded(_events(spark, folder).jackknife().curves.select("rep", "followup_time", "mrd"))


def _wald_sql(centre: str) -> str:
    return f"""{_JACKKNIFE}, m AS (SELECT r.followup_time, any_value(c.mrd) AS est, count(*) AS replicates,
      sqrt((count(*) - 1) / count(*) * {centre}) AS se FROM reps r JOIN curve c USING (followup_time) GROUP BY 1)
    SELECT followup_time, round(est, 6) AS est, round(se, 6) AS se, round(est - 1.96 * se, 6) AS lb, round(est + 1.96 * se, 6) AS ub,
      replicates FROM m"""


@query("jackknife_wald_limits", _wald_sql("sum((r.mrd - c.mrd) * (r.mrd - c.mrd))"))
def jackknife_wald_limits(spark, folder):
    return rounded(I.ci_jackknife(_events(spark, folder)))


@query("jackknife_wald_limits_about_mean", _wald_sql("(var_pop(r.mrd) * count(*))"))
def jackknife_wald_limits_about_mean(spark, folder):
    return rounded(I.ci_jackknife(_events(spark, folder), "mean"))


_ARMS = replace(EVENT_PLAN, outcome=cell_terms(("assigned_treatment", (0, 1))))
_ARM_FITS = f"""WITH {Q.EVENT_PANEL} {Q.WEIGHTED} {Q.leave_one_out()} {Q.REFIT_WEIGHTS} {Q.REPLICATE_ROWS}, jb AS (SELECT rep,
      assigned_treatment AS i, sum(w * outcome) / sum(w) AS p FROM rr GROUP BY 1, 2),
    jl AS (SELECT rep, i, ln(p / (1 - p)) AS b FROM jb), jm AS (SELECT i, avg(b) AS m FROM jl GROUP BY 1),
    jd AS (SELECT rep, i, b - m AS d FROM jl JOIN jm USING (i)),
    jc AS (SELECT x.i, y.i AS j, (count(*) - 1) / count(*) * sum(x.d * y.d) AS v FROM jd x JOIN jd y USING (rep) GROUP BY 1, 2)"""


@query(
    "jackknife_covariance",
    f"""{_ARM_FITS} SELECT 'assigned_treatment=' || i AS term_i, 'assigned_treatment=' || j AS term_j, round(v, 5) AS value FROM jc""",
)
def jackknife_covariance(spark, folder):
    """Covariance of the outcome coefficients over leave-one-out refits."""
    with TrialAnalysis(event_rows(spark, folder), _ARMS) as a:
        cov = a.jackknife().moments["jackknife"].jackknife()
        return rounded(M.covariance_rows(spark, {"j": (a.fit.design, cov)}).drop("model"), 5)


@query(
    "jackknife_normal_limits",
    f"""{_ARM_FITS}, ja AS (SELECT assigned_treatment AS i, sum(weight * outcome) / sum(weight) AS p FROM wpp GROUP BY 1)
    {Q.normal_by(2, DRAWS, SEED, "SELECT i, j, v FROM jc", "SELECT i, ln(p / (1 - p)) AS m FROM ja")},
    dm AS (SELECT rep, k::INTEGER AS followup_time, pow(1 - 1 / (1 + exp(-b[1])), k + 1) - pow(1 - 1 / (1 + exp(-b[2])), k + 1) AS mrd FROM drawn_b, range(3) r(k))
    SELECT {_LIMITS} FROM dm GROUP BY 1""",
)
def jackknife_normal_limits(spark, folder):
    """Normal draws with the jackknife covariance, one hazard for each arm (a cell by visit may have no event)."""
    with TrialAnalysis(event_rows(spark, folder), _ARMS) as a:
        return rounded(I.ci_jackknife_mvn(a, DRAWS, SEED).drop("method"))


_P = len(REGRESSION.outcome)


@query(
    "sandwich_limits",
    f"""{_REGRESSION} {Q.robust_by(REGRESSION.outcome)}
    {Q.normal_by(_P, DRAWS, SEED, "SELECT i, j, v FROM rv", f"SELECT i, b[i + 1] AS m FROM oc, range({_P}) r(i)")}
    {Q.curves_by(REGRESSION.outcome, VISITS, "SELECT rep, b FROM drawn_b")} SELECT {_LIMITS} FROM marks GROUP BY 1""",
)
def sandwich_limits(spark, folder):
    """Normal draws with the robust covariance, each standardised over all persons."""
    with TrialAnalysis(panel(spark, folder), REGRESSION) as a:
        return rounded(I.ci_sandwich(a, DRAWS, SEED).drop("method"))


@query("all_bootstrap_limits_regression")
def all_bootstrap_limits_regression(spark, folder):
    """Three bootstrap methods on the same draws, regression designs."""
    with TrialAnalysis(panel(spark, folder), REGRESSION) as a:
        return rounded(I.percentile_ci(a.bootstrap(REPLICATES, SEED).curves))


@query(
    "sandwich_limits_of_all_measures",
    f"""{_REGRESSION} {Q.robust_by(REGRESSION.outcome)}
    {Q.normal_by(_P, DRAWS, SEED, "SELECT i, j, v FROM rv", f"SELECT i, b[i + 1] AS m FROM oc, range({_P}) r(i)")}
    {Q.curves_by(REGRESSION.outcome, VISITS, "SELECT rep, b FROM drawn_b")},
    u AS (UNPIVOT marks ON survival_treatment, survival_control, survival_difference, survival_ratio INTO NAME measure VALUE v)
    SELECT followup_time, measure, round(quantile_cont(v, 0.025), 6) AS lb, round(quantile_cont(v, 0.975), 6) AS ub FROM u GROUP BY 1, 2""",
)
def sandwich_limits_of_all_measures(spark, folder):
    """Limits of both survival curves, their difference and ratio from draws with the robust covariance."""
    with TrialAnalysis(panel(spark, folder), REGRESSION) as a:
        return rounded(I.measure_ci(a.normal_replicates(a.robust, DRAWS, SEED, "sandwich")))
