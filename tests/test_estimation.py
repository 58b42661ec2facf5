import numpy as np
import pytest
from pyspark.sql import functions as F

from emulant.functions import kernel
from emulant.functions.design import Design, Level, Power, Term, cell_terms, linear_time_terms, visit_terms
from emulant.operators import gcomp as G
from emulant.operators import intervals as I
from emulant.operators import regression as M
from emulant.operators import weights as W
from emulant.plans.analysis import Plan, TrialAnalysis
from emulant.session import new_table_path
from emulant.sources import adapters as S
from emulant.sources import tables as IO
from emulant.spec import PanelSpec

SPEC = PanelSpec(visits=5)
PLAN = Plan(
    SPEC,
    W.WeightDesigns(Design.of("X2", "X4")),
    visit_terms(5, ["X2", "X4"]),
    ("X2", "X4"),
    drop_order=("t_4A", "t_3A"),
)
SIMPLE = Plan(SPEC, W.WeightDesigns(Design.of("X2")), Design.of("X2", "assigned_treatment", "followup_time"), ("X2",))


@pytest.fixture(scope="module")
def analysis(order_panel):
    with TrialAnalysis(order_panel, SIMPLE) as a:
        yield a


@pytest.fixture(scope="module")
def full(order_panel):
    with TrialAnalysis(order_panel, PLAN) as a:
        yield a


def newton(x, y, w, passes=50):
    b = np.zeros(x.shape[1])
    for _ in range(passes):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]), x.T @ (w * (y - p)))
    return b


# ---- designs ------------------------------------------------------------------


def test_designs_agree_between_spark_and_numpy(spark):
    df = spark.createDataFrame(
        [(0, 1, 0.5, "a"), (1, 0, -2.0, "b"), (2, 1, 3.0, "a")], "followup_time int, assigned_treatment int, X2 double, s string"
    )
    design = Design.of(
        "X2", Power("X2", 2), ("X2", "assigned_treatment"), Level("s", "a"), Term("t_1A", (Level("followup_time", 1), Power("assigned_treatment")))
    )
    got = np.array([r[0] for r in df.select(design.vector()).collect()])
    data = {c: np.array([r[c] for r in df.collect()], dtype=object if c == "s" else float) for c in df.columns}
    assert np.allclose(got, design.matrix(data, 3))
    codes = {"s": ["b", "a"]}
    coded = dict(data, s=np.array([codes["s"].index(v) for v in data["s"]], dtype=float))
    assert np.allclose(got, design.coded(codes).matrix(coded, 3))


def test_visit_design_has_the_documented_terms():
    names = visit_terms(5, ["X2", "X4"]).names
    assert len(names) == 20
    assert names[:5] == ["(Intercept)", "X2", "X4", "assigned_treatment", "t_1"]
    assert names[-1] == "t_4X4"
    assert linear_time_terms(["X2"]).names[-2:] == ["tA", "tX2"]


# ---- regression -------------------------------------------------------------------


def test_fit_equals_newton_on_one_machine(analysis):
    rows = analysis.expanded.toPandas()
    x = np.column_stack([np.ones(len(rows)), rows.X2, rows.assigned_treatment, rows.followup_time])
    assert np.allclose(analysis.fit.coef, newton(x, rows.outcome.to_numpy(float), rows.weight.to_numpy()), atol=1e-8)


def test_fit_equals_the_built_in_generalised_linear_model(spark, analysis):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    names = ["X2", "assigned_treatment", "followup_time"]
    data = VectorAssembler(inputCols=names, outputCol="f").transform(analysis.expanded)
    glr = GeneralizedLinearRegression(
        family="binomial", labelCol="outcome", featuresCol="f", weightCol="weight", tol=1e-12, maxIter=50
    ).fit(data)
    assert np.allclose(analysis.fit.coef[1:], glr.coefficients.toArray(), atol=1e-6)
    assert analysis.fit.coef[0] == pytest.approx(glr.intercept, abs=1e-6)
    errors = glr.summary.coefficientStandardErrors
    assert np.allclose(analysis.fit.std_error[1:], errors[:-1], atol=1e-5)


def test_score_vanishes_at_the_fit(analysis):
    got = M.score_vector(analysis.expanded, analysis.fit, "outcome", "weight").first()
    assert np.abs(np.array(tuple(got))).max() < 1e-4


def test_several_models_in_shared_passes_equal_single_fits(order_panel):
    together = W.fit_weight_models(order_panel, SPEC, W.WeightDesigns(Design.of("X2"), Design.of("X4")))
    alone = M.fit_logit(order_panel, Design.of("X2"), "A", where=F.col("Ap") == 1)
    assert np.allclose(together["switch_d1"].coef, alone.coef, atol=1e-8)


def test_intercept_model_is_the_weighted_mean(analysis):
    fit = M.fit_logit(analysis.expanded, Design.of(), "outcome", "weight")
    mean = analysis.expanded.agg(F.sum(F.col("weight") * F.col("outcome")) / F.sum("weight")).first()[0]
    assert 1 / (1 + np.exp(-fit.coef[0])) == pytest.approx(mean, abs=1e-9)


def test_rows_with_missing_values_or_zero_weight_are_left_out(spark):
    data = [(0.0, 1, 1.0), (1.0, 0, 1.0), (0.0, 0, 1.0), (1.0, 1, 2.0), (None, 1, 1.0), (5.0, 1, 0.0), (1.0, None, 1.0)]
    df = spark.createDataFrame(data, "x double, y int, w double")
    fit = M.fit_logit(df, Design.of("x"), "y", "w")
    assert fit.n == 4 and fit.sum_weight == 5.0


def test_empty_arm_by_visit_cell_is_dropped_from_the_design(full):
    # The treated arm of this data has no row at follow-up 4.
    assert "t_4A" not in full.fit.design.names
    assert "t_3A" in full.fit.design.names


def test_aliased_column_gets_no_coefficient(spark, order_panel):
    df = order_panel.withColumn("twice", F.col("X2") * 2 + 1)
    fit = M.fit_logit(df, Design.of("X2", "twice"), "A")
    plain = M.fit_logit(df, Design.of("X2"), "A")
    assert np.isnan(fit.coef[2]) and np.allclose(fit.coef[:2], plain.coef, atol=1e-8)


def test_drop_order_stops_at_the_first_term_that_is_kept():
    s = kernel.Newton(3, names=("a", "b", "c"), drop_order=("c", "b"))
    s.keep[:, 0] = (True, False, True)
    assert s.dropped(0) == []
    s.keep[:, 0] = (True, True, False)
    assert s.dropped(0) == ["c"]


def test_separation_ends_and_predicts_the_extreme(spark):
    df = spark.createDataFrame([(0.0, 0)] * 5 + [(1.0, 1)] * 5 + [(0.0, 1)] * 5, "x double, y int")
    fit = M.fit_logit(df, Design.of("x"), "y")
    assert np.isfinite(fit.coef).all()
    assert 1 / (1 + np.exp(-fit.coef.sum())) > 0.999999


def test_sandwich_equals_the_sum_over_clusters(analysis):
    rows = analysis.expanded.toPandas()
    x = np.column_stack([np.ones(len(rows)), rows.X2, rows.assigned_treatment, rows.followup_time])
    p = 1 / (1 + np.exp(-x @ analysis.fit.coef))
    u = x * (rows.weight * (rows.outcome - p)).to_numpy()[:, None]
    per = np.array([u[rows.id == i].sum(axis=0) for i in rows.id.unique()])
    bread = np.linalg.inv(x.T @ (x * (rows.weight * p * (1 - p)).to_numpy()[:, None]))
    want = bread @ (per.T @ per) @ bread
    plain = M.sandwich(analysis.expanded, analysis.fit, "outcome", "weight", adjust="none")
    assert np.allclose(plain, want, rtol=1e-6)
    assert np.allclose(analysis.robust, want * len(per) / (len(per) - 1), rtol=1e-6)


def test_models_survive_storage(spark, analysis):
    path = new_table_path(spark, "model")
    fit = analysis.fit
    IO.save_model(M.tidy(spark, {"m": fit}), M.covariance_rows(spark, {"m": (fit.design, fit.vcov)}), path)
    back = M.fit_from_tables(fit.design, *IO.load_model(spark, path), "m")
    assert np.allclose(back.coef, fit.coef) and np.allclose(back.vcov, fit.vcov)


def test_non_positive_definite_covariance_is_seen():
    assert kernel.positive_definite(np.eye(2))
    assert not kernel.positive_definite(np.array([[1.0, 2.0], [2.0, 1.0]]))


def test_sums_through_the_shuffle_equal_sums_on_the_driver(spark, analysis, monkeypatch):
    from emulant.functions import sums

    monkeypatch.setattr(sums, "COLLECT_BYTES", 0)
    again = M.fit_logit(analysis.expanded, SIMPLE.outcome, "outcome", "weight")
    assert np.allclose(again.coef, analysis.fit.coef, atol=1e-9)


# ---- weights -------------------------------------------------------------------------


def test_weight_is_one_at_the_start_of_a_trial(analysis):
    start = analysis.expanded.filter("followup_time = 0").agg(F.min("weight"), F.max("weight")).first()
    assert tuple(start) == (1.0, 1.0)


def test_weights_in_one_pass_equal_the_joined_ones(order_panel, analysis):
    w = W.trial_weights(W.ip_weights(order_panel, SPEC, analysis.weight_fits), SPEC)
    keys = ["id", "trial_period", "followup_time"]
    both = analysis.expanded.select(*keys, F.col("weight").alias("a")).join(w, keys, "left")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("weight")))).first()[0] < 1e-12
    assert both.filter("weight is null").isEmpty()


def test_missing_probability_counts_as_one_for_drop_out_only(spark):
    df = spark.createDataFrame([(1, 0.5, None), (0, 0.5, 0.25)], "A int, n double, d double")
    got = df.select(
        W.row_weight(F.col("A"), F.col("n"), F.col("d")).alias("s"), W.censor_weight(F.col("n"), F.col("d")).alias("c")
    ).collect()
    assert got[0]["s"] is None and got[0]["c"] == 0.5
    assert got[1]["s"] == pytest.approx(0.5 / 0.75) and got[1]["c"] == 2.0


# ---- standardisation ---------------------------------------------------------------------


def test_curves_fall_and_stay_in_range(analysis):
    rows = analysis.curve().orderBy("followup_time").collect()
    assert [r["followup_time"] for r in rows] == list(range(5))
    for c in ("survival_treatment", "survival_control"):
        s = [1.0] + [r[c] for r in rows]
        assert all(0 <= b <= a for a, b in zip(s, s[1:]))
    assert all(r["mrd"] == pytest.approx(r["survival_control"] - r["survival_treatment"]) for r in rows)


@pytest.mark.parametrize("trials", [(0,), None])
def test_short_form_equals_grid_and_window(analysis, trials):
    short = G.marginal_curves(analysis.expanded, analysis.fit, 5, trials).orderBy("followup_time").collect()
    grid = G.cum_survival(G.predict_arms(G.prediction_grid(analysis.expanded, 5, trials), analysis.fit))
    long = G.mean_curves(grid).orderBy("followup_time").collect()
    assert np.allclose([r["mrd"] for r in short], [r["mrd"] for r in long], atol=1e-12)


def test_hazard_of_one_gives_survival_zero(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 0.5, 1.0), (1, 0, 1, 0.0, 0.2)],
        "id long, trial_period int, followup_time int, hazard_treatment double, hazard_control double",
    )
    got = G.cum_survival(df).orderBy("followup_time").collect()
    assert [r["survival_treatment"] for r in got] == [0.5, 0.5]
    assert [r["survival_control"] for r in got] == [0.0, 0.0]


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 1, 1), (4, 2, 1), (4, 1, 0), (4, 0, 0)], "id long, t int, Y int")
    got = [(r["time"], r["n_risk"], r["n_event"], round(r["survival"], 6)) for r in G.km(df).orderBy("time").collect()]
    assert got == [(0, 4, 1, 0.75), (1, 3, 1, 0.5), (2, 1, 1, 0.0)]


# ---- replicates ------------------------------------------------------------------------------


def test_replicate_refit_equals_a_fit_on_copied_rows(spark, order_panel, analysis):
    """One bootstrap replicate against the same analysis of physically copied persons."""
    from emulant.operators import resample as R

    reps = analysis.bootstrap(2, 5, ("bootstrap",))
    counts = R.bootstrap_counts(analysis.expanded, 2, 5)
    for rep in (0, 1):
        copies = R.bootstrap_rows(order_panel, counts.filter(F.col("rep") == rep))
        copies = copies.withColumn("id", F.abs(F.xxhash64("new_id"))).drop("rep", "new_id", "copy")
        with TrialAnalysis(copies, SIMPLE) as again:
            want = again.fit.coef
        got = reps.coefficients.filter(F.col("rep") == rep).collect()
        got = {r["term"]: r["estimate"] for r in got}
        assert np.allclose([got[n] for n in SIMPLE.outcome.names], want, atol=1e-6)


def test_one_step_with_every_count_one_returns_the_fit(analysis):
    lay = analysis._layout(2, 0, "ones")
    step = analysis._step_weights(analysis.persons, lay)
    b = analysis._step_outcome(analysis.persons, lay, step)
    assert np.allclose(b[:, 0], analysis.fit.coef, atol=1e-5)


def test_all_methods_agree_on_the_scale_of_the_limits(full):
    reps = full.bootstrap(40, 3)
    limits = {(r["method"], r["followup_time"]): (r["lb"], r["ub"]) for r in I.percentile_ci(reps.curves).collect()}
    for m in ("bootstrap", "lef_outcome", "lef_both"):
        lb, ub = limits[(m, 0)]
        assert lb < ub and ub - lb < 0.5
    curve = {r["followup_time"]: r["mrd"] for r in full.curve().collect()}
    assert limits[("lef_both", 0)][0] < curve[0] < limits[("lef_both", 0)][1]


def test_blocks_do_not_change_replicates(order_panel, analysis):
    from dataclasses import replace

    with TrialAnalysis(order_panel, replace(SIMPLE, block=3)) as small:
        a = small.bootstrap(7, 9, ("lef_outcome",)).curves
        b = analysis.bootstrap(7, 9, ("lef_outcome",)).curves
        keys = ["rep", "followup_time"]
        both = a.select(*keys, F.col("mrd").alias("a")).join(b.select(*keys, F.col("mrd").alias("b")), keys)
        assert both.count() == 35
        assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9


def test_tables_in_the_shared_folder_give_the_same_replicates(order_panel, analysis):
    from dataclasses import replace

    with TrialAnalysis(order_panel, replace(SIMPLE, storage="shared")) as other:
        assert np.allclose(other.fit.coef, analysis.fit.coef, atol=1e-9)
        a = other.bootstrap(2, 9, ("lef_both",)).curves.orderBy("rep", "followup_time").collect()
    b = analysis.bootstrap(2, 9, ("lef_both",)).curves.orderBy("rep", "followup_time").collect()
    assert np.allclose([r["mrd"] for r in a], [r["mrd"] for r in b], atol=1e-9)


def test_jackknife_equals_leaving_a_person_out(spark, folder):
    panel = S.event_panel(spark, folder).filter("t <= 2")
    plan = Plan(PanelSpec(visits=3), W.WeightDesigns(Design.of()), Design.of("assigned_treatment"), ())
    from emulant.operators import resample as R

    with TrialAnalysis(panel, plan) as a:
        reps = a.jackknife()
        index = {r["idx"]: r["id"] for r in R.person_index(a.expanded).collect()}
        assert len(index) == a.person_count
        for rep in (0, len(index) - 1):
            with TrialAnalysis(R.drop_id(panel, index[rep]), plan) as less:
                want = less.fit.coef
            got = {r["term"]: r["estimate"] for r in reps.coefficients.filter(F.col("rep") == rep).collect()}
            assert np.allclose([got[n] for n in plan.outcome.names], want, atol=1e-6)
        n = a.person_count
        coefs = np.array(
            [[r["estimate"] for r in reps.coefficients.filter(F.col("rep") == k).orderBy("term").collect()] for k in range(n)]
        )
        order = np.argsort(plan.outcome.names)
        pseudo = n * a.fit.coef[order] - (n - 1) * coefs
        want = np.cov(pseudo.T) / n
        assert np.allclose(reps.moments["jackknife"].jackknife()[np.ix_(order, order)], want, rtol=1e-6)


def test_censored_replicates_equal_the_censored_fit_at_counts_one(spark, folder):
    panel = S.censored_order_panel(spark, folder).filter("t <= 4")
    design = Design.of("X4")
    plan = Plan(
        PanelSpec(visits=5, censor="C"), W.WeightDesigns(design, censor_d=design, pooled=True), Design.of("assigned_treatment"), ()
    )
    with TrialAnalysis(panel, plan) as a:
        lay = a._layout(1, 0, "ones")
        coefs, unfit = a._refit_weights(a.persons, lay)
        b, status = a._refit_outcome(a.persons, lay, coefs)
        assert np.allclose(b[:, 0], a.fit.coef, atol=1e-7) and status.row(0) == unfit.row(0) == (0, 0, 0, 0)


def test_sandwich_limits_hold_the_estimate(full):
    got = {r["followup_time"]: r for r in I.ci_sandwich(full, 200, 3).collect()}
    for r in full.curve().filter("followup_time < 3").collect():
        assert got[r["followup_time"]]["lb"] < r["mrd"] < got[r["followup_time"]]["ub"]


def test_duplicate_visits_are_refused(spark, order_panel):
    twice = order_panel.unionByName(order_panel)
    with TrialAnalysis(twice, SIMPLE) as a:
        with pytest.raises(Exception, match="key not unique"):
            a.person_count


def test_normal_draws_have_the_given_moments():
    cov = np.array([[2.0, 0.5], [0.5, 1.0]])
    x = kernel.normal_draws(np.array([1.0, -1.0]), cov, 200_000, 4)
    assert np.allclose(x.mean(axis=0), [1, -1], atol=0.02) and np.allclose(np.cov(x.T), cov, atol=0.03)
    assert np.array_equal(x, kernel.normal_draws(np.array([1.0, -1.0]), cov, 200_000, 4))


def test_cell_design_enumerates_combinations():
    assert cell_terms(("a", (0, 1)), ("b", range(3))).names[0] == "a=0:b=0"
    assert len(cell_terms(("a", (0, 1)), ("b", range(3)))) == 6


def _small_panel(spark, rows):
    return spark.createDataFrame(rows, "id long, t int, A int, Ap int, X2 double, Y int, eligible int")


def test_replicates_without_events_in_an_arm(spark):
    """All treated may have events, no untreated has: replicates keep the treatment term."""
    rows = [(i, 0, i % 2, 0, float(i % 5), int(i % 6 == 1), 1) for i in range(60)]
    plan = Plan(PanelSpec(visits=1), W.WeightDesigns(None), Design.of("assigned_treatment"), ())
    with TrialAnalysis(_small_panel(spark, rows), plan) as a:
        assert a.fit.coef[1] > 10
        got = a.bootstrap(20, 1, ("bootstrap",))
        terms = got.coefficients.filter("term = 'assigned_treatment'").collect()
        assert len(terms) == 20 and all(r.estimate > 10 for r in terms)
        assert all(r.mrd > 0 for r in got.curves.collect() if not r.failed)


def test_missing_weight_keeps_the_trials(spark):
    """A = 1, 0, 1 with a missing covariate at the switch: the trial still ends there."""
    rows = [(1, 0, 1, 0, 0.5, 0, 1), (1, 1, 0, 1, None, 0, 0), (1, 2, 1, 0, 0.5, 0, 0)]
    rows += [(i, t, (i + t) % 2, (i + t + 1) % 2 if t else 0, float(i % 3), int((i * 7 + t) % 5 == 0), int(t == 0)) for i in range(2, 40) for t in range(3)]
    plan = Plan(PanelSpec(visits=3), W.WeightDesigns(Design.of("X2")), Design.of("assigned_treatment"), ())
    with TrialAnalysis(_small_panel(spark, rows), plan) as a:
        assert [r.followup_time for r in a.expanded.filter("id = 1").collect()] == [0]


def test_intention_to_treat_is_not_weighted(spark):
    rows = [(i, t, (i + t) % 2, (i + t + 1) % 2 if t else 0, float(i % 3), int((i * 7 + t) % 5 == 0), int(t == 0)) for i in range(40) for t in range(3)]
    plan = Plan(PanelSpec(visits=3), W.WeightDesigns(Design.of("X2")), Design.of("assigned_treatment"), (), estimand="ITT")
    with TrialAnalysis(_small_panel(spark, rows), plan) as a:
        assert a.expanded.filter("weight <> 1").count() == 0 and a.expanded.count() == 120
        curves = a.bootstrap(3, 1).curves
        assert curves.filter("mrd IS NULL").count() == 0 and curves.count() == 3 * 3 * 3


def test_missing_level_is_missing():
    x = Level("g", 1.0).numpy({"g": np.array([1.0, 0.0, np.nan])})
    assert x[0] == 1 and x[1] == 0 and np.isnan(x[2])


def test_groups_in_shared_passes_equal_single_fits(spark, order_panel):
    """All groups at once, a hot one and one with a missing name among them, against a fit of each."""
    rows = order_panel.withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") % 7 == 1, 1).otherwise(0)))
    fits = M.fit_groups(rows, ["g"], Design.of("X2", "X4"), "A")
    assert fits.levels == [(None,), (0,), (1,)]
    for level in fits.levels:
        alone = M.fit_logit(rows.filter(F.col("g").eqNullSafe(F.lit(level[0]))), Design.of("X2", "X4"), "A")
        got = fits.fit(level)
        assert np.allclose(got.coef, alone.coef, atol=1e-9) and np.allclose(got.vcov, alone.vcov, atol=1e-9) and got.n == alone.n
    with pytest.raises(ValueError, match="groups are more than 2"):
        M.fit_groups(rows, ["g"], Design.of("X2"), "A", most=2)


def test_separated_groups_have_no_numbers(spark):
    rows = [(g, i % 2, int(i % 4 == 1) if g == 0 else i % 2) for g in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, x int, y int")
    got = {(r["g"], r["term"]): r for r in M.fit_groups(df, ["g"], Design.of("x"), "y").tidy(spark).collect()}
    assert got[1, "x"]["separated"] and got[1, "x"]["estimate"] is None
    zero = got[0, "x"]
    assert zero["separated"] and zero["estimate"] is None  # no event where x is 0


def test_constant_strategies_are_the_marginal_curves(analysis):
    paths = {"survival_treatment": (1,) * 5, "survival_control": (0,) * 5}
    for trials in ((0,), None):
        got = G.strategy_curves(analysis.expanded, analysis.fit, paths, trials, "assigned_treatment").collect()
        want = {r["followup_time"]: r for r in G.marginal_curves(analysis.expanded, analysis.fit, 5, trials).collect()}
        assert len(got) == 10 and all(r["survival"] == pytest.approx(want[r["followup_time"]][r["strategy"]], abs=1e-12) for r in got)
