"""Leave-one-out fits from sums over all persons, against refits without the person."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulant.functions import leave_one_out as loo
from emulant.functions.design import Design, visit_terms
from emulant.operators import weights as W
from emulant.plans.analysis import Plan, TrialAnalysis
from emulant.sources import adapters as S
from emulant.spec import PanelSpec

LARGER = "/root/testdata/sf0.01"
TERMS = Design.of("X2", "X4")
PLANS = {
    "switching": Plan(PanelSpec(visits=5), W.WeightDesigns(TERMS), visit_terms(5, ["X2", "X4"]), ("X2", "X4"), drop_order=("t_4A",)),
    "switching and drop-out": Plan(
        PanelSpec(visits=5, censor="C"), W.WeightDesigns(TERMS, censor_d=TERMS), Design.of("X2", "assigned_treatment", "followup_time"), ("X2", "X4")
    ),
    "some visits unweighted": Plan(
        PanelSpec(visits=5), W.WeightDesigns(TERMS), Design.of("X2", "assigned_treatment"), ("X2",), eligible_wts=((1, "eligible"),), normalise="counts"
    ),
    "intention to treat": Plan(PanelSpec(visits=5), W.WeightDesigns(TERMS), Design.of("X4", "assigned_treatment"), ("X4",), estimand="ITT", trials=None),
}


@pytest.fixture(scope="module")
def panel(spark):
    return S.censored_order_panel(spark, LARGER).filter("t <= 4").persist()


@pytest.mark.parametrize("name", PLANS)
def test_solved_fits_equal_refits(panel, name):
    with TrialAnalysis(panel, PLANS[name]) as a:
        reps = a.jackknife()
        n = a.person_count
        assert reps.curves.select("rep").distinct().count() == n and reps.curves.count() == 5 * n
        solved = a._held[-1].filter("good").orderBy("idx").toPandas()
        assert len(solved) > n / 20
        some = solved.iloc[np.linspace(0, len(solved) - 1, 40).astype(int)]
        lay = replace(a._layout(len(some), 0, "left_out"), left_out=tuple(int(i) for i in some.idx))
        # Refits from the full fit end at 1e-8 of the deviance; from a start close by they end closer.
        start = {"outcome": np.stack(some.coef).T}
        at = 0
        for m, design, _, _ in lay.models:
            start[m] = np.stack(some.theta).T[at : at + len(design)]
            at += len(design)
        coefs, _ = a._refit_weights(a.persons, lay, start)
        b, status = a._refit_outcome(a.persons, lay, coefs, start)
        assert not status.not_converged.any()
        assert np.abs(np.stack(some.coef) - b.T).max() < 1e-8
        assert np.abs(np.stack(some.means) - a._curves(a.persons, lay, b)).max() < 1e-8


def test_moments_are_those_of_the_coefficients(panel):
    with TrialAnalysis(panel, PLANS["switching and drop-out"]) as a:
        reps = a.jackknife()
        names = a.fit.design.names
        wide = reps.coefficients.groupBy("rep").pivot("term", names).agg(F.first("estimate")).toPandas()[names].to_numpy()
        n = len(wide)
        want = (n - 1) / n * (wide - wide.mean(axis=0)).T @ (wide - wide.mean(axis=0))
        assert reps.moments["jackknife"].count == n and np.allclose(reps.moments["jackknife"].jackknife(), want, rtol=1e-6)


def test_a_person_with_most_of_the_information_is_left_to_exact_passes(spark):
    """One person alone holds an arm; without it the term is lost."""
    rows = [(i, 0, int(i == 7), 0, float(i % 5), int(i % 3 == 0), 1) for i in range(60)]
    panel = spark.createDataFrame(rows, "id long, t int, A int, Ap int, X2 double, Y int, eligible int")
    plan = Plan(PanelSpec(visits=1), W.WeightDesigns(None), Design.of("X2", "assigned_treatment"), ("X2",), drop_order=("assigned_treatment",))
    with TrialAnalysis(panel, plan) as a:
        reps = a.jackknife()
        lost = reps.curves.filter("failed = 1").select("rep").distinct().collect()
        index = a._held[-1].filter("NOT good").select("idx").collect()
        assert len(lost) == 1 and lost[0][0] in {r[0] for r in index}
        assert reps.moments["jackknife"].failed == 1


def test_pairs_contract_to_quadratic_forms():
    rng = np.random.default_rng(1)
    x, d = rng.normal(size=(7, 4)), rng.normal(size=(7, 4))
    assert np.allclose((loo._pairs(x) * loo._square(d)).sum(axis=1), (x * d).sum(axis=1) ** 2)


def test_no_person_is_left_to_exact_passes(spark):
    """All persons are solved where they lie: the table of exact passes has no row, and can be read."""
    rows = [(i, 0, i // 2 % 2, 0, float(i % 5), int(i % 3 == 0), 1) for i in range(6000)]
    panel = spark.createDataFrame(rows, "id long, t int, A int, Ap int, X2 double, Y int, eligible int")
    plan = Plan(PanelSpec(visits=1), W.WeightDesigns(None), Design.of("assigned_treatment"), ("X2",))
    with TrialAnalysis(panel, plan) as a:
        reps = a.jackknife()
        assert a._held[-1].filter("NOT good").isEmpty()
        assert reps.curves.count() == 6000 and reps.coefficients.count() == 6000 * len(a.fit.design.names)
        assert reps.moments["jackknife"].count == 6000
