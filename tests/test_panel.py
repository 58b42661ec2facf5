import math

import pytest
from pyspark.sql import functions as F

from emulant.operators import panel as P
from emulant.operators import trials as E
from emulant.sources import adapters as S
from emulant.sources import tables as IO
from emulant.spec import PanelSpec, duplicate_keys, nan_to_null

SPEC = PanelSpec(visits=5)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def small(spark, data):
    return spark.createDataFrame(data, "id long, t int, A int, Y int, eligible int, X2 double")


def test_panel_matches_the_counts_of_the_fixture(spark, folder):
    p = S.order_panel(spark, folder)
    got = p.agg(
        F.count("*"), F.countDistinct("id"), F.sum("A"), F.sum("ev"), F.sum("eligible")
    ).first()
    assert tuple(got) == (633, 150, 289, 89, 288)
    assert duplicate_keys(p, "id", "t").isEmpty()


def test_dropout_keeps_the_visit_of_the_dropout(spark):
    df = spark.createDataFrame([(1, t, c) for t, c in enumerate([0, 1, 0, 1])], "id long, t int, C int")
    assert rows(P.mark_dropout(df, SPEC), "t", "dropped") == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_truncation_drops_rows_before_first_eligibility_and_after_events(spark):
    data = [(1, 0, 0, 0, 0), (1, 1, 1, 0, 0), (1, 2, 0, 0, 0), (1, 3, 0, 1, 0)]
    df = spark.createDataFrame(data, "id long, t int, eligible int, Yp int, C int")
    assert rows(P.truncate_followup(df, SPEC), "t") == [(1,), (2,)]


def test_time_on_regime_restarts_at_a_switch(spark):
    df = spark.createDataFrame([(1, t, a) for t, a in enumerate([0, 0, 1, 1, 1, 0])], "id long, t int, A int")
    got = rows(P.add_time_on_regime(df, SPEC), "t", "time_on_regime")
    assert [g[1] for g in got] == [0, 1, 0, 1, 2, 0]


def test_standardised_column_has_mean_zero_and_sd_one(spark, order_panel):
    out = P.standardise(order_panel, {"z": F.sqrt("spend")})
    mean, sd = out.agg(F.avg("z"), F.stddev_samp("z")).first()
    assert mean == pytest.approx(0, abs=1e-12) and sd == pytest.approx(1)


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(1, math.nan), (2, 1.0)], "id long, x double"))
    assert df.filter("x is null").count() == 1


def test_panel_survives_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1.5), (2, 0, None)], "id long, t int, x double")
    IO.write_table(df, str(tmp_path / "p"), "csv")
    back = IO.read_panel(spark, str(tmp_path / "p"), df.schema, "csv")
    assert rows(back, "id", "x") == [(1, 1.5), (2, None)]


# ---- expansion -------------------------------------------------------------


def test_row_expansion_has_the_sum_of_t_plus_one_rows(spark, order_panel):
    want = order_panel.agg(F.sum(F.col("t") + 1)).first()[0]
    assert E.expand_rows(order_panel, SPEC).count() == want


def by_hand(panel, estimand):
    """Trials by a plain loop over persons."""
    out = set()
    people = {}
    for r in panel.collect():
        people.setdefault(r["id"], []).append(r)
    for visits in people.values():
        visits.sort(key=lambda r: r["t"])
        for i, start in enumerate(visits):
            if start["eligible"] != 1:
                continue
            for now in visits[i:]:
                if estimand == "PP" and now["A"] != start["A"]:
                    break
                out.add((now["id"], start["t"], now["t"] - start["t"], start["A"], now["Y"], start["X2"]))
    return out


@pytest.mark.parametrize("estimand", ["PP", "ITT"])
def test_trials_equal_a_loop_over_persons(spark, order_panel, estimand):
    got = E.emulate_trials(order_panel, SPEC, ["X2"], estimand)
    columns = ("id", "trial_period", "followup_time", "assigned_treatment", "outcome", "X2")
    listed = rows(got, *columns)
    assert len(listed) == len(set(listed))
    assert set(listed) == by_hand(order_panel, estimand)


def test_trials_with_treated_restarts_and_gaps(spark):
    # Eligible again after a switch back, and a visit missing.
    data = [(1, 0, 0, 0, 1, 0.1), (1, 1, 1, 0, 1, 0.2), (1, 3, 1, 0, 0, 0.3), (1, 4, 0, 0, 1, 0.4)]
    df = small(spark, data)
    got = set(rows(E.emulate_trials(df, SPEC, ["X2"]), "id", "trial_period", "followup_time", "assigned_treatment", "outcome", "X2"))
    assert got == by_hand(df, "PP")


@pytest.mark.parametrize(
    "data, n",
    [
        ([], 0),
        ([(1, 0, 0, 0, 0, 0.0)], 0),
        ([(1, 0, 1, 1, 1, 0.0)], 1),
        ([(1, 0, 0, 0, 1, 0.0), (1, 1, 1, 0, 0, None)], 1),
        ([(1, 0, 0, 0, 1, None), (1, 1, 0, 0, 1, 0.0)], 3),
    ],
)
def test_edge_panels(spark, data, n):
    assert E.emulate_trials(small(spark, data), SPEC, ["X2"]).count() == n


def test_unknown_estimand_is_refused(spark, order_panel):
    with pytest.raises(ValueError):
        E.emulate_trials(order_panel, SPEC, estimand="XX")


def test_one_shuffle_for_panel_and_trials(spark, order_panel):
    base = spark.createDataFrame([(1, 0, 0, 0, 1, 0.0)], "id long, t int, A int, Y int, eligible int, X2 double")
    df = E.emulate_trials(P.add_time_on_regime(P.add_lags(base, SPEC, 2), SPEC), SPEC, ["X2"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
