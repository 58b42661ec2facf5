"""Queries over the panel: derived columns, joins, trial expansion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.functions.design import Level, Power, linear_time_terms, visit_terms
from emulant.functions.design import Design
from emulant.operators import panel as P
from emulant.operators import resample as R
from emulant.operators import scenarios as X
from emulant.operators import tabulate as B
from emulant.operators import trials as E
from emulant.plans import sql as Q
from emulant.plans.registry import query, rounded
from emulant.session import new_table_path
from emulant.sources import adapters as S
from emulant.sources import tables as IO
from emulant.spec import PanelSpec

VISITS = 5
SPEC = PanelSpec(visits=VISITS)
COVARIATES = ("X2", "X4", "c_mktsegment")


def panel(spark, folder):
    """Order panel over the first five years."""
    return S.order_panel(spark, folder).filter(F.col("t") < VISITS)


def histories(spark, folder):
    return S.order_histories(spark, folder)


def censored_panel(spark, folder):
    return S.drop_after_censoring(S.with_dropout_flag(panel(spark, folder)))


def trial_rows(spark, folder, estimand="PP"):
    return E.emulate_trials(panel(spark, folder), SPEC, COVARIATES, estimand)


# ---- sources and sinks ----------------------------------------------------


@query("panel_csv_round_trip", f"WITH {Q.PANEL} SELECT id, t, A, Ap, CAp, round(X2, 6) AS X2, round(X4, 6) AS X4, Y, Yp, eligible, 0 AS C FROM panel")
def panel_csv_round_trip(spark, folder):
    """Write the panel as CSV and read it with the fixed schema."""
    path = new_table_path(spark, "panel-csv")
    columns = ["id", "t", "A", "Ap", "CAp", "X2", "X4", "Y", "Yp", "eligible", F.lit(0).alias("C")]
    IO.write_table(panel(spark, folder).select(*columns), path, "csv")
    return rounded(IO.read_panel(spark, path, fmt="csv"))


@query("panel_parquet_read", f"WITH {Q.PANEL} SELECT id, t, A, Y, round(X2, 6) AS X2 FROM panel WHERE eligible = 1")
def panel_parquet_read(spark, folder):
    """Panel in parquet; filter and columns reach the scan."""
    path = new_table_path(spark, "panel")
    IO.write_table(panel(spark, folder).select("id", "t", "A", "X2", "Y", "eligible"), path)
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("t", T.IntegerType()),
            T.StructField("A", T.IntegerType()),
            T.StructField("X2", T.DoubleType()),
            T.StructField("Y", T.IntegerType()),
            T.StructField("eligible", T.IntegerType()),
        ]
    )
    read = IO.read_panel(spark, path, schema)
    return rounded(read.filter("eligible = 1").select("id", "t", "A", "Y", "X2"))


@query("results_partitioned_round_trip", f"WITH {Q.RESULTS} SELECT outcome, scenario, iter, visit, method, round(est, 6) AS est, round(lb, 6) AS lb, round(ub, 6) AS ub FROM ci WHERE outcome = 'low' AND scenario <= 9")
def results_partitioned_round_trip(spark, folder):
    """Write interval results by outcome and scenario, read back some folders."""
    path = new_table_path(spark, "results")
    IO.write_results(S.interval_results(spark, folder), path)
    read = IO.read_results(spark, path).filter((F.col("outcome") == "low") & (F.col("scenario") <= 9))
    return rounded(read.select("outcome", "scenario", "iter", "visit", "method", "est", "lb", "ub"))


# ---- derived columns --------------------------------------------------------


@query("lagged_treatment", f"WITH {Q.HISTORY} SELECT id, t, A, Ap, App FROM hist")
def lagged_treatment(spark, folder):
    return P.add_lags(histories(spark, folder).drop("Ap"), SPEC, 2).select("id", "t", "A", "Ap", "App")


@query("past_exposure", f"WITH {Q.HISTORY} SELECT id, t, A, CAp FROM hist")
def past_exposure(spark, folder):
    return P.add_cum_exposure(histories(spark, folder).drop("CAp"), SPEC).select("id", "t", "A", "CAp")


@query(
    "lag_exposure",
    f"""WITH {Q.HISTORY} SELECT id, t, (sum(CASE WHEN Ap = 1 OR App = 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY id ORDER BY t))::INTEGER AS CAp FROM hist""",
)
def lag_exposure(spark, folder):
    """Running count of visits with treatment at either of two lags, current row included."""
    lagged = P.add_lags(histories(spark, folder).drop("Ap", "CAp"), SPEC, 2)
    either = (F.col("Ap") == 1) | (F.col("App") == 1)
    return P.add_cum_exposure(lagged, SPEC, either, include_current=True).select("id", "t", "CAp")


@query("eligible_visits", f"WITH {Q.HISTORY} SELECT id, t, eligible FROM hist")
def eligible_visits(spark, folder):
    return P.add_eligible(histories(spark, folder), SPEC).select("id", "t", "eligible")


@query(
    "eligible_with_condition",
    f"WITH {Q.HISTORY} SELECT id, t, CASE WHEN eligible = 1 AND c_acctbal >= 1800 THEN 1 ELSE 0 END AS eligible FROM hist",
)
def eligible_with_condition(spark, folder):
    return P.add_eligible(histories(spark, folder), SPEC, F.col("c_acctbal") >= 1800).select("id", "t", "eligible")


@query(
    "dropout_marker",
    f"""WITH {Q.HISTORY}, f AS (SELECT *, CASE WHEN id % 7 = 0 AND t = (id // 7) % 4 THEN 1 ELSE 0 END AS C FROM hist)
    SELECT id, t, C, coalesce(max(C) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS dropped FROM f""",
)
def dropout_marker(spark, folder):
    flagged = S.with_dropout_flag(histories(spark, folder))
    return P.mark_dropout(flagged, SPEC).select("id", "t", "C", "dropped")


@query(
    "truncated_followup",
    f"""WITH {Q.HISTORY}, f AS (SELECT *, CASE WHEN id % 7 = 0 AND t = (id // 7) % 4 THEN 1 ELSE 0 END AS C,
      CASE WHEN eligible = 1 AND t >= id % 3 THEN 1 ELSE 0 END AS starts FROM hist),
    m AS (SELECT *, coalesce(max(C) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS dropped, sum(starts) OVER (PARTITION BY id ORDER BY t) AS ever FROM f)
    SELECT id, t, Y, C FROM m WHERE dropped = 0 AND Yp = 0 AND ever > 0""",
)
def truncated_followup(spark, folder):
    flagged = S.with_dropout_flag(histories(spark, folder))
    late = P.add_eligible(flagged, SPEC, F.col("t") >= F.col("id") % 3)
    return P.truncate_followup(late, SPEC).select("id", "t", "Y", "C")


@query("absorbing_outcome", f"WITH {Q.HISTORY} SELECT id, t, Y, Yp FROM hist")
def absorbing_outcome(spark, folder):
    return P.carry_outcome(histories(spark, folder).drop("Y", "Yp"), SPEC, "ev").select("id", "t", "Y", "Yp")


@query(
    "standardised_covariates",
    f"""WITH {Q.HISTORY}, x AS (SELECT id, t, sqrt(spend) AS a, log10(spend + 1) AS b FROM hist),
    s AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM x)
    SELECT id, t, round((a - ma) / sa, 6) AS root_spend, round((b - mb) / sb, 6) AS log_spend FROM x, s""",
)
def standardised_covariates(spark, folder):
    out = P.standardise(
        histories(spark, folder), {"root_spend": F.sqrt("spend"), "log_spend": F.log10(F.col("spend") + 1)}
    )
    return rounded(out.select("id", "t", "root_spend", "log_spend"))


@query("scaled_covariate", "SELECT c_custkey AS id, round((c_acctbal - 35) / 12, 6) AS acct_s FROM customer")
def scaled_covariate(spark, folder):
    rows = S.table(spark, folder, "customer")
    return rounded(rows.select(F.col("c_custkey").alias("id"), P.affine("c_acctbal", 35, 12).alias("acct_s")))


@query(
    "recoded_segment",
    """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 3 END
    AS site FROM customer""",
)
def recoded_segment(spark, folder):
    rows = S.table(spark, folder, "customer")
    seg = F.col("c_mktsegment")
    site = P.recode([(seg == "BUILDING", 1), (seg == "MACHINERY", 2)], 3)
    return rows.select(F.col("c_custkey").alias("id"), site.alias("site"))


@query(
    "segment_dummies",
    "SELECT c_custkey AS id, "
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS seg_{i}" for i, s in enumerate(S.SEGMENTS) if i)
    + " FROM customer",
)
def segment_dummies(spark, folder):
    rows = S.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return P.dummies(rows, "c_mktsegment", S.SEGMENTS, "seg").drop("c_mktsegment")


@query("shifted_visits", "SELECT o_orderkey, (year(o_orderdate) - 1995)::INTEGER AS t FROM orders")
def shifted_visits(spark, folder):
    rows = S.table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("visit"))
    return P.shift_time(rows, "visit", 1995).select("o_orderkey", "t")


@query(
    "followup_dummies",
    f"WITH {Q.PANEL} {Q.TRIALS} SELECT id, trial_period, followup_time, "
    + ", ".join(f"CASE WHEN followup_time = {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS t_{k}" for k in range(1, VISITS))
    + " FROM pp",
)
def followup_dummies(spark, folder):
    rows = trial_rows(spark, folder).select("id", "trial_period", "followup_time")
    return E.followup_dummies(rows, VISITS)


@query(
    "visit_interactions",
    f"WITH {Q.PANEL} {Q.TRIALS} SELECT id, trial_period, followup_time, "
    + ", ".join(
        f"round(CASE WHEN followup_time = {k} THEN {c} ELSE 0.0 END, 6)::DOUBLE AS \"t_{k}{n}\""
        for c, n in (("assigned_treatment", "A"), ("X2", "X2"), ("X4", "X4"))
        for k in range(1, VISITS)
    )
    + " FROM pp",
)
def visit_interactions(spark, folder):
    rows = trial_rows(spark, folder).select("id", "trial_period", "followup_time", "assigned_treatment", "X2", "X4")
    names = [f"t_{k}{n}" for n in ("A", "X2", "X4") for k in range(1, VISITS)]
    out = E.interactions(rows, visit_terms(VISITS, ["X2", "X4"]))
    return rounded(out.select("id", "trial_period", "followup_time", *names))


@query(
    "linear_interactions",
    f"""WITH {Q.PANEL} {Q.TRIALS} SELECT id, trial_period, followup_time, followup_time * followup_time AS followup_time2,
    (followup_time * assigned_treatment)::DOUBLE AS "tA", round(followup_time * X2, 6) AS "tX2",
    round(followup_time * X4, 6) AS "tX4" FROM pp""",
)
def linear_interactions(spark, folder):
    rows = trial_rows(spark, folder)
    out = E.interactions(rows, linear_time_terms(["X2", "X4"]))
    square = (F.col("followup_time") * F.col("followup_time")).alias("followup_time2")
    return rounded(out.select("id", "trial_period", "followup_time", square, "tA", "tX2", "tX4"))


@query(
    "treatment_by_covariate",
    f"WITH {Q.PANEL} {Q.TRIALS} SELECT id, trial_period, followup_time, round(assigned_treatment * X2, 6) AS \"AX2\" FROM pp",
)
def treatment_by_covariate(spark, folder):
    out = E.product(trial_rows(spark, folder), "assigned_treatment", "X2", "AX2")
    return rounded(out.select("id", "trial_period", "followup_time", "AX2"))


def _strategy_sql(a: int) -> str:
    return f"""SELECT {a} AS strategy, id, trial_period, followup_time, {a} AS assigned_treatment,
    round({a} * X2, 6)::DOUBLE AS "AX2", (CASE WHEN followup_time = 1 THEN {a} ELSE 0 END)::DOUBLE AS "t_1A" FROM pp"""


@query("both_strategies", f"WITH {Q.PANEL} {Q.TRIALS} {_strategy_sql(1)} UNION ALL {_strategy_sql(0)}")
def both_strategies(spark, folder):
    """Everybody treated and nobody treated, with the treatment terms recomputed."""
    from emulant.functions.design import Term

    design = Design.of(
        Term("AX2", (Power("assigned_treatment"), Power("X2"))),
        Term("t_1A", (Level("followup_time", 1), Power("assigned_treatment"))),
    )
    rows = E.interactions(trial_rows(spark, folder), design)
    keep = ["id", "trial_period", "followup_time", "assigned_treatment", "AX2", "t_1A"]
    arms = [B.tag(E.set_strategy(rows, a, design).select(*keep), {"strategy": a}) for a in (1, 0)]
    return rounded(arms[0].unionByName(arms[1]))


@query(
    "filtered_trial_rows",
    f"""WITH {Q.PANEL} {Q.TRIALS} SELECT id, assigned_treatment, outcome FROM pp
    WHERE followup_time = 0 AND trial_period = 0 AND assigned_treatment = 1 AND X2 IS NOT NULL""",
)
def filtered_trial_rows(spark, folder):
    rows = trial_rows(spark, folder)
    rows = rows.filter("followup_time = 0 and trial_period = 0 and assigned_treatment = 1").dropna(subset=["X2"])
    return rows.select("id", "assigned_treatment", "outcome")


@query(
    "renamed_columns",
    f"WITH {Q.PANEL} {Q.TRIALS} SELECT id AS \"ID\", trial_period AS for_period, followup_time, outcome AS event FROM pp",
)
def renamed_columns(spark, folder):
    rows = trial_rows(spark, folder).drop("X2", "X4", "c_mktsegment", "assigned_treatment")
    return rows.withColumnsRenamed({"id": "ID", "trial_period": "for_period", "outcome": "event"})


@query(
    "time_on_regime",
    f"""WITH {Q.HISTORY}, s AS (SELECT *, CASE WHEN A <> lag(A) OVER (PARTITION BY id ORDER BY t) THEN 1 ELSE 0 END AS sw
    FROM hist), r AS (SELECT *, sum(sw) OVER (PARTITION BY id ORDER BY t) AS run FROM s),
    c AS (SELECT id, t, (row_number() OVER (PARTITION BY id, run ORDER BY t) - 1)::INTEGER AS time_on_regime FROM r)
    SELECT id, t, time_on_regime, time_on_regime * time_on_regime AS time_on_regime_sq FROM c""",
)
def time_on_regime(spark, folder):
    out = P.add_time_on_regime(histories(spark, folder), SPEC)
    return out.select("id", "t", "time_on_regime", "time_on_regime_sq")


@query(
    "first_and_last_visit",
    f"""WITH {Q.PANEL} SELECT 'first' AS which, id, min(t) AS t, arg_min(A, t) AS A, arg_min(Y, t) AS Y FROM panel GROUP BY id
    UNION ALL SELECT 'last', id, max(t), arg_max(A, t), arg_max(Y, t) FROM panel GROUP BY id""",
)
def first_and_last_visit(spark, folder):
    rows = panel(spark, folder).select("id", "t", "A", "Y")
    first = B.tag(P.first_rows(rows, SPEC), {"which": "first"})
    return first.unionByName(B.tag(P.last_rows(rows, SPEC), {"which": "last"}))


@query(
    "baseline_covariate",
    f"WITH {Q.PANEL} SELECT id, t, round(first_value(spend) OVER (PARTITION BY id ORDER BY t), 6) AS spend FROM panel",
)
def baseline_covariate(spark, folder):
    return rounded(P.baseline_values(panel(spark, folder), SPEC, ["spend"]).select("id", "t", "spend"))


# ---- joins -------------------------------------------------------------------


def _probs(rows, stratum, name):
    """Group means as fitted probabilities of one stratum."""
    fitted = rows.filter(F.col("Ap") == stratum).groupBy("c_mktsegment").agg(F.avg("A").alias(name))
    keys = rows.filter(F.col("Ap") == stratum).select("id", "t", "c_mktsegment")
    return keys.join(fitted, "c_mktsegment").select("id", "t", name)


@query(
    "panel_with_probabilities",
    f"""WITH {Q.PANEL} SELECT id, t, A, Ap, round(CASE WHEN Ap = 0 THEN avg(A) OVER (PARTITION BY Ap, c_mktsegment) END, 6)
    AS p0_d, round(CASE WHEN Ap = 1 THEN avg(A) OVER (PARTITION BY Ap, c_mktsegment) END, 6) AS p1_d FROM panel""",
)
def panel_with_probabilities(spark, folder):
    rows = panel(spark, folder)
    out = X.attach_probs(rows, _probs(rows, 0, "p0_d"))
    out = X.attach_probs(out, _probs(rows, 1, "p1_d"))
    return rounded(out.select("id", "t", "A", "Ap", "p0_d", "p1_d"))


@query(
    "numerators_with_denominators",
    f"""WITH {Q.PANEL} SELECT id, t, round(avg(A) OVER (), 6) AS p0_n,
    round(avg(A) OVER (PARTITION BY c_mktsegment), 6) AS p0_d FROM panel WHERE Ap = 0""",
)
def numerators_with_denominators(spark, folder):
    rows = panel(spark, folder)
    untreated = rows.filter("Ap = 0")
    overall = untreated.agg(F.avg("A")).scalar()
    num = untreated.select("id", "t", overall.alias("p0_n"))
    return rounded(X.pair_num_den(_probs(rows, 0, "p0_d"), num))


@query(
    "full_prediction_keys",
    f"""WITH {Q.PANEL}, i AS (SELECT DISTINCT id FROM panel) SELECT id, a.k::INTEGER AS trial_period, b.k::INTEGER AS followup_time
    FROM i, range(0, 5) a(k), range(0, 5) b(k) WHERE 5 - a.k > b.k""",
)
def full_prediction_keys(spark, folder):
    return X.cross_grid(panel(spark, folder), VISITS)


@query(
    "observations_on_grid",
    f"""WITH {Q.PANEL} {Q.TRIALS}, i AS (SELECT DISTINCT id FROM pp), k AS (SELECT id, a.k::INTEGER AS trial_period,
    b.k::INTEGER AS followup_time FROM i, range(0, 5) a(k), range(0, 5) b(k) WHERE 5 - a.k > b.k)
    SELECT id, trial_period, followup_time, round(X2, 6) AS "X2", outcome FROM k LEFT JOIN pp USING (id, trial_period, followup_time)""",
)
def observations_on_grid(spark, folder):
    rows = trial_rows(spark, folder).select("id", "trial_period", "followup_time", "X2", "outcome")
    return rounded(X.onto_grid(rows, X.cross_grid(rows, VISITS)))


@query(
    "observed_trials_on_grid",
    f"""WITH {Q.PANEL} {Q.TRIALS}, i AS (SELECT DISTINCT id, trial_period FROM pp) SELECT id, trial_period,
    b.k::INTEGER AS followup_time FROM i, range(0, 5) b(k) WHERE 5 - trial_period > b.k""",
)
def observed_trials_on_grid(spark, folder):
    rows = trial_rows(spark, folder)
    return X.observed_pairs(X.cross_grid(rows, VISITS), rows)


@query(
    "scenario_grid",
    f"WITH {Q.ESTIMATES} {Q.GRID} SELECT scenario, size, conf, treat, count(*) AS iterations FROM grid JOIN est USING (scenario)"
    " WHERE visit = 0 GROUP BY ALL",
)
def scenario_grid(spark, folder):
    """The 27 settings with the number of iterations each of them has."""
    grid = X.crossing(spark, {"size": S.SIZES, "conf": S.CONFOUNDING, "treat": S.TREATMENT})
    est = S.replicate_estimates(spark, folder).filter("visit = 0").groupBy("scenario")
    return grid.join(est.agg(F.count(F.lit(1)).alias("iterations")), "scenario")


@query(
    "rows_of_drawn_persons",
    f"WITH {Q.PANEL} {Q.TRIALS} {Q.draws(1, 5)} SELECT id, t, A FROM panel WHERE id IN (SELECT id FROM drawn)",
)
def rows_of_drawn_persons(spark, folder):
    rows = panel(spark, folder)
    counts = R.bootstrap_counts(trial_rows(spark, folder), 1, 5)
    return R.keep_ids(rows, counts).select("id", "t", "A")


@query("rows_without_one_person", f"WITH {Q.PANEL} SELECT id, t, A FROM panel WHERE id <> 17")
def rows_without_one_person(spark, folder):
    return R.drop_id(panel(spark, folder), 17).select("id", "t", "A")


# ---- trials --------------------------------------------------------------------


@query(
    "row_expansion",
    f"WITH {Q.PANEL} SELECT id, t, k.k::INTEGER AS trial_period, (t - k.k)::INTEGER AS followup_time FROM panel, range(0, 5) k(k) WHERE k.k <= t",
)
def row_expansion(spark, folder):
    return E.expand_rows(panel(spark, folder).select("id", "t"), SPEC)


@query(
    "per_protocol_trials",
    f"""WITH {Q.PANEL} {Q.TRIALS} SELECT id, trial_period, followup_time, assigned_treatment, outcome,
    round(X2, 6) AS "X2", round(X4, 6) AS "X4", c_mktsegment FROM pp""",
)
def per_protocol_trials(spark, folder):
    return rounded(trial_rows(spark, folder))


@query(
    "intention_to_treat_trials",
    f"""WITH {Q.PANEL} {Q.TRIALS} SELECT id, trial_period, followup_time, assigned_treatment, outcome,
    round(X2, 6) AS "X2", round(X4, 6) AS "X4", c_mktsegment FROM itt""",
)
def intention_to_treat_trials(spark, folder):
    return rounded(trial_rows(spark, folder, "ITT"))


@query(
    "as_treated_trials",
    f"WITH {Q.PANEL} {Q.TRIALS} SELECT id, trial_period, followup_time, assigned_treatment, outcome, treatment FROM itt",
)
def as_treated_trials(spark, folder):
    return trial_rows(spark, folder, "AT").drop(*COVARIATES)


@query("first_trial_rows", f"WITH {Q.PANEL} {Q.TRIALS} SELECT id, followup_time, assigned_treatment, outcome FROM pp WHERE trial_period = 0")
def first_trial_rows(spark, folder):
    rows = E.restrict_trials(trial_rows(spark, folder), [0])
    return rows.select("id", "followup_time", "assigned_treatment", "outcome")


@query(
    "censored_trials",
    f"WITH {Q.CENSORED} {Q.TRIALS} SELECT id, trial_period, followup_time, assigned_treatment, outcome FROM pp",
)
def censored_trials(spark, folder):
    rows = E.emulate_trials(censored_panel(spark, folder), SPEC)
    return rows.select("id", "trial_period", "followup_time", "assigned_treatment", "outcome")


@query(
    "event_stream_trials",
    f"WITH {Q.EVENT_PANEL} {Q.TRIALS} SELECT id, trial_period, followup_time, assigned_treatment, outcome, round(X2, 6) AS \"X2\", round(X4, 6) AS \"X4\" FROM pp",
)
def event_stream_trials(spark, folder):
    rows = S.event_panel(spark, folder).filter("t <= 2")
    return rounded(E.emulate_trials(rows, PanelSpec(visits=3), ["X2", "X4"]))


@query(
    "sampled_controls",
    f"""WITH {Q.PANEL} {Q.TRIALS} SELECT id, trial_period, followup_time, outcome,
    CASE WHEN outcome = 1 THEN 1.0 ELSE 4.0 END::DOUBLE AS sample_weight FROM pp WHERE outcome = 1 OR
    ('0x' || substr(md5('3|' || id || '|' || trial_period || '|' || followup_time), 1, 15))::BIGINT % 1000000 < 250000""",
)
def sampled_controls(spark, folder):
    rows = E.sample_controls(trial_rows(spark, folder), 0.25, 3)
    return rows.select("id", "trial_period", "followup_time", "outcome", "sample_weight")


# ---- tables of counts ------------------------------------------------------------

_TRIAL_CELLS = f"WITH {Q.PANEL} {Q.TRIALS}"


@query(
    "trial_event_table",
    f"""{_TRIAL_CELLS}, c AS (SELECT assigned_treatment, outcome, followup_time, count(*) AS n FROM pp GROUP BY 1, 2, 3)
    SELECT a.assigned_treatment, b.outcome, d.followup_time, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT assigned_treatment FROM pp) a CROSS JOIN (SELECT DISTINCT outcome FROM pp) b
    CROSS JOIN (SELECT DISTINCT followup_time FROM pp) d LEFT JOIN c USING (assigned_treatment, outcome, followup_time)""",
)
def trial_event_table(spark, folder):
    """Person-trials by arm, outcome and follow-up, zero cells included."""
    return B.crosstab_full(trial_rows(spark, folder), ["assigned_treatment", "outcome", "followup_time"])


@query(
    "six_way_table",
    f"""{_TRIAL_CELLS}, x AS (SELECT *, CASE WHEN X4 > 4 THEN 'rich' ELSE 'poor' END AS wealth FROM pp),
    c AS (SELECT c_mktsegment, wealth, trial_period, assigned_treatment, outcome, followup_time, count(*) AS n FROM x GROUP BY ALL)
    SELECT c_mktsegment, wealth, trial_period, assigned_treatment, outcome, followup_time, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT c_mktsegment FROM x) CROSS JOIN (SELECT DISTINCT wealth FROM x) CROSS JOIN (SELECT DISTINCT trial_period FROM x)
    CROSS JOIN (SELECT DISTINCT assigned_treatment FROM x) CROSS JOIN (SELECT DISTINCT outcome FROM x)
    CROSS JOIN (SELECT DISTINCT followup_time FROM x)
    LEFT JOIN c USING (c_mktsegment, wealth, trial_period, assigned_treatment, outcome, followup_time)""",
)
def six_way_table(spark, folder):
    rows = trial_rows(spark, folder).withColumn("wealth", F.when(F.col("X4") > 4, "rich").otherwise("poor"))
    dims = ["c_mktsegment", "wealth", "trial_period", "assigned_treatment", "outcome", "followup_time"]
    return B.crosstab_full(rows, dims)


@query("trials_started_per_visit", f"{_TRIAL_CELLS} SELECT trial_period, assigned_treatment, count(*) AS n FROM pp WHERE followup_time = 0 GROUP BY 1, 2")
def trials_started_per_visit(spark, folder):
    rows = trial_rows(spark, folder).filter("followup_time = 0")
    return B.count_by(rows, ["trial_period", "assigned_treatment"])


@query(
    "person_trial_totals",
    f"""WITH {Q.CENSORED} {Q.TRIALS}, p AS (SELECT pp.id, trial_period, assigned_treatment, sum(outcome)::BIGINT AS outcome,
    sum(panel.C)::BIGINT AS "C" FROM pp JOIN panel ON panel.id = pp.id AND panel.t = pp.now GROUP BY 1, 2, 3)
    SELECT assigned_treatment, trial_period, outcome, "C", count(*) AS n FROM p GROUP BY ALL""",
)
def person_trial_totals(spark, folder):
    """Trials by arm, start, whether the event and whether drop-out came."""
    rows = E.emulate_trials(censored_panel(spark, folder), SPEC, carry=["C"])
    return B.person_trial_totals(rows, ["outcome", "C"], ["assigned_treatment", "trial_period"])


@query("events_by_arm_and_visit", f"{_TRIAL_CELLS} SELECT followup_time, assigned_treatment, sum(outcome)::BIGINT AS events FROM pp GROUP BY 1, 2")
def events_by_arm_and_visit(spark, folder):
    return B.event_counts(trial_rows(spark, folder), ["followup_time", "assigned_treatment"])


@query("total_events", f"WITH {Q.PANEL} SELECT sum(Y)::BIGINT AS events FROM panel")
def total_events(spark, folder):
    return B.total_events(panel(spark, folder))


@query("distinct_trials", f"{_TRIAL_CELLS} SELECT DISTINCT id, trial_period FROM pp")
def distinct_trials(spark, folder):
    return trial_rows(spark, folder).select("id", "trial_period").distinct()


@query("person_number", f"{_TRIAL_CELLS} SELECT count(DISTINCT id) AS persons, max(id) AS largest_id FROM pp")
def person_number(spark, folder):
    return trial_rows(spark, folder).agg(F.countDistinct("id").alias("persons"), F.max("id").alias("largest_id"))
