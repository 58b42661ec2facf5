"""Queries over tables of replicates: bias, coverage, width, failures, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from emulant.operators import evaluate as V
from emulant.operators import intervals as I
from emulant.operators import scenarios as X
from emulant.operators import tabulate as B
from emulant.operators.quantiles import quantile_table
from emulant.plans import sql as Q
from emulant.plans.queries_panel import trial_rows
from emulant.plans.registry import query, rounded
from emulant.sources import adapters as S
from emulant.spec import METHODS, PIVOT_METHODS

LAST_VISIT = 4
CELL = "outcome, scenario, visit"
_EST = f"WITH {Q.ESTIMATES} {Q.TRUTH}"
_CI = f"WITH {Q.RESULTS} {Q.TRUTH}"
_GRID = f"WITH {Q.RESULTS} {Q.GRID}"
_PIVOT = "('bootstrap','lef_outcome','lef_both')"
_LIMITS = f""", lim AS (SELECT ci.*, truth.mrd AS target, CASE WHEN method IN {_PIVOT} THEN 2 * est - ub ELSE lb END AS low,
    CASE WHEN method IN {_PIVOT} THEN 2 * est - lb ELSE ub END AS high FROM ci JOIN truth USING ({CELL}))"""


def grid(spark):
    return X.crossing(spark, {"size": S.SIZES, "conf": S.CONFOUNDING, "treat": S.TREATMENT})


def est(spark, folder):
    return S.replicate_estimates(spark, folder)


def ci(spark, folder):
    return S.interval_results(spark, folder)


def truth(spark, folder):
    return S.scenario_truth(spark, folder)


def pivotal_coverage_table(spark, folder):
    return V.coverage(ci(spark, folder), truth(spark, folder), pivot=PIVOT_METHODS)


# ---- point estimates -----------------------------------------------------------


@query(
    "bias",
    f"""{_EST} SELECT {CELL}, round(avg(est) - any_value(truth.mrd), 6) AS bias_est, round(avg(est.surv0) - any_value(truth.surv0), 6) AS bias_surv0,
    round(avg(est.surv1) - any_value(truth.surv1), 6) AS bias_surv1 FROM est JOIN truth USING ({CELL}) GROUP BY ALL""",
)
def bias(spark, folder):
    """Bias of the risk difference and of both survival curves."""
    values = {"est": "mrd", "surv0": "surv0", "surv1": "surv1"}
    return rounded(V.bias(est(spark, folder), truth(spark, folder), values=values))


@query("empirical_sd", f"{_EST} SELECT {CELL}, round(stddev_samp(est), 6) AS sd FROM est GROUP BY ALL")
def empirical_sd(spark, folder):
    return rounded(V.empirical_sd(est(spark, folder)))


_ACC = f""", acc AS (SELECT {CELL}, avg(est) - any_value(truth.mrd) AS b, stddev_samp(est) AS sd FROM est JOIN truth USING ({CELL}) GROUP BY ALL)"""


@query("root_mean_squared_error", f"{_EST} {_ACC} SELECT {CELL}, round(sqrt(b * b + sd * sd), 6) AS rmse FROM acc")
def root_mean_squared_error(spark, folder):
    return rounded(V.rmse(est(spark, folder), truth(spark, folder)))


@query("bias_sd_ratio", f"{_EST} {_ACC} SELECT {CELL}, round(b / sd, 5) AS bias_sd_ratio FROM acc WHERE sd > 1e-4")
def bias_sd_ratio(spark, folder):
    out = V.accuracy(est(spark, folder), truth(spark, folder)).filter("sd > 1e-4")
    return rounded(out.drop("bias", "sd", "rmse"), 5)


@query(
    "se_ratio",
    f"""WITH {Q.RESULTS}, se AS (SELECT {CELL}, method, iter, (ub - lb) / 3.919928 AS se FROM ci), sd AS (SELECT {CELL}, stddev_samp(est) AS sd
    FROM est GROUP BY ALL) SELECT {CELL}, method, iter, round(se / sd, 4) AS se_ratio FROM se JOIN sd USING ({CELL}) WHERE sd > 1e-4""",
)
def se_ratio(spark, folder):
    """Standard error of every method and iteration over the SD of the estimates."""
    errors = ci(spark, folder).select(
        "outcome", "scenario", "visit", "method", "iter", ((F.col("ub") - F.col("lb")) / 3.919928).alias("se")
    )
    out = V.se_ratio(errors, est(spark, folder)).filter("sd > 1e-4")
    return rounded(out.select("outcome", "scenario", "visit", "method", "iter", "se_ratio"), 4)


@query(
    "replicate_standard_errors",
    "SELECT l_orderkey AS iter, round(stddev_samp(l_discount - l_tax), 6) AS se FROM lineitem GROUP BY 1",
)
def replicate_standard_errors(spark, folder):
    """SD over the replicates (lines) of each iteration (order)."""
    reps = S.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("iter"), (F.col("l_discount") - F.col("l_tax")).alias("mrd")
    )
    return rounded(I.replicate_se(reps, ["iter"]))


# ---- coverage --------------------------------------------------------------------


def _coverage_sql(hit: str, tail: str = "") -> str:
    return f"""{_CI} {_LIMITS}{tail} SELECT {CELL}, method, round(avg(CASE WHEN lb IS NOT NULL THEN CASE WHEN {hit} THEN 1.0 ELSE 0.0 END END), 6)
    AS coverage, count(lb) AS intervals FROM lim GROUP BY ALL"""


@query("percentile_coverage", _coverage_sql("lb <= target AND ub >= target"))
def percentile_coverage(spark, folder):
    return rounded(V.coverage(ci(spark, folder), truth(spark, folder)))


@query("pivotal_coverage", _coverage_sql("low <= target AND high >= target"))
def pivotal_coverage(spark, folder):
    """Pivoted limits for the bootstrap methods, plain limits for the others."""
    return rounded(pivotal_coverage_table(spark, folder))


@query("strict_coverage", _coverage_sql("lb < target AND ub > target"))
def strict_coverage(spark, folder):
    return rounded(V.coverage(ci(spark, folder), truth(spark, folder), closed=False))


@query(
    "bias_eliminated_coverage",
    f"""{_CI}, bi AS (SELECT {CELL}, round(avg(est) - any_value(truth.mrd), 8) AS b FROM est JOIN truth USING ({CELL}) GROUP BY ALL) {_LIMITS}
    SELECT {CELL}, method, round(avg(CASE WHEN lb IS NOT NULL THEN CASE WHEN low <= target + b AND high >= target + b THEN 1.0 ELSE 0.0 END END), 6)
    AS coverage, count(lb) AS intervals FROM lim JOIN bi USING ({CELL}) GROUP BY ALL""",
)
def bias_eliminated_coverage(spark, folder):
    """Pivotal coverage of the target shifted by the bias."""
    known = truth(spark, folder)
    shift = rounded(V.bias(est(spark, folder), known), 8)
    return rounded(V.coverage(ci(spark, folder), known, pivot=PIVOT_METHODS, shift=shift))


@query(
    "simultaneous_coverage",
    f"""{_CI}, it AS (SELECT outcome, scenario, method, iter, min(CASE WHEN coalesce(lb < mrd AND ub > mrd, false) THEN 1 ELSE 0 END) AS a,
      max(CASE WHEN visit = {LAST_VISIT} AND lb IS NOT NULL THEN 1 ELSE 0 END) AS ok FROM ci JOIN truth USING ({CELL}) GROUP BY ALL)
    SELECT outcome, scenario, method, round(avg(a), 6) AS coverage, count(*) AS iterations FROM it WHERE ok = 1 GROUP BY ALL""",
)
def simultaneous_coverage(spark, folder):
    """All visits of an iteration inside strict bounds, success judged at the last visit."""
    return rounded(V.coverage_simultaneous(ci(spark, folder), truth(spark, folder), LAST_VISIT))


@query(
    "coverage_of_limit_value",
    f"""{_CI}, lv AS (SELECT outcome, visit, round(avg(est), 6) AS target FROM est GROUP BY 1, 2)
    SELECT {CELL}, method, round(avg(CASE WHEN lb IS NOT NULL THEN CASE WHEN lb <= target AND ub >= target THEN 1.0 ELSE 0.0 END END), 6) AS coverage,
    count(lb) AS intervals FROM ci JOIN lv USING (outcome, visit) GROUP BY ALL""",
)
def coverage_of_limit_value(spark, folder):
    """Coverage of a second target: the large-sample limit of the estimator."""
    limit = rounded(V.replicate_mean(est(spark, folder), ["outcome", "visit"]))
    return rounded(V.coverage(ci(spark, folder), limit, on=["outcome", "visit"]))


@query(
    "coverage_standard_error",
    f"""{_CI} {_LIMITS}, c AS (SELECT {CELL}, method, avg(CASE WHEN lb IS NOT NULL THEN CASE WHEN low <= target AND high >= target THEN 1.0 ELSE 0.0 END END)
    AS coverage FROM lim GROUP BY ALL) SELECT {CELL}, method, round(coverage, 6) AS coverage, round(sqrt(coverage * (1 - coverage) / 1000), 6) AS mc_se FROM c""",
)
def coverage_standard_error(spark, folder):
    """Monte-Carlo standard error of the coverage over 1000 planned iterations."""
    return rounded(V.mc_se(pivotal_coverage_table(spark, folder), 1000).drop("intervals"))


# ---- widths and failures --------------------------------------------------------------

_WIDTH = f"WITH {Q.RESULTS}, w AS (SELECT *, abs(ub - lb) AS w FROM ci)"


@query(
    "interval_width",
    f"""{_WIDTH} SELECT {CELL}, method, round(avg(w), 6) AS mean_width, round(avg(w) - stddev_samp(w), 6) AS low_width,
    round(avg(w) + stddev_samp(w), 6) AS high_width FROM w GROUP BY ALL""",
)
def interval_width(spark, folder):
    return rounded(V.ci_width(ci(spark, folder)))


@query("interval_width_sd", f"{_WIDTH} SELECT {CELL}, method, round(stddev_samp(w), 6) AS sd_width FROM w GROUP BY ALL")
def interval_width_sd(spark, folder):
    return rounded(V.ci_width(ci(spark, folder), "sd"))


@query("interval_width_median", f"{_WIDTH} SELECT {CELL}, method, round(median(w), 6) AS median_width FROM w WHERE w IS NOT NULL GROUP BY ALL")
def interval_width_median(spark, folder):
    return rounded(V.ci_width(ci(spark, folder), "median"))


@query(
    "interval_width_over_visits",
    f"""WITH {Q.RESULTS}, v AS (SELECT {CELL}, method, avg(ub - lb) AS w FROM ci GROUP BY ALL)
    SELECT outcome, scenario, method, round(avg(w), 6) AS mean_width, round(stddev_samp(w), 6) AS sd_width FROM v GROUP BY ALL""",
)
def interval_width_over_visits(spark, folder):
    return rounded(V.ci_width_two_level(ci(spark, folder)))


@query(
    "failure_rate",
    f"""{_GRID}, it AS (SELECT outcome, scenario, count(*) AS iters FROM est WHERE visit = 0 GROUP BY ALL),
    f AS (SELECT outcome, scenario, method, count(lb) AS ok FROM ci WHERE visit = 0 GROUP BY ALL)
    SELECT outcome, size, treat, method, CASE WHEN method NOT LIKE 'jackknife%' OR size = 200 THEN round(avg((iters - ok) / iters), 6) END AS failure_rate
    FROM f JOIN it USING (outcome, scenario) JOIN grid USING (scenario) GROUP BY outcome, size, treat, method""",
)
def failure_rate(spark, folder):
    planned = est(spark, folder).filter("visit = 0").groupBy("outcome", "scenario")
    scenarios = planned.agg(F.count(F.lit(1)).alias("iters")).join(grid(spark), "scenario")
    return rounded(V.failure_rate(ci(spark, folder), "iters", scenarios))


@query(
    "mean_time",
    f"""{_GRID}, tm AS (SELECT outcome, scenario, method, iter, (ub - lb) * 100 AS seconds FROM ci WHERE visit = 0)
    SELECT outcome, size, method, round(avg(seconds), 6) AS mean_seconds FROM tm JOIN grid USING (scenario) GROUP BY ALL""",
)
def mean_time(spark, folder):
    """Mean time per method, outcome and sample size (times stand-in: scaled widths)."""
    times = ci(spark, folder).filter("visit = 0").withColumn("seconds", (F.col("ub") - F.col("lb")) * 100)
    return rounded(V.mean_time(times.join(grid(spark), "scenario"), ["outcome", "size", "method"]))


# ---- reshaping and ranking -----------------------------------------------------------------

_COV = f"""{_CI} {_LIMITS}, c AS (SELECT visit, scenario, method, round(avg(CASE WHEN lb IS NOT NULL THEN CASE WHEN low <= target AND high >= target
    THEN 1.0 ELSE 0.0 END END), 6) AS coverage FROM lim WHERE outcome = 'low' GROUP BY ALL)"""


def low_coverage(spark, folder, pivot=PIVOT_METHODS):
    rows = ci(spark, folder).filter("outcome = 'low'")
    out = V.coverage(rows, truth(spark, folder), by=["visit", "scenario", "method"], pivot=pivot)
    return rounded(out.drop("intervals"))


@query("ranked_methods", f"{_COV} SELECT visit, scenario, method, coverage, dense_rank() OVER (PARTITION BY visit, scenario ORDER BY coverage DESC)::INTEGER AS rank FROM c")
def ranked_methods(spark, folder):
    return V.rank_methods(low_coverage(spark, folder))


@query(
    "wide_to_long_coverage",
    f"{_COV} SELECT visit, scenario, method, coverage AS value FROM c UNION SELECT DISTINCT v.visit, v.scenario, m.method, NULL FROM c v, meth m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.visit = v.visit AND c.scenario = v.scenario AND c.method = m.method)",
)
def wide_to_long_coverage(spark, folder):
    """One column per method, then back to rows."""
    wide = B.pivot_table(low_coverage(spark, folder), ["visit", "scenario"], "method", METHODS, "coverage")
    return V.to_long(wide, ["visit", "scenario"])


@query(
    "bounds_from_columns",
    f"""WITH {Q.RESULTS} SELECT iter, visit, method, round(min(lb), 6) AS lb, round(min(ub), 6) AS ub FROM ci WHERE outcome = 'low' AND method IN ('bootstrap', 'sandwich')
    GROUP BY ALL""",
)
def bounds_from_columns(spark, folder):
    """Columns named by bound and method become rows with both bounds."""
    rows = ci(spark, folder).filter("outcome = 'low' and method in ('bootstrap', 'sandwich')")
    wide = rows.groupBy("iter", "visit").agg(
        *[
            F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{c.upper()}_{m}")
            for m in ("bootstrap", "sandwich")
            for c in ("lb", "ub")
        ]
    )
    return rounded(V.to_bounds(wide, ["iter", "visit"]))


@query(
    "paired_bounds",
    f"""WITH {Q.RESULTS} SELECT outcome, visit, method, round(avg(lb), 6) AS lb, round(avg(ub), 6) AS ub FROM ci GROUP BY ALL""",
)
def paired_bounds(spark, folder):
    """Tables of lower and upper bounds joined by key."""
    rows = ci(spark, folder)
    keys = ["outcome", "visit", "method"]
    lb = rows.groupBy(*keys).agg(F.avg("lb").alias("lb"))
    ub = rows.groupBy(*keys).agg(F.avg("ub").alias("ub"))
    return rounded(V.pair_bounds(lb, ub, keys))


_PLACES = """SELECT visit, scenario, (row_number() OVER (PARTITION BY visit, scenario ORDER BY coverage DESC, method))::INTEGER AS place,
    method AS method_{s}, coverage AS coverage_{s} FROM {t}"""


@query(
    "compared_rankings",
    f"""{_COV}, d AS (SELECT visit, scenario, method, round(avg(CASE WHEN lb IS NOT NULL THEN CASE WHEN lb <= target AND ub >= target
      THEN 1.0 ELSE 0.0 END END), 6) AS coverage FROM lim WHERE outcome = 'low' GROUP BY ALL),
    n AS ({_PLACES.format(s='new', t='c')}), o AS ({_PLACES.format(s='old', t='d')})
    SELECT * FROM n JOIN o USING (visit, scenario, place)""",
)
def compared_rankings(spark, folder):
    """Rankings with pivotal and with percentile limits, place by place."""
    return V.compare_runs(low_coverage(spark, folder), low_coverage(spark, folder, ()))


@query("pivotal_limits", f"WITH {Q.RESULTS} SELECT {CELL}, iter, round(2 * est - ub, 6) AS lb, round(2 * est - lb, 6) AS ub FROM ci WHERE method = 'bootstrap'")
def pivotal_limits(spark, folder):
    low, high = I.pivotal_limits(F.col("est"), F.col("lb"), F.col("ub"))
    rows = ci(spark, folder).filter("method = 'bootstrap'")
    return rounded(rows.select("outcome", "scenario", "visit", "iter", low.alias("lb"), high.alias("ub")))


@query("flipped_sign", f"WITH {Q.ESTIMATES} SELECT {CELL}, iter, round(-(surv1 - surv0), 6) AS mrd FROM est")
def flipped_sign(spark, folder):
    """Risk difference from the survival difference."""
    rows = est(spark, folder)
    return rounded(rows.select("outcome", "scenario", "visit", "iter", (-(F.col("surv1") - F.col("surv0"))).alias("mrd")))


@query(
    "stacked_scenarios",
    f"WITH {Q.ESTIMATES} SELECT outcome, scenario, visit, iter, round(est, 6) AS est, CASE outcome WHEN 'low' THEN -4.7 WHEN 'med' THEN -3.8 ELSE -3.0 END::DOUBLE AS outcome_prev FROM est",
)
def stacked_scenarios(spark, folder):
    """Tables of the three event rates, tagged and stacked."""
    parts = [
        B.tag(est(spark, folder).filter(F.col("outcome") == o), {"outcome_prev": p})
        for o, p in zip(S.OUTCOMES, (-4.7, -3.8, -3.0))
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(stacked.select("outcome", "scenario", "visit", "iter", "est", "outcome_prev"))


@query(
    "sd_by_scenario",
    f"WITH {Q.ESTIMATES}, s AS (SELECT {CELL}, stddev_samp(est) AS sd FROM est WHERE scenario >= 19 GROUP BY ALL) SELECT outcome, visit, "
    + ", ".join(f"round(max(CASE WHEN scenario = {k} THEN sd END), 6) AS s{k}" for k in range(19, 28))
    + " FROM s GROUP BY ALL",
)
def sd_by_scenario(spark, folder):
    """SD by visit with one column per scenario of the largest sample size."""
    sd = V.empirical_sd(est(spark, folder).filter("scenario >= 19"))
    return rounded(B.pivot_table(sd, ["outcome", "visit"], "scenario", range(19, 28), "sd", "s"))


# ---- tables -----------------------------------------------------------------------------------


@query(
    "histogram",
    f"WITH {Q.ESTIMATES}, b AS (SELECT outcome, floor(est / 0.001 + 0.5)::BIGINT AS bin FROM est) SELECT outcome, bin, count(*) AS n, round(bin * 0.001, 6)::DOUBLE AS centre FROM b GROUP BY 1, 2",
)
def histogram(spark, folder):
    return rounded(B.histogram(est(spark, folder), "est", 0.001, ["outcome"]))


@query(
    "quartile_summary",
    f"WITH {Q.ESTIMATES} SELECT outcome, visit, round(avg(est), 6) AS mean, round(quantile_cont(est, 0.25), 6) AS q1, round(quantile_cont(est, 0.75), 6) AS q3 FROM est GROUP BY ALL",
)
def quartile_summary(spark, folder):
    return rounded(V.quartile_summary(est(spark, folder), ["outcome", "visit"], "est"))


@query(
    "exact_quantiles",
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 4) AS lower, round(quantile_cont(l_extendedprice, 0.5), 4) AS middle,"
    " round(quantile_cont(l_extendedprice, 0.975), 4) AS upper FROM lineitem GROUP BY 1",
)
def exact_quantiles(spark, folder):
    """Interpolated quantiles of three groups that hold all line items."""
    rows = S.table(spark, folder, "lineitem")
    probs = {"lower": 0.025, "middle": 0.5, "upper": 0.975}
    return rounded(quantile_table(rows, ["l_returnflag"], "l_extendedprice", probs), 4)


@query("replicate_mean", f"WITH {Q.ESTIMATES} SELECT {CELL}, round(avg(est), 6) AS mrd FROM est GROUP BY ALL")
def replicate_mean(spark, folder):
    return rounded(V.replicate_mean(est(spark, folder), ["outcome", "scenario", "visit"]))


_HALVES = f"""WITH {Q.ESTIMATES}, h1 AS (SELECT {CELL}, avg(est) AS mrd FROM est WHERE iter % 2 = 0 GROUP BY ALL),
    h2 AS (SELECT {CELL}, avg(est) AS mrd FROM est WHERE visit <= 1 GROUP BY ALL)"""


@query(
    "pooled_truth",
    f"""{_HALVES}, u AS (SELECT *, 500 AS w FROM h1 UNION ALL SELECT *, 200 FROM h2)
    SELECT {CELL}, round(sum(w * mrd) / sum(w), 6) AS mrd FROM u GROUP BY ALL""",
)
def pooled_truth(spark, folder):
    """Truths of two sets of runs, weighted 500 to 200."""
    rows = est(spark, folder)
    cell = ["outcome", "scenario", "visit"]
    first = V.replicate_mean(rows.filter("iter % 2 = 0"), cell)
    second = V.replicate_mean(rows.filter("visit <= 1"), cell)
    return rounded(V.pool_truth([first, second], [500, 200], cell))


@query(
    "truth_difference",
    f"{_EST}, m AS (SELECT outcome, visit, round(avg(est), 6) AS m FROM est GROUP BY 1, 2) SELECT {CELL}, round_even(mrd - m, 3) AS difference FROM truth JOIN m USING (outcome, visit)",
)
def truth_difference(spark, folder):
    """Scenario truths less the mean of their event rate, to three digits."""
    means = rounded(V.replicate_mean(est(spark, folder), ["outcome", "visit"]))
    known = truth(spark, folder)
    spread = known.select("outcome", "scenario", "visit").join(means, ["outcome", "visit"])
    return rounded(V.truth_diff(known, spread, ["outcome", "scenario", "visit"]), 3)


@query(
    "missing_value_table",
    f"""{_GRID}, f AS (SELECT outcome, scenario, iter, CASE WHEN sum(CASE WHEN method = 'bootstrap' AND lb IS NULL THEN 1 ELSE 0 END) = 0
      THEN 'No NAs' ELSE 'Some NAs' END AS bootstrap, CASE WHEN sum(CASE WHEN method LIKE 'jackknife%' AND lb IS NULL THEN 1 ELSE 0 END) = 0
      THEN 'No NAs' ELSE 'Some NAs' END AS jackknife FROM ci GROUP BY ALL),
    x AS (SELECT bootstrap, jackknife, outcome, conf, treat FROM f JOIN grid USING (scenario) WHERE size = 200),
    c AS (SELECT *, count(*) AS n FROM x GROUP BY ALL)
    SELECT bootstrap, jackknife, outcome, conf, treat, coalesce(n, 0) AS n FROM (SELECT DISTINCT bootstrap FROM x) CROSS JOIN
    (SELECT DISTINCT jackknife FROM x) CROSS JOIN (SELECT DISTINCT outcome FROM x) CROSS JOIN (SELECT DISTINCT conf FROM x) CROSS JOIN
    (SELECT DISTINCT treat FROM x) LEFT JOIN c USING (bootstrap, jackknife, outcome, conf, treat)""",
)
def missing_value_table(spark, folder):
    """Iterations with and without missing limits, zero cells included."""
    gone = F.col("lb").isNull()
    flags = ci(spark, folder).groupBy("outcome", "scenario", "iter").agg(
        F.sum(F.when(gone & (F.col("method") == "bootstrap"), 1).otherwise(0)).alias("_b"),
        F.sum(F.when(gone & F.col("method").startswith("jackknife"), 1).otherwise(0)).alias("_j"),
    )
    small = flags.join(grid(spark).filter("size = 200"), "scenario")
    checks = {"bootstrap": F.col("_b") == 0, "jackknife": F.col("_j") == 0}
    return B.na_crosstab(small, checks, ["outcome", "conf", "treat"])


@query(
    "person_trials_by_segment",
    f"WITH {Q.PANEL} {Q.TRIALS} SELECT c_mktsegment, assigned_treatment, count(*) AS n FROM pp GROUP BY 1, 2",
)
def person_trials_by_segment(spark, folder):
    return B.count_by(trial_rows(spark, folder), ["c_mktsegment", "assigned_treatment"])
