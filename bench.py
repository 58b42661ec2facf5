"""Wall time of the headline steps. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and
threads; BENCH_REPLICATES (default 200) the number of replicates.
"""

from __future__ import annotations

import json
import os
import time


from emulant.operators import evaluate, intervals, trials
from emulant.operators.quantiles import quantile_table
from emulant.plans.analysis import TrialAnalysis
from emulant.plans.queries_estimation import REGRESSION
from emulant.plans.queries_panel import COVARIATES, SPEC, panel
from emulant.session import local_session
from emulant.sources import adapters
from emulant.spec import PIVOT_METHODS


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPLICATES", "200"))
    spark = local_session(cpus, "emulant-bench")
    times: dict[str, float] = {}

    def clock(name, run):
        start = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    # Start the Python workers and the JIT outside the clock.
    spark.range(1000).mapInArrow(lambda it: it, "id long").count()

    clock("trial_expansion", lambda: drain(trials.emulate_trials(panel(spark, folder), SPEC, COVARIATES)))
    with TrialAnalysis(panel(spark, folder), REGRESSION) as a:
        clock("weight_fit", lambda: a.weight_fits)
        clock("weighted_expansion", lambda: a.expanded.count())
        clock("outcome_fit", lambda: a.fit)
        clock("risk_difference_curve", lambda: a.curve().collect())
        clock("person_rows", lambda: a.person_count)
        for method in ("lef_outcome", "lef_both", "bootstrap"):
            clock(
                f"{method}_{reps}",
                lambda m=method: intervals.percentile_ci(a.bootstrap(reps, 1, (m,)).curves).collect(),
            )
        clock("jackknife", lambda: intervals.ci_jackknife(a).collect())
        clock("sandwich_500_draws", lambda: intervals.ci_sandwich(a, 500, 1).collect())
    ci = adapters.interval_results(spark, folder)
    truth = adapters.scenario_truth(spark, folder)
    clock("pivotal_coverage", lambda: evaluate.coverage(ci, truth, pivot=PIVOT_METHODS).collect())
    clock("interval_width", lambda: evaluate.ci_width(ci).collect())
    clock("median_width", lambda: evaluate.ci_width(ci, "median").collect())
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    clock(
        "exact_quantiles",
        lambda: quantile_table(lines, ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "q3": 0.75}).collect(),
    )
    print(
        json.dumps(
            {
                "metric": "sequential_trial_analysis_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "replicates": reps,
                "cpus": int(cpus) if cpus.isdigit() else cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
