import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulant.operators import evaluate as V
from emulant.operators import intervals as I
from emulant.operators import resample as R
from emulant.operators import scenarios as X
from emulant.operators import tabulate as B
from emulant.operators.quantiles import quantile_table
from emulant.sources import adapters as S
from emulant.sources import tables as IO


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 10], [5], [1] * 50 + [2] * 3, list(range(1000)), [0.0, -0.0, 1.5]])
def test_quantiles_equal_linear_interpolation(spark, values):
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(2, 7.0), (None, 3.0), (1, None)], "g int, x double")
    got = {r["g"]: r for r in quantile_table(df, ["g"], "x", {"a": 0.025, "b": 0.5, "c": 0.975}).collect()}
    assert np.allclose(tuple(got[1])[1:], np.quantile(values, [0.025, 0.5, 0.975]))
    assert tuple(got[2])[1:] == (7.0, 7.0, 7.0) and got[None]["b"] == 3.0


def test_quantiles_of_skewed_groups_and_of_everything(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.sin(F.col("id") * 1.0)).alias("x"),
    )
    p = df.toPandas()
    got = {r["g"]: r["m"] for r in quantile_table(df, ["g"], "x", {"m": 0.3}).collect()}
    for g, part in p.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part.x, 0.3), abs=1e-12)
    assert quantile_table(df, [], "x", {"m": 0.99}).first()["m"] == pytest.approx(np.quantile(p.x, 0.99))


def test_percentile_limits_are_of_the_interpolating_kind(spark):
    df = spark.createDataFrame([("m", 0, float(v)) for v in (1, 2, 3, 4, 10)], "method string, followup_time int, mrd double")
    r = I.percentile_ci(df).first()
    assert (r["lb"], r["ub"]) == (pytest.approx(1.1), pytest.approx(9.4))


def test_pivotal_limits_keep_the_width(spark):
    limits = spark.createDataFrame([(0, 0.1, 0.5)], "followup_time int, lb double, ub double")
    est = spark.createDataFrame([(0, 0.2)], "followup_time int, mrd double")
    r = I.pivotal_ci(limits, est).first()
    assert (r["lb"], r["ub"]) == (pytest.approx(-0.1), pytest.approx(0.3))


# Published coverages and ranks of two visits of one scenario.
PUBLISHED = [
    (0, "LEF_outcome", 0.993, 1),
    (0, "LEF_both", 0.993, 1),
    (0, "Bootstrap", 0.967, 2),
    (0, "Jackknife_Wald", 0.951, 3),
    (0, "Jackknife_MVN", 0.887814313346228, 4),
    (0, "Sandwich", 0.85854189336235, 5),
    (1, "LEF_outcome", 0.99, 1),
    (1, "LEF_both", 0.99, 1),
    (1, "Jackknife_Wald", 0.96, 2),
    (1, "Bootstrap", 0.954, 3),
    (1, "Jackknife_MVN", 0.93036750483559, 4),
    (1, "Sandwich", 0.871599564744287, 5),
]


def test_ranks_equal_the_published_ones(spark):
    rows = [(v, 1, m, c) for v, m, c, _ in PUBLISHED]
    df = spark.createDataFrame(rows, "visit int, scenario int, method string, coverage double")
    got = {(r["visit"], r["method"]): r["rank"] for r in V.rank_methods(df).collect()}
    assert got == {(v, m): k for v, m, _, k in PUBLISHED}


def ci_table(spark, rows):
    return spark.createDataFrame(
        [("low", 1, i, v, m, e, lb, ub) for i, v, m, e, lb, ub in rows], IO.RESULT_SCHEMA
    )


def test_coverage_counts_existing_intervals_and_closed_bounds(spark):
    ci = ci_table(spark, [(1, 0, "sandwich", 0.0, 0.1, 0.3), (2, 0, "sandwich", 0.0, 0.2, 0.3), (3, 0, "sandwich", 0.0, None, None)])
    truth = spark.createDataFrame([("low", 1, 0, 0.1)], "outcome string, scenario int, visit int, mrd double")
    r = V.coverage(ci, truth).first()
    assert (r["coverage"], r["intervals"]) == (0.5, 2)
    assert V.coverage(ci, truth, closed=False).first()["coverage"] == 0.0


def test_simultaneous_coverage_is_strict_and_judged_on_the_last_visit(spark):
    rows = [(1, 0, "m", 0.0, -1.0, 1.0), (1, 1, "m", 0.0, -1.0, 1.0), (2, 0, "m", 0.0, 0.0, 1.0), (2, 1, "m", 0.0, -1.0, 1.0)]
    rows += [(3, 0, "m", 0.0, -1.0, 1.0), (3, 1, "m", 0.0, None, None)]
    truth = spark.createDataFrame([("low", 1, v, 0.0) for v in (0, 1)], "outcome string, scenario int, visit int, mrd double")
    r = V.coverage_simultaneous(ci_table(spark, rows), truth, 1).first()
    assert (r["coverage"], r["iterations"]) == (0.5, 2)


def test_coverages_lie_between_zero_and_one(spark, folder):
    cov = V.coverage(S.interval_results(spark, folder), S.scenario_truth(spark, folder), pivot=("bootstrap",))
    low, high = cov.agg(F.min("coverage"), F.max("coverage")).first()
    assert 0 <= low <= high <= 1


def test_results_are_stored_by_outcome_and_scenario(spark, folder, tmp_path):
    ci = S.interval_results(spark, folder)
    IO.write_results(ci, str(tmp_path / "r"))
    back = IO.read_results(spark, str(tmp_path / "r"))
    assert back.count() == ci.count()
    plan = back.filter("outcome = 'low' and scenario = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(outcome" in plan


def test_full_crosstab_has_the_product_of_levels(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), ("a", 1, 1), (None, 1, 0)], "x string, y int, z int")
    out = B.crosstab_full(df, ["x", "y", "z"]).collect()
    assert len(out) == 8 and sum(r["n"] for r in out) == 3
    assert B.crosstab_full(df, ["x", "y"], {"y": [1, 2, 3]}).count() == 6


def test_bootstrap_counts_add_up_and_do_not_depend_on_partitions(spark):
    ids = spark.range(500).withColumnRenamed("id", "id")
    a = R.bootstrap_counts(ids, 3, 11)
    b = R.bootstrap_counts(ids.repartition(13), 3, 11)
    assert [r[0] for r in a.groupBy("rep").agg(F.sum("n")).select("sum(n)").collect()] == [500] * 3
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_person_index_is_dense(spark):
    ids = spark.range(0, 100_000, 4096)
    got = sorted(r["idx"] for r in R.person_index(ids).collect())
    assert got == list(range(len(got)))


def test_attached_counts_cover_every_replicate_and_person(spark):
    ids = spark.range(20)
    counts = R.bootstrap_counts(ids, 2, 1)
    out = R.attach_counts(ids, counts, ids)
    assert out.count() == 40 and out.agg(F.sum("n")).first()[0] == 40
    assert out.filter("n = 0").count() > 0


def test_scenarios_are_numbered_with_the_last_factor_fastest(spark):
    grid = X.crossing(spark, {"size": (200, 1000, 5000), "conf": (0.1, 0.5, 0.9), "treat": (-1, 0, 1)})
    got = [tuple(r) for r in grid.orderBy("scenario").collect()]
    want = [(i + 1, *c) for i, c in enumerate(itertools.product((200, 1000, 5000), (0.1, 0.5, 0.9), (-1, 0, 1)))]
    assert got == want


def test_rankings_are_compared_by_place(spark):
    new = spark.createDataFrame([(0, 1, "a", 0.9), (0, 1, "b", 0.8)], "visit int, scenario int, method string, coverage double")
    old = spark.createDataFrame([(0, 1, "a", 0.7), (0, 1, "b", 0.95)], "visit int, scenario int, method string, coverage double")
    got = {r["place"]: (r["method_new"], r["method_old"]) for r in V.compare_runs(new, old).collect()}
    assert got == {1: ("a", "b"), 2: ("b", "a")}


def test_histogram_bins_are_centred(spark):
    df = spark.createDataFrame([(0.0004,), (0.0006,), (-0.0004,)], "x double")
    assert {r["bin"]: r["n"] for r in B.histogram(df, "x", 0.001).collect()} == {0: 2, 1: 1}


def test_jackknife_wald_by_hand(spark):
    reps = spark.createDataFrame([(k, 0, m) for k, m in enumerate((0.1, 0.2, 0.3))], "rep int, followup_time int, mrd double")
    est = spark.createDataFrame([(0, 0.25)], "followup_time int, mrd double")
    r = I.jackknife_wald_ci(reps, est).first()
    assert r["se"] == pytest.approx(np.sqrt(2 / 3 * (0.15**2 + 0.05**2 + 0.05**2)))
    assert r["ub"] - r["est"] == pytest.approx(1.96 * r["se"])
    r = I.jackknife_wald_ci(reps, est, "mean").first()
    assert r["se"] == pytest.approx(np.sqrt(2 / 3 * 0.02))


def test_cells_are_counted_before_they_are_made(spark):
    df = spark.createDataFrame([(i, i % 50) for i in range(400)], "x int, y int")
    with pytest.raises(ValueError, match="400 x 50 cells"):
        B.crosstab_full(df, ["x", "y"], most_cells=10_000)
    with pytest.raises(ValueError, match="x has 400 levels"):
        B.crosstab_full(df, ["x", "y"], most_levels=100)
    out = B.crosstab_full(df, ["x", "y"])
    assert out.count() == 20_000 and out.agg(F.sum("n")).first()[0] == 400
    assert B.crosstab_full(df.limit(0), ["x", "y"]).count() == 0


def test_coverage_is_the_same_broadcast_and_salted(spark):
    rows = [("low", 1, i, v, "m", 0.0, -1.0 + i / 50, 1.0) for i in range(100) for v in (0, 1)]
    ci = spark.createDataFrame(rows, "outcome string, scenario int, iter long, visit int, method string, est double, lb double, ub double")
    truth = spark.createDataFrame([("low", 1, 0, 0.1), ("low", 1, 1, 0.4)], "outcome string, scenario int, visit int, mrd double")
    near, far = V.coverage(ci, truth), V.coverage(ci, truth, bound=0)
    assert near.exceptAll(far).isEmpty() and near.count() == far.count() == 2
    assert "hashpartitioning(outcome" not in near._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[1].split("HashAggregate")[0]


def test_a_cell_without_results_has_failed(spark):
    ci = spark.createDataFrame([("low", 1, 0, "bootstrap", 0.1), ("low", 1, 0, "bootstrap", None)], "outcome string, scenario int, visit int, method string, lb double")
    grid = spark.createDataFrame([(1, 200, 0, 4), (2, 1000, 0, 4)], "scenario int, size int, treat int, iters int")
    by = ("outcome", "size", "method")
    kw = {"methods": ["bootstrap", "jackknife_wald"], "outcomes": ["low"]}
    got = {(r["size"], r["method"]): r["failure_rate"] for r in V.failure_rate(ci, "iters", grid, by, **kw).collect()}
    assert got == {(200, "bootstrap"): 0.75, (1000, "bootstrap"): 1.0, (200, "jackknife_wald"): 1.0, (1000, "jackknife_wald"): None}
    free = V.failure_rate(ci, "iters", grid, by, None, **kw)
    assert {(r["size"], r["method"]): r["failure_rate"] for r in free.collect()}[1000, "jackknife_wald"] == 1.0


def test_draws_are_carried_and_unfolded(spark):
    ids = spark.range(300)
    carried = R.sparse_counts(ids, 4, 9)
    assert carried.count() == 300
    counts = R.bootstrap_counts(ids, 4, 9)
    long = R.unfold(R.attach_draws(ids, carried), 4)
    assert long.count() == 1200 and long.filter("n > 0").select("rep", "id", "n").exceptAll(counts).isEmpty()
    packed = R.pack_counts(counts).join(carried.withColumnRenamed("drawn", "d"), "id")
    assert packed.filter(F.sort_array("d") != F.col("drawn")).isEmpty()


def test_result_rows_are_dealt_over_tasks_by_their_number(spark, tmp_path, monkeypatch):
    """A task of the results tables holds a bounded number of lines, and whole iterations."""
    lines = spark.range(4000).select(
        F.when(F.col("id") % 50 > 0, F.floor(F.col("id") / 5)).alias("l_orderkey"),
        (F.col("id") % 5 + 1).alias("l_linenumber"),
        *[(F.col("id") % k / 10).alias(c) for k, c in ((11, "l_discount"), (9, "l_tax"), (50, "l_quantity"))],
    )
    lines.unionByName(lines.filter("l_linenumber = 3")).write.parquet(f"{tmp_path}/lineitem.parquet")
    few = S.interval_results(spark, str(tmp_path))
    want = V.coverage_simultaneous(few, S.scenario_truth(spark, str(tmp_path)), 4).toPandas()
    monkeypatch.setattr(S, "ROWS_PER_TASK", 100, raising=False)
    many = S.interval_results(spark, str(tmp_path))
    parts = many.withColumn("part", F.spark_partition_id())
    assert parts.groupBy("part").count().agg(F.max("count")).first()[0] <= 6 * 400
    got = V.coverage_simultaneous(many, S.scenario_truth(spark, str(tmp_path)), 4).toPandas()
    by = ["outcome", "scenario", "method"]
    assert want.sort_values(by).reset_index(drop=True).equals(got.sort_values(by).reset_index(drop=True))
    assert parts.filter("iter IS NOT NULL").groupBy("iter").agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0] == 1
