"""Counter-based numbers and the splitting tree of draws."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emulant.functions import counter, kernel, tree
from emulant.operators import resample as R


def test_numbers_are_equal_in_numpy_columns_and_sql(spark):
    a, b = np.arange(0, 5_000_000_00, 40_000_003) % (1 << 32), np.arange(13)
    want = counter.uniform(2**40 + 77, a, b, 5)
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    got = rows.select(counter.uniform_column(2**40 + 77, F.col("a"), F.col("b"), F.lit(5))).toPandas().iloc[:, 0]
    sql = duckdb.connect().execute(
        "SELECT " + counter.uniform_sql(2**40 + 77, ["a", "b", "5"]) + " FROM (SELECT unnest(?) AS a, unnest(?) AS b)", [a.tolist(), b.tolist()]
    )
    assert np.array_equal(got, want) and [r[0] for r in sql.fetchall()] == want.tolist()
    z = counter.normal(9, np.arange(4), 3)
    grid = spark.range(4).crossJoin(spark.range(3).withColumnRenamed("id", "j")).orderBy("id", "j")
    cols = grid.select(counter.normal_column(9, F.col("id"), F.col("j"))).toPandas().iloc[:, 0]
    assert np.allclose(cols, z.ravel(), atol=1e-13)


def test_numbers_are_uniform_and_unrelated():
    u = counter.uniform(1, np.arange(400)[:, None], np.arange(500)[None, :])
    assert abs(u.mean() - 0.5) < 0.003 and abs(u.var() - 1 / 12) < 0.002
    assert abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.2 and len(np.unique(u)) == u.size
    cells = np.bincount((u.ravel() * 64).astype(int), minlength=64)
    assert ((cells - u.size / 64) ** 2 / (u.size / 64)).sum() < 120


@pytest.mark.parametrize("m, left, size", [(0, 1, 2), (1, 1, 2), (9, 3, 7), (300, 130, 257)])
def test_binomial_inverts_the_distribution(m, left, size):
    p = left / size
    reached = np.cumsum([math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)])
    u = counter.uniform(3, np.arange(400))[None, :]
    got = tree.binomial(u, np.full((1, 400), m), np.array([left]), np.array([size]), {})
    assert got[0].tolist() == [min(int((reached < x).sum()), m) for x in u[0]]


def test_large_binomials_have_mean_and_variance():
    m = 40_000_000
    got = tree.binomial(counter.uniform(5, np.arange(3000))[None, :], np.full((1, 3000), m), np.array([1]), np.array([2]), {})
    assert abs(got.mean() - m / 2) < 5 * math.sqrt(m / 4 / 3000) and 0.9 < got.var() / (m / 4) < 1.1


@pytest.mark.parametrize("n", [1, 255, 257, 5000, 70_000])
def test_counts_of_a_replicate_add_up_whatever_part_is_asked_for(n):
    one = tree.Tree(n, 0, 4, 8, leaf=64)
    leaves = 1 << one.levels
    assert sum(one.counts(k) for k in range(leaves)).tolist() == [n] * 4
    some = tree.Tree(n, 2, 4, 8, leaf=64)
    k = leaves // 3
    assert np.array_equal(some.counts(k), one.counts(k)[2:])
    assert one.leaf_of(0) == 0 and one.leaf_of(n - 1) == leaves - 1


def test_draws_are_those_of_chance():
    """Counts of a person have variance 1 - 1/n, and two persons -1/n."""
    n, reps = 3000, 400
    counts = np.zeros((n, reps), int)
    t = tree.Tree(n, 0, reps, 2, leaf=100)
    for k in range(1 << t.levels):
        person, rep = t.draws(k)
        np.add.at(counts, (person, rep), 1)
    assert (counts.sum(axis=0) == n).all()
    assert abs(counts.var(axis=1).mean() - 1) < 0.02
    assert abs((counts == 0).mean() - math.exp(-1)) < 0.003
    halves = counts[: n // 2].sum(axis=0)
    assert 0.7 < halves.var() / (n / 4) < 1.35


def test_draws_arise_without_a_shuffle_of_draws(spark):
    """Two exchanges number the persons; none follows the draws."""
    ids = spark.range(3000)
    counts = R.bootstrap_counts(ids, 5, 4)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in after and counts.groupBy("rep").agg(F.sum("n")).filter("sum(n) = 3000").count() == 5


def test_drawn_lists_equal_the_counts(spark):
    persons = R.person_index(spark.range(700)).repartition(3)
    lists = R.with_draws(persons, 700, 2, 6, 13).select("id", F.explode("drawn").alias("rep")).groupBy("rep", "id").agg(F.count("*").alias("n"))
    counts = R.bootstrap_counts(spark.range(700), 6, 13).filter("rep >= 2")
    assert lists.exceptAll(counts).isEmpty() and counts.exceptAll(lists).isEmpty()


def test_a_singular_covariance_can_be_drawn_from():
    x = np.array([[1.0, 2.0, 0.0], [2.0, 4.0, 0.0], [0.0, 0.0, 3.0]])
    low = kernel.cholesky(x)
    assert np.allclose(low @ low.T, x) and np.allclose(low[:, 1], 0)


def test_states_of_a_fit():
    """Separated and regular fits, and one that runs out of passes, are told apart."""
    x = np.column_stack([np.ones(40), np.repeat([0.0, 1.0], 20)])
    y = np.tile([0.0, 1.0], 20)
    sure = np.where(x[:, 1] == 1, 1.0, y)
    cases = {"regular": (y, 60), "separated": (sure, 60), "short": (np.where(np.arange(40) == 3, 1.0, 0.0), 2)}
    for name, (response, limit) in cases.items():
        fit = kernel.Newton(2, max_iter=limit, last_step=True)
        while len(fit.active):
            fit.update(kernel.logistic_sums(x, response, np.ones((40, 1)), fit.coef))
        assert fit.finite[0] and fit.separated[0] == (name == "separated"), name
        assert fit.converged[0] == (name != "short"), name


def test_passes_are_counted_by_fit():
    """A fit that begins anew at 0 has all its passes, whatever the others took."""
    x = np.column_stack([np.ones(30), np.arange(30) % 3 == 0]).astype(float)
    y = (np.arange(30) % 5 == 0).astype(float)
    far = kernel.Newton(2, 2, max_iter=12, start=np.array([-300.0, 0.0]))
    while len(far.active):
        far.update(kernel.logistic_sums(x, y, np.ones((30, 1)), far.coef[:, far.active]))
    assert far.converged.all() and (far.fit_passes < 12).all() and far.passes > far.fit_passes.max()
