"""Quantiles by digit histograms: any doubles, any ties, no shuffle of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulant.operators import quantiles as Q

PROBS = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.975, "f": 1.0}


@pytest.fixture
def small(monkeypatch):
    """Few rows are many: rounds are taken until one value is left."""
    monkeypatch.setattr(Q, "FEW", 3)


VALUES = {
    "magnitudes": lambda r: 10.0 ** r.uniform(-300, 300, 5000) * r.choice([-1, 1], 5000),
    "ties": lambda r: np.where(r.random(6000) < 0.4, 1.0, r.normal(size=6000)),
    "one value": lambda r: np.full(3000, -2.5),
    "zeros": lambda r: r.choice([0.0, -0.0, 5e-324, -5e-324], 3000),
    "infinite": lambda r: np.concatenate([[-np.inf] * 40, r.normal(size=3000), [np.inf] * 40]),
    "outlier": lambda r: np.concatenate([r.normal(size=4000), [1.7e308, -1.7e308]]),
    "neighbours": lambda r: (np.float64(1.0).view(np.int64) + r.integers(0, 50, 4000)).view(np.float64),
}


@pytest.mark.parametrize("name", VALUES)
def test_order_statistics_are_exact(spark, small, name):
    x = VALUES[name](np.random.default_rng(4))
    df = spark.createDataFrame([(float(v),) for v in x], "x double").unionByName(spark.createDataFrame([(None,)] * 5, "x double"))
    got = Q.quantile_table(df, [], "x", PROBS).first()
    s = np.sort(x)
    for k, p in PROBS.items():
        h = (len(s) - 1) * p
        lo, hi, f = s[int(np.floor(h))], s[int(np.ceil(h))], h - np.floor(h)
        want = lo + f * (hi - lo) if np.isfinite(lo) and np.isfinite(hi) else lo
        assert got[k] == pytest.approx(want, rel=1e-15) or (np.isnan(got[k]) and not np.isfinite(want))


def test_groups_with_null_keys_and_a_hot_group(spark, small):
    rng = np.random.default_rng(1)
    rows = [(None if g == 0 else int(g), "h", float(v)) for g, v in zip(rng.choice(40, 9000, p=[0.4] + [0.6 / 39] * 39), rng.normal(size=9000))]
    df = spark.createDataFrame(rows, "g int, s string, x double")
    got = {r["g"]: (r["m"], r["t"]) for r in Q.quantile_table(df, ["g", "s"], "x", {"m": 0.5, "t": 0.9}).collect()}
    assert len(got) == len({r[0] for r in rows})
    for g, (m, t) in got.items():
        part = [v for k, _, v in rows if k == g]
        assert m == pytest.approx(np.quantile(part, 0.5), abs=1e-12) and t == pytest.approx(np.quantile(part, 0.9), abs=1e-12)


def test_no_rows_give_no_row(spark):
    df = spark.createDataFrame([], "g int, x double")
    assert Q.quantile_table(df, ["g"], "x", {"m": 0.5}).count() == 0


def test_rows_are_not_shuffled(spark):
    """The plan of a round: ranges are broadcast, and only counts go through an exchange."""
    rows = spark.range(20_000).select(F.struct(F.lit(0)).alias("_key"), F.col("id").alias("_b"))
    targets = rows.limit(1).select("_key", F.lit(5).cast("long").alias("rank"), F.lit(0).cast("long").alias("lo"), F.lit(19_999).cast("long").alias("hi"), F.lit(0).cast("long").alias("before"), F.lit(20_000).cast("long").alias("size"))
    met = Q._met(rows, targets.select("_key", "lo", "hi"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in met and "SortMergeJoin" not in met and "hashpartitioning" not in met
    found = Q._narrowed(rows, targets).first()
    assert found["lo"] <= 5 <= found["hi"] and found["size"] <= 5
