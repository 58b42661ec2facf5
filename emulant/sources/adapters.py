"""Panels and result tables derived from order, event and line-item tables.

The meaning of these panels is artificial, their shape is that of a cohort: one
row per person and visit, a treatment that switches, a time-varying and a
baseline covariate, an absorbing outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulant.operators import panel as P
from emulant.spec import METHODS, PanelSpec

ORDER_VISITS = 6
ORDER_SPEC = PanelSpec(visits=ORDER_VISITS)
CENSORED_SPEC = PanelSpec(visits=ORDER_VISITS, censor="C")
EVENT_SPEC = PanelSpec(visits=ORDER_VISITS)

# Levels of the categorical covariate of the order panel.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _by_visit(rows: DataFrame, key: str, visit: str, visits: int, measures: dict) -> DataFrame:
    """One row per person with an array of per-visit measures.

    Sums per visit are taken as conditional aggregates of the person, so a single
    shuffle on the person key serves, with partial sums before it: a person with
    a large share of all rows sends one row per map task.
    """
    slots = [
        F.struct(
            F.lit(k).alias("t"),
            *[
                F.coalesce(how(F.when(F.col(visit) == k, F.col(name))), F.lit(0)).alias(name)
                for name, how in measures.items()
            ],
        )
        for k in range(visits)
    ]
    return rows.groupBy(F.col(key).alias("id")).agg(F.array(*slots).alias("slots"))


def _empty_slots(visits: int, kinds: dict):
    return F.array(
        *[
            F.struct(F.lit(k).alias("t"), *[F.lit(0).cast(kind).alias(n) for n, kind in kinds.items()])
            for k in range(visits)
        ]
    )


def _histories(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Lags, exposure, outcome and eligibility of raw person-visit rows."""
    return (
        rows.withColumns(
            {
                "Ap": F.lag("A", 1, 0).over(spec.person()),
                "CAp": F.coalesce(F.sum("A").over(spec.past()), F.lit(0)).cast("int"),
                "Yp": F.coalesce(F.max("ev").over(spec.past()), F.lit(0)),
                "X2": F.log1p(F.lag("spend", 1, 0.0).over(spec.person())),
            }
        )
        .withColumn("Y", F.greatest("ev", "Yp"))
        .withColumn("eligible", F.when((F.col("CAp") == 0) & (F.col("Yp") == 0), 1).otherwise(0))
    )


def order_histories(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer and year, rows after the event still in.

    Treated: an urgent or high-priority order in the year. Event: an order worth
    450000 or more.
    """
    orders = table(spark, folder, "orders").select(
        "o_custkey",
        (F.year("o_orderdate") - 1995).alias("t"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("A"),
        F.when(F.col("o_totalprice") >= 450000, 1).otherwise(0).alias("ev"),
        F.col("o_totalprice").alias("spend"),
    )
    orders = orders.filter(F.col("t").between(0, ORDER_VISITS - 1))
    slots = _by_visit(orders, "o_custkey", "t", ORDER_VISITS, {"A": F.max, "ev": F.max, "spend": F.sum})
    persons = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment"
    )
    kinds = {"A": "int", "ev": "int", "spend": "double"}
    joined = persons.join(slots, "id", "left").select(
        *persons.columns, F.inline(F.coalesce("slots", _empty_slots(ORDER_VISITS, kinds)))
    )
    return _histories(joined, ORDER_SPEC)


def order_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Customer-year panel: rows up to and including the first event."""
    return order_histories(spark, folder).filter("Yp = 0").withColumn("X4", F.col("c_acctbal") / 1000.0)


def censored_order_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Order panel with drop-out for every seventh customer at a visit set by the key."""
    panel = order_panel(spark, folder)
    return drop_after_censoring(with_dropout_flag(panel))


def with_dropout_flag(panel: DataFrame) -> DataFrame:
    hit = (F.col("id") % 7 == 0) & (F.col("t") == F.floor(F.col("id") / 7) % 4)
    return panel.withColumn("C", F.when(hit, 1).otherwise(0))


def drop_after_censoring(panel: DataFrame) -> DataFrame:
    return P.mark_dropout(panel, CENSORED_SPEC).filter("dropped = 0").drop("dropped")


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    """User panel over 5-day buckets of the event stream.

    Treated: three or more purchases in the bucket. Event: an error with value
    120 or more.
    """
    events = table(spark, folder, "events").select(
        "user_id",
        F.least(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 5), F.lit(ORDER_VISITS - 1)).alias("t"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("bought"),
        F.when((F.col("event_type") == "error") & (F.col("value") >= 120), 1).otherwise(0).alias("ev"),
        F.col("value").alias("spend"),
    )
    measures = {"bought": F.sum, "ev": F.max, "spend": F.sum}
    slots = _by_visit(events, "user_id", "t", ORDER_VISITS, measures)
    slots = slots.select(
        "id",
        F.transform(
            "slots",
            lambda s: F.struct(
                s["t"].alias("t"),
                F.when(s["bought"] >= 3, 1).otherwise(0).alias("A"),
                s["ev"].alias("ev"),
                s["spend"].alias("spend"),
            ),
        ).alias("slots"),
        F.log1p(F.col("slots")[0]["spend"]).alias("X4"),
    )
    return _histories(slots.select("id", "X4", F.inline("slots")), EVENT_SPEC).filter("Yp = 0")


# Event-rate levels and scenario factors of the results tables.
OUTCOMES = ("low", "med", "high")
SIZES = (200, 1000, 5000)
CONFOUNDING = (0.1, 0.5, 0.9)
TREATMENT = (-1, 0, 1)
ROWS_PER_TASK = 250_000  # lines of the results tables


def replicate_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Estimates per outcome, scenario, iteration and visit, derived from line items.

    An order is an iteration, its lines are visits; discount and tax give the
    survival in the two arms. Tasks hold about ``ROWS_PER_TASK`` lines of whole iterations,
    however many lines there are: what follows multiplies and keeps them.
    """
    items = table(spark, folder, "lineitem")
    lines = items.groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("_v")).agg(
        F.avg("l_discount").alias("_d"), F.avg("l_tax").alias("_x"), F.avg("l_quantity").alias("_q")
    )
    label = F.array(*[F.lit(o) for o in OUTCOMES])
    rows = lines.select(
        F.element_at(label, (F.floor(F.col("l_orderkey") / 27) % 3 + 1).cast("int")).alias("outcome"),
        (F.col("l_orderkey") % 27 + 1).cast("int").alias("scenario"),
        (F.col("l_orderkey") * 2 + F.when(F.col("_v") >= 5, 1).otherwise(0)).alias("iter"),
        (F.col("_v") % 5).cast("int").alias("visit"),
        (F.exp(-F.col("_x")) - F.exp(-F.col("_d"))).alias("est"),
        F.exp(-F.col("_x")).alias("surv0"),
        F.exp(-F.col("_d")).alias("surv1"),
        (0.02 * F.exp(F.col("_q") / 50.0)).alias("half"),
    )
    tasks = items.count() // ROWS_PER_TASK
    return rows.repartition(max(tasks, spark.sparkContext.defaultParallelism), "iter") if tasks > 1 else rows


def interval_results(spark: SparkSession, folder: str) -> DataFrame:
    """Interval results of six methods; one in eleven iterations of a method failed."""


    methods = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(n).alias("method")) for i, n in enumerate(METHODS)])
    rows = replicate_estimates(spark, folder).select("*", F.inline(methods))
    ok = (F.floor(F.col("iter") / 2) + F.col("m")) % 11 != 0
    width = F.col("half") * (1.0 + 0.1 * F.col("m"))
    return rows.select(
        "outcome",
        "scenario",
        "iter",
        "visit",
        "method",
        "est",
        F.when(ok, F.col("est") - 0.9 * width).alias("lb"),
        F.when(ok, F.col("est") + 1.1 * width).alias("ub"),
    )


def scenario_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Truth per outcome, scenario and visit: the mean over the sample sizes of a setting."""
    est = replicate_estimates(spark, folder)
    setting = ((F.col("scenario") - 1) % 9).alias("setting")
    means = est.groupBy("outcome", setting, "visit").agg(
        F.round(F.avg("est"), 6).alias("mrd"),
        F.round(F.avg("surv0"), 6).alias("surv0"),
        F.round(F.avg("surv1"), 6).alias("surv1"),
    )
    sizes = F.array(*[(F.col("setting") + 1 + 9 * i).cast("int") for i in range(len(SIZES))])
    return means.select(
        "outcome", F.explode(sizes).alias("scenario"), "visit", "mrd", "surv0", "surv1"
    )
