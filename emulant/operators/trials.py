"""Expansion of a panel into a sequence of emulated trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulant.functions.design import Design
from emulant.operators.resample import hash_number
from emulant.spec import PanelSpec

TRIAL_KEY = ("id", "trial_period", "followup_time")


def expand_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Copy each row at visit ``t`` once per trial 0..t it could belong to."""
    return df.withColumn("trial_period", F.explode(F.sequence(F.lit(0), F.col(spec.period)))).withColumn(
        "followup_time", F.col(spec.period) - F.col("trial_period")
    )


def emulate_trials(
    df: DataFrame,
    spec: PanelSpec,
    covariates: Sequence[str] = (),
    estimand: str = "PP",
    carry: Sequence[str] = (),
    last_visit: int | None = None,
) -> DataFrame:
    """Rows of every trial a person starts: one trial per visit with ``eligible`` = 1.

    ``covariates`` and the assigned treatment are frozen at the start of the
    trial; ``carry`` columns keep their value at the current visit. A column
    ``cum_weight`` in the panel becomes ``weight``, the ratio of its value now to
    its value at the start.

    ``estimand``: "PP" ends a trial at the first visit where treatment differs from
    the one assigned (that visit is dropped), "ITT" follows everybody, "AT" follows
    everybody and adds the current ``treatment``.

    The open starts of a person travel along as a short array built by the running
    window over the person, so only rows that belong to a trial are produced and no
    second shuffle, join or sort is needed.  The array holds at most
    ``spec.visits`` entries because ``(id, period)`` is unique. Under "PP" a start is
    still open if it is not older than the present run of treatment.
    """
    if estimand not in ("PP", "ITT", "AT"):
        raise ValueError(f"estimand must be PP, ITT or AT, got {estimand!r}")
    weighted = "cum_weight" in df.columns
    start = F.struct(
        F.col(spec.period).alias("trial_period"),
        F.col(spec.treatment).alias("assigned_treatment"),
        *[F.col(c) for c in covariates],
        *([F.col("cum_weight").alias("start_weight")] if weighted else []),
    )
    starts = F.collect_list(F.when(F.col(spec.eligible) == 1, start)).over(spec.so_far())
    step = F.col(spec.treatment) != F.last(spec.treatment, ignorenulls=True).over(spec.past())
    narrow = df if last_visit is None else df.filter(F.col(spec.period) <= last_visit)
    rows = narrow.withColumns({"_starts": starts, "_step": F.when(step, F.col(spec.period))})
    if estimand == "PP":
        # A switch before the first recorded visit does not exist: NULL keeps every start.
        run = F.coalesce(F.max("_step").over(spec.so_far()), F.lit(-1))
        rows = rows.withColumn("_run", run).withColumn(
            "_starts", F.filter("_starts", lambda s: s["trial_period"] >= F.col("_run"))
        )
    kept = {
        spec.id: "id",
        spec.period: "_t",
        spec.outcome: "outcome",
        **({spec.treatment: "treatment"} if estimand == "AT" else {}),
        **({"cum_weight": "cum_weight"} if weighted else {}),
    }
    out = rows.select(
        *[F.col(old).alias(new) for old, new in kept.items()],
        *[F.col(c) for c in carry],
        F.inline("_starts"),
    )
    return out.select(
        "id",
        "trial_period",
        (F.col("_t") - F.col("trial_period")).alias("followup_time"),
        "assigned_treatment",
        "outcome",
        *(["treatment"] if estimand == "AT" else []),
        *([(F.col("cum_weight") / F.col("start_weight")).alias("weight")] if weighted else []),
        *covariates,
        *carry,
    )


def restrict_trials(expanded: DataFrame, trials: Sequence[int]) -> DataFrame:
    return expanded.filter(F.col("trial_period").isin(list(trials)))


def followup_dummies(df: DataFrame, visits: int, time: str = "followup_time") -> DataFrame:
    """Columns t_1 .. t_(visits-1)."""
    return df.withColumns(
        {f"t_{k}": F.when(F.col(time) == k, 1.0).otherwise(0.0) for k in range(1, visits)}
    )


def interactions(
    df: DataFrame,
    design: Design,
) -> DataFrame:
    """Add one column per term of ``design`` that is not in the table yet."""
    new = {t.name: t.spark() for t in design.terms if t.factors and t.name not in df.columns}
    return df.withColumns(new) if new else df


def product(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Product of two columns, such as treatment x covariate."""
    return df.withColumn(name, F.col(left) * F.col(right))


def set_strategy(
    df: DataFrame, treated: int, design: Design | None = None, treatment: str = "assigned_treatment"
) -> DataFrame:
    """Give everybody the same treatment and recompute the terms that contain it."""
    out = df.withColumn(treatment, F.lit(treated))
    if design is None:
        return out
    touched = {
        t.name: t.spark()
        for t in design.terms
        if t.name in df.columns and t.name != treatment and any(f.column == treatment for f in t.factors)
    }
    return out.withColumns(touched) if touched else out


def sample_controls(expanded: DataFrame, share: float, seed: int) -> DataFrame:
    """Keep every event row and a hash-drawn share of the others.

    ``sample_weight`` is 1 for events and 1/share for kept controls. Off unless
    called.
    """
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in TRIAL_KEY])
    kept = (F.col("outcome") == 1) | (hash_number(key) % 1_000_000 < int(share * 1_000_000))
    return expanded.filter(kept).withColumn(
        "sample_weight", F.when(F.col("outcome") == 1, 1.0).otherwise(1.0 / share)
    )
