"""Derived columns of the person-period panel.

All windows share one partitioning and ordering (person, by visit), so a chain of
these operators costs one shuffle and one sort, whatever its length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulant.spec import PanelSpec


def add_lags(
    df: DataFrame, spec: PanelSpec, k: int = 1, column: str | None = None, names: Sequence[str] | None = None
) -> DataFrame:
    """Treatment (or ``column``) at the 1..k previous visits, 0 before the first."""
    column = column or spec.treatment
    names = names or ["A" + "p" * i for i in range(1, k + 1)]
    w = spec.person()
    return df.withColumns({n: F.lag(column, i + 1, 0).over(w) for i, n in enumerate(names)})


def add_cum_exposure(
    df: DataFrame,
    spec: PanelSpec,
    exposure: Column | None = None,
    include_current: bool = False,
    name: str = "CAp",
) -> DataFrame:
    """Running count of exposed visits, before the current one unless asked."""
    exposure = F.col(spec.treatment) if exposure is None else exposure.cast("int")
    w = spec.so_far() if include_current else spec.past()
    return df.withColumn(name, F.coalesce(F.sum(exposure).over(w), F.lit(0)).cast("int"))


def add_eligible(df: DataFrame, spec: PanelSpec, condition: Column | None = None) -> DataFrame:
    """1 when a trial may start: never treated, no event yet, and ``condition``."""
    ok = (F.col("CAp") == 0) & (F.col("Yp") == 0)
    if condition is not None:
        ok = ok & condition
    return df.withColumn(spec.eligible, F.when(ok, 1).otherwise(0))


def mark_dropout(df: DataFrame, spec: PanelSpec, censor: str = "C", name: str = "dropped") -> DataFrame:
    """0 up to and including the first visit with ``censor`` = 1, then 1."""
    earlier = F.max(censor).over(spec.past())
    return df.withColumn(name, F.coalesce(earlier, F.lit(0)))


def truncate_followup(df: DataFrame, spec: PanelSpec, censor: str | None = "C") -> DataFrame:
    """Rows up to drop-out, without an earlier event, from first eligibility on."""
    keep = (F.col("Yp") == 0) & (F.sum(spec.eligible).over(spec.so_far()) > 0)
    if censor is not None:
        keep = keep & (F.coalesce(F.max(censor).over(spec.past()), F.lit(0)) == 0)
    return df.withColumn("_keep", keep).filter("_keep").drop("_keep")


def carry_outcome(df: DataFrame, spec: PanelSpec, event: str, previous: str = "Yp") -> DataFrame:
    """Absorbing outcome from an event flag, and its value before the visit."""
    return df.withColumns(
        {
            spec.outcome: F.max(event).over(spec.so_far()),
            previous: F.coalesce(F.max(event).over(spec.past()), F.lit(0)),
        }
    )


def standardise(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Replace each column by its transform, centred and scaled by the sample SD.

    ``columns`` maps a name to the transformed expression. Mean and SD of all of
    them come from one aggregate over the table, read as a scalar subquery.
    """
    stats = df.agg(
        F.struct(
            *[F.avg(e).alias(f"{n}_mean") for n, e in columns.items()],
            *[F.stddev_samp(e).alias(f"{n}_sd") for n, e in columns.items()],
        )
    ).scalar()
    return df.withColumns(
        {n: (e - stats.getField(f"{n}_mean")) / stats.getField(f"{n}_sd") for n, e in columns.items()}
    )


def affine(column: str, centre: float, scale: float) -> Column:
    return (F.col(column) - F.lit(float(centre))) / F.lit(float(scale))


def recode(conditions: Sequence[tuple[Column, object]], default: object) -> Column:
    """First matching condition decides the level."""
    (first, value), *rest = conditions
    out = F.when(first, F.lit(value))
    for condition, value in rest:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def dummies(df: DataFrame, column: str, levels: Sequence, prefix: str | None = None) -> DataFrame:
    """0/1 columns for every level but the first, which is the baseline."""
    prefix = prefix if prefix is not None else column
    return df.withColumns(
        {f"{prefix}_{i}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for i, v in enumerate(levels) if i}
    )


def shift_time(df: DataFrame, visit: str, origin: int, name: str = "t") -> DataFrame:
    return df.withColumn(name, (F.col(visit) - F.lit(origin)).cast("int"))


def add_time_on_regime(df: DataFrame, spec: PanelSpec, name: str = "time_on_regime") -> DataFrame:
    """Visits spent on the present treatment since the last switch, and its square.

    The count restarts at 0 on the visit of a switch. Assumption: the count runs
    over recorded visits of the person.
    """
    w = spec.person()
    flagged = df.withColumn(
        "_start",
        F.when(F.col(spec.treatment).eqNullSafe(F.lag(spec.treatment).over(w)), None).otherwise(F.row_number().over(w)),
    )
    since = (F.row_number().over(w) - F.max("_start").over(spec.so_far())).cast("int")
    return (
        flagged.withColumn(name, since)
        .withColumn(f"{name}_sq", F.col(name) * F.col(name))
        .drop("_start")
    )


def first_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """First visit of each person."""
    return _pick(df, spec, F.min_by)


def last_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Last visit of each person."""
    return _pick(df, spec, F.max_by)


def _pick(df: DataFrame, spec: PanelSpec, choose) -> DataFrame:
    row = F.struct(*[c for c in df.columns if c != spec.id])
    picked = df.groupBy(spec.id).agg(choose(row, F.col(spec.period)).alias("_row"))
    return picked.select(spec.id, "_row.*").select(*df.columns)


def baseline_values(df: DataFrame, spec: PanelSpec, columns: Sequence[str]) -> DataFrame:
    """Replace columns by their value at the person's first visit."""
    w = Window.partitionBy(spec.id).orderBy(spec.period)
    return df.withColumns({c: F.first(c).over(w) for c in columns})
