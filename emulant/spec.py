"""Names and types of the person-period panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class PanelSpec:
    """Which column of a panel plays which part.

    A panel holds one row per ``(id, period)``; the pair is a unique key. Every
    operator that gathers the rows of a person relies on that key: it is what
    bounds the group to ``visits`` rows.
    """

    id: str = "id"
    period: str = "t"
    treatment: str = "A"
    prev_treatment: str = "Ap"
    outcome: str = "Y"
    eligible: str = "eligible"
    censor: str | None = None
    visits: int = 5

    def person(self) -> WindowSpec:
        return Window.partitionBy(self.id).orderBy(self.period)

    def past(self) -> WindowSpec:
        """All earlier visits of the person, the current one left out."""
        return self.person().rowsBetween(Window.unboundedPreceding, -1)

    def so_far(self) -> WindowSpec:
        """All visits of the person up to the current one."""
        return self.person().rowsBetween(Window.unboundedPreceding, Window.currentRow)


PANEL_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("t", T.IntegerType(), False),
        T.StructField("A", T.IntegerType()),
        T.StructField("Ap", T.IntegerType()),
        T.StructField("CAp", T.IntegerType()),
        T.StructField("X2", T.DoubleType()),
        T.StructField("X4", T.DoubleType()),
        T.StructField("Y", T.IntegerType()),
        T.StructField("Yp", T.IntegerType()),
        T.StructField("eligible", T.IntegerType()),
        T.StructField("C", T.IntegerType()),
    ]
)

CURVE_COLUMNS = (
    "followup_time",
    "survival_treatment",
    "survival_control",
    "survival_difference",
    "survival_ratio",
    "mrd",
)

# The six interval methods of the results table.
METHODS = (
    "bootstrap",
    "lef_outcome",
    "lef_both",
    "sandwich",
    "jackknife_mvn",
    "jackknife_wald",
)

# Methods whose limits are pivoted about the estimate.
PIVOT_METHODS = ("bootstrap", "lef_outcome", "lef_both")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that break uniqueness; an empty result means a valid panel."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column, so one missing value exists."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def clean(name: str) -> Column:
        if name not in floats:
            return F.col(name)
        return F.when(~F.isnan(name), F.col(name)).alias(name)

    return df.select(*[clean(c) for c in df.columns])
