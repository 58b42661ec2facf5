"""Reading and writing panels, result tables and fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulant.spec import PANEL_SCHEMA, nan_to_null

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("outcome", T.StringType()),
        T.StructField("scenario", T.IntegerType()),
        T.StructField("iter", T.LongType()),
        T.StructField("visit", T.IntegerType()),
        T.StructField("method", T.StringType()),
        T.StructField("est", T.DoubleType()),
        T.StructField("lb", T.DoubleType()),
        T.StructField("ub", T.DoubleType()),
    ]
)


def read_panel(
    spark: SparkSession, path: str, schema: T.StructType = PANEL_SCHEMA, fmt: str = "parquet"
) -> DataFrame:
    """Read a panel with a fixed schema; NaN (and "NA" in CSV) becomes NULL."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "NA")
    return nan_to_null(reader.format(fmt).load(path))


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error"
) -> None:
    """Write any result; CSV gets a header line and "NA" for NULL."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Add interval results, one folder per outcome and scenario.

    Rows are first gathered by folder and salted by iteration, so a scenario with
    most of the rows is still written by several tasks.
    """
    salted = df.repartition(F.col("outcome"), F.col("scenario"), F.pmod(F.xxhash64("iter"), F.lit(16)))
    write_table(salted, path, partition_by=("outcome", "scenario"), mode=mode)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All interval results below ``path`` as one long table.

    Filters on ``outcome`` and ``scenario`` prune folders.
    """
    return spark.read.schema(RESULT_SCHEMA).parquet(path)


def save_model(coefficients: DataFrame, covariance: DataFrame, path: str, mode: str = "error") -> None:
    """Store coefficient rows ``(model, term, estimate, std_error)`` and covariance rows."""
    coefficients.write.mode(mode).parquet(f"{path}/coefficients")
    covariance.write.mode(mode).parquet(f"{path}/covariance")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/coefficients"), spark.read.parquet(f"{path}/covariance")
