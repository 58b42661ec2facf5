"""Session helpers: defaults for tests, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "emulant") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("EMULANT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that outlives executors, as the session names it.

    On a cluster ``spark.checkpoint.dir`` must be set; only a local session
    falls back to a folder of its own.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="emulant-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    """Unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def shuffles_freed(spark: SparkSession, batch_rows: int | None = None) -> Iterator[None]:
    """Queries that end within have their shuffle files removed; the setting is put back afterwards.

    Without it they stay on the disks of the executors until the driver's collector finds them.
    ``batch_rows`` bounds the rows that go to Python at once, for long texts.
    """
    now = {FREE_SHUFFLES: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {name: spark.conf.get(name, None) for name in now}
    for name, value in now.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


ADAPTIVE_CACHE = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def keep(df: DataFrame) -> DataFrame:
    """Persist ``df`` with partitions sized from its data.

    Adaptive execution only merges the partitions of a persisted plan if the session
    allows it; the setting is turned on for this plan and then put back. Without it
    every pass over a small table would start one task per shuffle partition.
    """
    conf = df.sparkSession.conf
    before = conf.get(ADAPTIVE_CACHE, None)
    conf.set(ADAPTIVE_CACHE, "true")
    try:
        return df.persist()
    finally:
        if before is None:
            conf.unset(ADAPTIVE_CACHE)
        else:
            conf.set(ADAPTIVE_CACHE, before)
