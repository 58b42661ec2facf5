"""Joins of large tables with tables that are small by nature but not by proof."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulant.session import written

SMALL_ROWS = 200_000
SALTS = 32


def beside(rows: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], bound: int = SMALL_ROWS) -> DataFrame:
    """``rows`` joined to ``small``, which has one row for each key.

    ``small`` is written and counted. Up to ``bound`` rows it is broadcast, and no row of ``rows`` moves. Beyond, it is
    repeated for ``SALTS`` salts and the rows of a key are dealt over these by a hash of ``spread``: a few keys
    then still fill many tasks.
    """
    on = list(on)
    small = written(small, "small-side")
    if small.count() <= bound:
        return rows.join(F.broadcast(small), on)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(salted, [*on, "_salt"]).drop("_salt")
