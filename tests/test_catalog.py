import duckdb
import pytest

import __spark_entry__ as entry
from check import normal

SAMPLE = ("per_protocol_trials", "risk_difference_curve", "bootstrap_percentile_limits", "pivotal_coverage", "weight_summary")


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "followup_time" and df.count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("customer", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = normal(entry.queries()[name](spark, folder).toPandas())
    want = normal(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == object:
            assert (got[c] == want[c]).all()
        else:
            assert ((got[c] - want[c]).abs() < 2e-6).all()
