"""Every registered query against its DuckDB oracle on the smallest scale factor."""
import os

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    r = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF)
    assert r["ok"], r


def test_rows_only_queries_run(spark):
    for key in sorted(set(E.queries()) - set(E.oracle_sql())):
        assert E.queries()[key](spark, SF).count() > 0, key


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "nearest_poi_m" in df.columns
