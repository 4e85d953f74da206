"""The contract's three functions, and the oracle on the smallest tables."""
import os

import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["q1_query_facts", "g12_degrees", "a22_package_metrics", "d4_snapshot_diff", "l1_http"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    got, want = entry.queries()[name](spark, SMALL), c.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(str([r[k] for k in cols]) for r in got.collect()) == sorted(str([dict(zip(want.columns, r))[k] for k in cols]) for r in want.fetchall())
