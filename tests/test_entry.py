from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}") + 0.0
    return x


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_against_sql(spark, name):
    """Every query runs on the smallest tables and agrees with its SQL, if it has one."""
    import duckdb

    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for p in os.listdir(DATA):
            con.execute(f"CREATE VIEW {p[:-8]} AS SELECT * FROM '{DATA}/{p}'")
        r = con.sql(entry.oracle_sql()[name])
        at = [r.columns.index(c) for c in cols]
        assert got == sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())
