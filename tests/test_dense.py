from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trigrid.operators import dense
from trigrid.operators.dense import dense_totals


@pytest.fixture
def rows(spark):
    """One key holds most rows; far, negative and null keys, null and NaN measures, repeated rows."""
    base = spark.range(5000).select(F.when(F.col("id") % 5 < 3, 7).when(F.col("id") % 5 == 3, F.col("id") * 100_003 - 70_000_000).otherwise(F.when(F.col("id") % 2 == 0, F.lit(-3))).cast("long").alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") * 0.5).alias("m"), F.lit("x").alias("__key"))
    return base.unionByName(base.limit(10)).withColumn("m", F.when(F.col("m") == 6.5, float("nan")).otherwise(F.col("m")))


def brute(rows):
    n, s = defaultdict(int), defaultdict(float)
    for r in rows.collect():
        if r["k"] is not None:
            n[r["k"]] += 1
            s[r["k"]] += r["m"] if r["m"] is not None and r["m"] == r["m"] else 0
    return {k: (n[k], round(s[k], 6)) for k in n}


@pytest.mark.parametrize("keys", [1_000_000, 10])
def test_totals(rows, keys, monkeypatch):
    """With the dictionary sent to the tasks, and joined."""
    monkeypatch.setattr(dense, "DICTIONARY_KEYS", keys)
    got = {r["k"]: (r["n"], round(r["m"], 6)) for r in dense_totals(rows, "k", ["m"]).collect()}
    assert got == brute(rows)


def test_no_rows(spark):
    assert dense_totals(spark.createDataFrame([], "k long, m double"), "k", ["m"]).count() == 0
    assert dense_totals(spark.createDataFrame([(None, 1.0)], "k long, m double"), "k", []).count() == 0
