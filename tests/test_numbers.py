from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigrid.functions import numeric
from trigrid.operators import linalg, normalize


def frame(spark, x, ids=None):
    return spark.createDataFrame(list(zip(range(len(x)) if ids is None else np.asarray(ids).tolist(), np.asarray(x, float).tolist(), strict=True)), "id long, v array<double>").repartition(3)


def array(df, v="v"):
    return np.array([r[v] for r in df.orderBy("id").collect()])


def stretched(x, lo=0.01, hi=0.99):
    s = np.sort(x.ravel())
    p, q = math.ceil(lo * len(s)), math.ceil(hi * len(s))
    a, b = s[min(p, len(s) - 1)], s[min(q, len(s) - 1)]
    return numeric.standardize(np.clip(x, a, b) if a < b else x)


def test_standardize_and_stretch(spark):
    x = np.random.default_rng(0).normal(3, 2, (300, 4))
    assert np.allclose(array(normalize.standardize(frame(spark, x), 4)), numeric.standardize(x))
    assert np.allclose(array(normalize.stretch(frame(spark, x), 4)), stretched(x))
    bad = x.copy()
    bad[3, 1], bad[5, 2] = np.nan, np.inf
    got = array(normalize.standardize(frame(spark, bad), 4))
    assert np.allclose(got, numeric.standardize(bad), equal_nan=True)
    same = np.full((10, 2), 7.0)
    assert np.allclose(array(normalize.standardize(frame(spark, same), 2)), 0, atol=1e-3)


@pytest.mark.parametrize("gathered", [100_000, 50])
def test_quantiles_are_order_statistics(spark, monkeypatch, gathered):
    """Also when the values are narrowed down before they are gathered, and with ties."""
    monkeypatch.setattr(normalize, "GATHERED", gathered)
    x = np.random.default_rng(1).normal(0, 1, (700, 3))
    x[:400] = np.round(x[:400], 1)
    s = np.sort(x.ravel())
    for lo, hi in ((0.01, 0.99), (0.3, 0.7), (0.0, 1.0)):
        p, q = math.ceil(lo * len(s)), math.ceil(hi * len(s))
        assert normalize.quantile_bounds(frame(spark, x), lo, hi) == (s[p], s[min(q, len(s) - 1)])
    assert normalize.quantile_bounds(frame(spark, x), 0.5, 0.5) == (s[0], s[-1])


def test_stretch_nonnegative(spark):
    x = np.random.default_rng(2).gamma(1, 1, (100, 3))
    want = np.exp(np.clip(stretched(np.log(np.maximum(x, 1 / 100))), -8, 8))
    assert np.allclose(array(normalize.stretch_nonnegative(frame(spark, x), 3)), want)
    x[0, 0] = -1
    assert np.allclose(array(normalize.stretch_nonnegative(frame(spark, x), 3)), x)
    assert normalize.stretch_nonnegative(spark.createDataFrame([], "id long, v array<double>"), 3).count() == 0


def test_projection_does_not_depend_on_partitions(spark):
    coo = spark.range(2000).select((F.col("id") % 50 + 1).alias("row_id"), (F.col("id") * 7 % 90 + 1).alias("col_id"), F.lit(1.0).alias("value"))
    a, b = (array(linalg.project(c, 3)) for c in (coo, coo.repartition(9)))
    assert np.allclose(a, b)
    p = np.array([r["v"] for r in linalg.projection(coo, 3).orderBy("row_id").collect()])
    y = np.zeros((51, 91))
    for r in coo.collect():
        y[r["row_id"], r["col_id"]] += 1
    got = {r["id"]: r["v"] for r in linalg.project(coo, 3).collect()}
    assert all(np.allclose(got[c], p.T @ y[1:, c]) for c in got)
    g = np.array([r["v"] for r in linalg.projection(spark.range(20_000).withColumnRenamed("id", "row_id"), 2).collect()])
    assert abs(g.mean()) < 0.02 and abs(g.std() - 1) < 0.02 and abs(np.corrcoef(g.T)[0, 1]) < 0.03


def test_singular_vectors(spark):
    x = np.random.default_rng(3).normal(0, 1, (200, 5))
    x[:, 4] = x[:, 0] + x[:, 1]  # one direction is nothing
    left, s, right = linalg.singular(frame(spark, x), 5)
    assert len(s) == 4 and np.allclose(s, np.linalg.svd(x)[1][:4])
    u = array(left)
    assert np.allclose(u.T @ u, np.eye(4), atol=1e-6) and np.allclose(u * s @ right.T, x, atol=1e-6)


def test_residuals(spark):
    rng = np.random.default_rng(4)
    y, x = rng.normal(0, 1, (150, 3)), rng.normal(0, 1, (150, 2))
    z = numeric.standardize(x)
    want = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    assert np.allclose(array(linalg.residual(frame(spark, y), frame(spark, x), 3, 2)), want, atol=1e-6)
    z1 = z[:, :1]
    want = y - z1 @ (z1.T @ y / ((z1**2).sum() + 1e-8))
    assert np.allclose(array(linalg.residual(frame(spark, y), frame(spark, x[:, :1]), 3, 1)), want, atol=1e-6)


def test_column_norms(spark):
    coo = spark.createDataFrame([(1, 1, 3.0), (2, 1, 4.0), (1, 2, 0.0), (1, 3, 0.2)], "row_id long, col_id long, value double")
    got = {(r["row_id"], r["col_id"]): r["value"] for r in normalize.l2_columns(coo, 10).collect()}
    assert got == pytest.approx({(1, 1): 6.0, (2, 1): 8.0, (1, 2): 0.0, (1, 3): 10.0})
    got = {(r["row_id"], r["col_id"]): r["value"] for r in normalize.l1_columns(coo).collect()}
    assert got == pytest.approx({(1, 1): 3 / 7, (2, 1): 4 / 7, (1, 2): 0.0, (1, 3): 0.2})


@pytest.mark.parametrize("dims", [2, 5, 24])
def test_touched_leaves_lose_nothing(dims):
    """Every vector within reach is in the row's own leaf or in one that it touches; few others are touched."""
    from trigrid.functions.leaves import Leaves

    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 1, (900, dims)), rng.normal(0, 1, (30, dims))[rng.integers(0, 30, 600)] + rng.normal(0, 0.05, (600, dims))])
    leaves = Leaves(x, len(x), 40)
    home, d = leaves.home(x)
    for reach in (0.05, 0.3, 1.0):
        row, leaf = leaves.touched(home, d, reach)
        held = set(zip(row.tolist(), leaf.tolist(), strict=True))
        near = ((x[:, None] - x[None]) ** 2).sum(2) <= reach**2
        assert all(home[i] == home[j] or (i, home[j]) in held for i, j in zip(*np.nonzero(near), strict=True))
        assert len(leaves.c) > 20 and len(held) < len(x) * (len(leaves.c) - 1)


def test_quantiles_of_many_equal_values(spark, monkeypatch):
    monkeypatch.setattr(normalize, "GATHERED", 40)
    rng = np.random.default_rng(3)
    for x in (np.zeros((300, 2)), rng.integers(0, 3, (300, 2)).astype(float), np.concatenate([np.full((250, 2), 5.0), rng.normal(0, 1, (50, 2))]), rng.normal(0, 1, (300, 2))):
        v = np.sort(x.ravel())
        values = frame(spark, x).select(F.explode("v").alias("x"))
        ranks = [0, 1, 37, 299, 300, 598, 599]
        assert normalize._select(values, ranks, len(v)) == v[ranks].tolist()
