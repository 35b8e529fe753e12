from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigrid.functions import numeric, special as sp, vectors as vec


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize("x", [0.01, 0.5, 1.0, 2.5, 30.0, 1e6])
def test_digamma_and_lgamma(spark, x):
    h = 1e-4 * max(x, 0.1)
    slope = (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
    assert one(spark, sp.digamma(F.lit(x))) == pytest.approx(slope, rel=1e-4, abs=1e-4)
    assert one(spark, sp.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-9, abs=1e-7)
    assert numeric.digamma(x) == pytest.approx(one(spark, sp.digamma(F.lit(x))), rel=1e-12)
    assert numeric.lgamma(x) == pytest.approx(math.lgamma(x), rel=1e-9, abs=1e-7)


def test_known_digamma():
    assert numeric.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=2e-9)


def test_guarded_maps(spark):
    for c, want in [(sp.safe_log(F.lit(0.0)), math.log(1e-8)), (sp.safe_sqrt(F.lit(-4.0)), 0.0), (sp.clamp(F.lit(9.0), -1, 2), 2.0), (sp.inf_zero(F.lit(float("nan"))), 0.0), (sp.inf_zero(F.lit(float("inf"))), 0.0), (sp.is_obs(F.lit(None).cast("double")), 0.0), (sp.softplus(F.lit(800.0)), 800.0), (sp.softplus(F.lit(-800.0)), 0.0), (sp.sigmoid(F.lit(-800.0)), 0.0), (sp.sigmoid(F.lit(0.0), 0.2, 0.8), 0.5), (sp.log_sum_exp(F.lit(1000.0), F.lit(1000.0)), 1000 + math.log(2)), (sp.gamma_log_sd(F.lit(5.0)), 0.5), (sp.gamma_log_sd(F.lit(0.25)), 2.0)]:
        assert one(spark, c) == pytest.approx(want)
    with pytest.raises(ValueError):
        sp.clamp(F.lit(1.0), 2, 1)


def test_vectors(spark):
    v, w = np.array([1000.0, 1001, 999]), np.array([1.0, 2, 3])
    a, b = (F.array(*[F.lit(float(x)) for x in z]) for z in (v, w))
    soft = np.exp(v - 1001) / np.exp(v - 1001).sum()
    assert one(spark, vec.v_softmax(a)) == pytest.approx(soft.tolist())
    assert one(spark, vec.v_log_softmax_weighted(a, b)) == pytest.approx(numeric.log_softmax(v[None], w)[0].tolist())
    assert one(spark, vec.v_dot(a, b)) == pytest.approx(v @ w)
    assert one(spark, vec.v_argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 2
