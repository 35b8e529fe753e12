"""Column expressions for scalars: special functions, guarded maps, posterior moments of Gamma parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Recurrence steps before the asymptotic series of digamma and lgamma.
SHIFT = 6


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: recurrence up by SHIFT, then the asymptotic series (error below 2e-9)."""
    y = x + F.lit(float(SHIFT))
    r = F.lit(1.0) / (y * y)
    series = F.log(y) - F.lit(0.5) / y - r * (F.lit(1 / 12) - r * (F.lit(1 / 120) - r * F.lit(1 / 252)))
    for i in range(SHIFT):
        series = series - F.lit(1.0) / (x + F.lit(float(i)))
    return series


def digamma_sql(x: str) -> str:
    """The same as SQL text."""
    y = f"(({x}) + {float(SHIFT)}e0)"
    tail = "".join(f" - 1e0 / (({x}) + {float(i)}e0)" for i in range(SHIFT))
    return f"(ln({y}) - 0.5e0 / {y} - (1e0 / ({y} * {y})) * ({1 / 12!r} - (1e0 / ({y} * {y})) * ({1 / 120!r} - (1e0 / ({y} * {y})) * {1 / 252!r})){tail})"


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, by the same recurrence."""
    y = x + F.lit(float(SHIFT))
    r = F.lit(1.0) / y
    out = (y - F.lit(0.5)) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + r * (F.lit(1 / 12) - r * r * (F.lit(1 / 360) - r * r * F.lit(1 / 1260)))
    for i in range(SHIFT):
        out = out - F.log(x + F.lit(float(i)))
    return out


def safe_log(x: Column, eps: float = 1e-8) -> Column:
    return F.log(F.greatest(x, F.lit(eps)))


def safe_sqrt(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def safe_div(a: Column, b: Column, a0: float = 0.0, b0: float = 1e-8) -> Column:
    return (a + F.lit(a0)) / (b + F.lit(b0))


def at_least(x: Column, low: float) -> Column:
    return F.greatest(x, F.lit(low))


def clamp(x: Column, low: float, high: float) -> Column:
    """low < high is required."""
    if not low < high:
        raise ValueError("low must be below high")
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def is_obs(x: Column) -> Column:
    """1 for a finite value, else 0 (null too)."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), 1.0).otherwise(0.0)


def inf_zero(x: Column) -> Column:
    """Non-finite values and null become 0."""
    return F.when(is_obs(x) > 0, x).otherwise(0.0)


def is_positive(x: Column) -> Column:
    return F.when(x > 0, 1.0).otherwise(0.0)


def add_pseudo(x: Column, v: float) -> Column:
    return x + F.lit(v)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """low + (high - low) / (1 + exp(-x)), without overflow for large |x|."""
    e = F.exp(-F.abs(x))
    return F.lit(low) + F.lit(high - low) * F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_sum_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def gamma_mean(a: Column, b: Column) -> Column:
    return a / b


def gamma_sd(a: Column, b: Column) -> Column:
    return F.sqrt(a) / b


def gamma_log_mean(a: Column, b: Column) -> Column:
    return digamma(a) - F.log(b)


def gamma_log_sd(a: Column) -> Column:
    """1 / sqrt(a - 1) where a > 1, else 1 / sqrt(a)."""
    return F.lit(1.0) / F.sqrt(F.when(a > 1, a - 1).otherwise(a))
