"""Column expressions for K-vectors (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def v_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def v_add(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda x, y: x + y)


def v_mul(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda x, y: x * y)


def v_scale(v: Column, c: Column) -> Column:
    return F.transform(v, lambda x: x * c)


def v_dot(u: Column, v: Column) -> Column:
    return v_sum(v_mul(u, v))


def v_log_sum_exp(v: Column) -> Column:
    m = F.array_max(v)
    return m + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def v_log_softmax(v: Column) -> Column:
    """v - log sum exp(v); elements add up to one after exp."""
    s = v_log_sum_exp(v)
    return F.transform(v, lambda x: x - s)


def v_log_softmax_weighted(v: Column, w: Column) -> Column:
    """v - log sum w exp(v)."""
    m = F.array_max(v)
    s = m + F.log(F.aggregate(F.zip_with(v, w, lambda x, y: F.exp(x - m) * y), F.lit(0.0), lambda a, x: a + x))
    return F.transform(v, lambda x: x - s)


def v_softmax(v: Column) -> Column:
    return F.transform(v_log_softmax(v), lambda x: F.exp(x))


def v_argmax(v: Column) -> Column:
    """1-based position of the first largest element."""
    return F.array_position(v, F.array_max(v))


def v_sums(v: str, k: int, weight: Column | None = None) -> Column:
    """Aggregate: the element-wise sums of an array column, as an array; each optionally times a scalar column."""
    return F.array(*[F.sum(F.get(v, F.lit(i)) * weight if weight is not None else F.get(v, F.lit(i))) for i in range(k)])


def v_round(v: Column, digits: int) -> Column:
    return F.transform(v, lambda x: F.round(x, digits) + F.lit(0.0))
