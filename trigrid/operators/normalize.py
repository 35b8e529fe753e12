"""Normalisers: columns of sparse matrices, and columns of tables of K-vectors (id, v)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from trigrid.runtime import lookup_join

#: Values an exact quantile gathers at most.
GATHERED = 100_000


def l2_columns(coo: DataFrame, scale: float = 1.0) -> DataFrame:
    """value / max(norm of its column, 1e-8) * scale."""
    norms = coo.groupBy("col_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__n"))
    return coo.join(norms, "col_id").select("row_id", "col_id", (F.col("value") / F.greatest("__n", F.lit(1e-8)) * F.lit(scale)).alias("value"))


def l1_columns(coo: DataFrame) -> DataFrame:
    """value / max(sum of its column, 1)."""
    sums = coo.groupBy("col_id").agg(F.sum("value").alias("__n"))
    return coo.join(sums, "col_id").select("row_id", "col_id", (F.col("value") / F.greatest("__n", F.lit(1.0))).alias("value"))


def moments(vecs: DataFrame, k: int, v: str = "v", eps: float = 1e-8) -> tuple[list[float], list[float]]:
    """(mu, sd) of each of k columns of (id, v) over finite values: variance E[x^2] - E[x]^2 + eps; if one is negative all are raised by the least."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    at = [F.get(v, F.lit(i)) for i in range(k)]
    aggs = []
    for i, x in enumerate(at):
        aggs += [F.count_if(finite(x)).alias(f"n{i}"), F.sum(F.when(finite(x), x)).alias(f"s{i}"), F.sum(F.when(finite(x), x * x)).alias(f"q{i}")]
    r: Row = vecs.agg(*aggs).first()
    mu = [(r[f"s{i}"] or 0.0) / (r[f"n{i}"] + eps) for i in range(k)]
    var = [(r[f"q{i}"] or 0.0) / (r[f"n{i}"] + eps) - mu[i] ** 2 + eps for i in range(k)]
    low = min([0.0, *var])
    return mu, [math.sqrt(x - low) for x in var]


def standardize(vecs: DataFrame, k: int, v: str = "v", eps: float = 1e-8, centre: bool = True, scale: bool = True) -> DataFrame:
    """(x - mu) / (sd + eps) in each column. One aggregate of k columns; an empty table stays empty."""
    mu, sd = moments(vecs, k, v, eps)
    mu = mu if centre else [0.0] * k
    sd = sd if scale else [1.0 - eps] * k
    return vecs.withColumn(v, F.array(*[(F.get(v, F.lit(i)) - F.lit(mu[i])) / F.lit(sd[i] + eps) for i in range(k)]))


def _stream(values: DataFrame, rank: int) -> float:
    """The value at a rank of a column x with few distinct values in the way: counts by value, in order."""
    for r in values.groupBy("x").count().orderBy("x").toLocalIterator():
        if rank < r["count"]:
            return r["x"]
        rank -= r["count"]
    raise ValueError("rank beyond the values")


def _select(values: DataFrame, ranks: list[int], n: int) -> list[float]:
    """The values at 0-based ranks of a column x: brackets by approximate percentiles and exact counts, all ranks in one pass each, then one bounded gather."""
    x = F.col("x")
    low, high, below, inside = ([v] * len(ranks) for v in (-math.inf, math.inf, 0, n))
    stuck: set[int] = set()
    within = lambda i: (x > low[i]) & (x <= high[i]) if math.isfinite(low[i]) else x <= high[i]
    while open_ := [i for i in range(len(ranks)) if inside[i] > GATHERED and i not in stuck]:
        share = [(r - b) / m for r, b, m in zip(ranks, below, inside, strict=True)]
        p = values.agg(*[F.percentile_approx(F.when(within(i), x), [max(0.0, share[i] - 2e-3), min(1.0, share[i] + 2e-3)], 10_000).alias(f"p{i}") for i in open_]).first()
        c = values.agg(*[F.count_if(within(i) & (x <= p[f"p{i}"][e])).alias(f"c{i}{e}") for i in open_ for e in (0, 1)]).first()
        for i in open_:
            (lo, hi), a, b, rank, before = p[f"p{i}"], c[f"c{i}0"], c[f"c{i}1"], ranks[i] - below[i], inside[i]
            if rank < a:
                high[i], inside[i] = lo, a
            elif rank < b:
                low[i], high[i], below[i], inside[i] = lo, hi, below[i] + a, b - a
            else:
                low[i], below[i], inside[i] = hi, below[i] + b, inside[i] - b
            if inside[i] == before:  # many equal values
                stuck.add(i)
    out = {i: _stream(values.where(within(i)), ranks[i] - below[i]) for i in stuck}
    if small := [i for i in range(len(ranks)) if i not in stuck]:
        got = np.sort(values.where(reduce(lambda a, b: a | b, (within(i) for i in small))).toArrow().column(0).to_numpy())
        out |= {i: float(got[np.searchsorted(got, low[i], "right") + ranks[i] - below[i]]) for i in small}
    return [out[i] for i in range(len(ranks))]


def quantile_bounds(vecs: DataFrame, q_low: float, q_high: float, v: str = "v") -> tuple[float, float] | None:
    """The order statistics at ceil(q * n) (from 0) of all n cells of (id, v) that aren't null or NaN; the least and largest where out of range. None if empty."""
    values = vecs.select(F.explode(v).alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    r = values.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n, lo, hi = r["n"], r["lo"], r["hi"]
    if not n:
        return None
    p, q = math.ceil(q_low * n), math.ceil(q_high * n)
    if p >= q:
        return lo, hi
    ranks = [k for k in (p, q) if k < n]
    found = dict(zip(ranks, _select(values, ranks, n), strict=True)) if ranks else {}
    return found.get(p, lo), found.get(q, hi)


def quantile_clip(vecs: DataFrame, q_low: float = 0.01, q_high: float = 0.99, v: str = "v") -> DataFrame:
    """Clip all cells to the bounds of the whole matrix, if they differ."""
    bounds = quantile_bounds(vecs, q_low, q_high, v)
    if bounds is None or not bounds[0] < bounds[1]:
        return vecs
    return vecs.withColumn(v, F.transform(v, lambda x: F.least(F.greatest(x, F.lit(bounds[0])), F.lit(bounds[1]))))


def stretch(vecs: DataFrame, k: int, q_low: float = 0.01, q_high: float = 0.99, v: str = "v") -> DataFrame:
    """Quantile clip, then standardise the columns."""
    return standardize(quantile_clip(vecs, q_low, q_high, v), k, v)


def stretch_nonnegative(vecs: DataFrame, k: int, q_low: float = 0.01, q_high: float = 0.99, low: float = -8.0, high: float = 8.0, v: str = "v") -> DataFrame:
    """exp of the clamped, stretched logarithms (floored at 1 / rows). Unchanged if empty or if any cell is negative."""
    r = vecs.agg(F.count("*").alias("n"), F.min(F.array_min(v)).alias("lo")).first()
    if not r["n"] or r["lo"] is None or r["lo"] < 0:
        return vecs
    floor = 1.0 / r["n"]
    logs = vecs.withColumn(v, F.transform(v, lambda x: F.log(F.greatest(x, F.lit(floor)))))
    out = stretch(logs, k, q_low, q_high, v)
    return out.withColumn(v, F.transform(v, lambda x: F.exp(F.least(F.greatest(x, F.lit(low)), F.lit(high)))))


def scale_rows(coo: DataFrame, factors: DataFrame) -> DataFrame:
    """value times the factor (row_id, factor) of its row; rows without one are left out."""
    return lookup_join(coo, factors.select("row_id", "factor"), ["row_id"], "inner").select("row_id", "col_id", (F.col("value") * F.col("factor")).alias("value"))
