"""Poisson matrix factorisation Y ~ beta theta'.

Small matrices (pseudo-bulk: counted cells within a bound) are fitted with numpy on the driver; any size by half-steps over
(row_id, col_id, value), each a join with a K-array dictionary and one aggregate. Both follow the same updates: with
E[log] of one factor, z = y E[log f] / max(sum y, 1) + E[log g], standardised by column if asked, softmax to rho; then
g ~ Gamma(a0 + sum y * rho, b0 + sums of the other factor's means).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrid.functions.numeric import digamma, log_softmax, standardize
from trigrid.functions.special import digamma as digamma_column
from trigrid.functions.vectors import v_add, v_log_softmax, v_log_softmax_weighted, v_mul, v_sums
from trigrid.operators.linalg import uniform_of
from trigrid.operators.normalize import standardize as standardize_columns
from trigrid.runtime import counted_join, lookup_join, materialize, release, scratch

#: Cells of a matrix that is brought to the driver at most.
DENSE_CELLS = 20_000_000


class Gamma:
    """Parameters a, b of independent Gamma factors; statistics are added to the prior."""

    def __init__(self, rows: int, k: int, a0: float, b0: float) -> None:
        self.a0, self.b0, self.shape = a0, b0, (rows, k)
        self.reset()

    def reset(self) -> None:
        self.a, self.b = np.full(self.shape, self.a0), np.full(self.shape, self.b0)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = self.a + a, self.b + b

    def set(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = self.a0 + a, self.b0 + b

    @property
    def mean(self) -> np.ndarray:
        return self.a / self.b

    @property
    def log_mean(self) -> np.ndarray:
        return digamma(self.a) - np.log(self.b)

    @property
    def log_sd(self) -> np.ndarray:
        return 1 / np.sqrt(np.where(self.a > 1, self.a - 1, self.a))


@dataclass
class Fit:
    """Result of a fit; lists where there are several matrices."""

    llik: list[float]
    beta: Gamma | list[Gamma]
    theta: Gamma | list[Gamma]
    delta: list[Gamma] = field(default_factory=list)
    tree: np.ndarray | None = None
    col_sum: np.ndarray | None = None
    log_aux: np.ndarray | None = None


def dense(coo: DataFrame, n_rows: int, n_cols: int) -> np.ndarray:
    """The matrix as numpy, ids 1..: only within DENSE_CELLS."""
    if n_rows * n_cols > DENSE_CELLS:
        raise ValueError("too large for the driver: use fit_distributed")
    y = np.zeros((n_rows, n_cols))
    t = coo.select("row_id", "col_id", "value").toArrow()
    np.add.at(y, (t.column(0).to_numpy() - 1, t.column(1).to_numpy() - 1), t.column(2).to_numpy())
    return y


def log_likelihood(y: np.ndarray, beta: np.ndarray, theta: np.ndarray, r: np.ndarray | None = None, c: np.ndarray | None = None) -> float:
    """(sum y log max(lambda, 1e-8) - sum lambda) / cells, lambda = r beta theta' c; without log y!."""
    r = np.ones(len(beta)) if r is None else r
    c = np.ones(len(theta)) if c is None else c
    rate = (r[:, None] * beta) @ (c[:, None] * theta).T
    return float((y * np.log(np.maximum(rate, 1e-8))).sum() - rate.sum()) / y.size


def _rho(z: np.ndarray, stdize: bool, weights: np.ndarray | None = None) -> np.ndarray:
    return np.exp(log_softmax(standardize(z) if stdize else z, weights))


def col_step(y: np.ndarray, beta_log: np.ndarray, beta_mean: np.ndarray, theta: Gamma, stdize: bool, r: np.ndarray, c: np.ndarray) -> None:
    """Add the statistics of one matrix to theta."""
    total = y.sum(0)
    z = y.T @ beta_log / np.maximum(total, 1)[:, None] + theta.log_mean
    theta.add(total[:, None] * _rho(z, stdize), np.outer(c, r @ beta_mean))


def row_step(y: np.ndarray, theta: Gamma, beta: Gamma, stdize: bool, r: np.ndarray, c: np.ndarray) -> None:
    total = y.sum(1)
    z = y @ theta.log_mean / np.maximum(total, 1)[:, None] + beta.log_mean
    beta.add(total[:, None] * _rho(z, stdize), np.outer(r, c @ theta.mean))


def _start(beta: Gamma, rng: np.random.Generator, jitter: float) -> None:
    beta.set(rng.gamma(beta.a0, 1 / beta.b0, beta.shape) * jitter, np.ones(beta.shape))


def _start_svd(y: np.ndarray, beta: Gamma, jitter: float) -> None:
    z = np.clip(standardize(np.log1p(np.maximum(y, 0))), -8, 8)
    u = np.linalg.svd(z, full_matrices=False)[0][:, : beta.shape[1]]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    beta.set(np.maximum(u, 0) * jitter, np.ones(beta.shape))


def _prepare(y: np.ndarray, log1p: bool, normalize: bool, eps: float) -> tuple[np.ndarray, np.ndarray]:
    y = np.log1p(y) if log1p else np.asarray(y, float)
    s = y.sum(0)
    return (y / (s + eps) * len(y) if normalize else y), s


def _iterate(step, score, iterations: int, eps: float, first: float) -> list[float]:
    """Until the relative change of the log-likelihood is below eps (from the third round on)."""
    trace = [first]
    for t in range(iterations):
        step()
        trace.append(score())
        if t > 1 and abs(trace[-1] - trace[-2]) / abs(trace[-1] + eps) < eps:
            break
    return trace


def fit(y: np.ndarray, k: int, iterations: int = 100, a0: float = 1.0, b0: float = 1.0, log1p: bool = False, seed: int = 1337, svd_init: bool = False, degree: bool = False, normalize: bool = False, eps: float = 1e-8, jitter: float = 1.0) -> Fit:
    y, s = _prepare(y, log1p, normalize, eps)
    d, n = y.shape
    k = min(k, n, d)
    beta, theta = Gamma(d, k, a0, b0), Gamma(n, k, a0, b0)
    if svd_init:
        _start_svd(y, beta, jitter)
    else:
        _start(beta, np.random.default_rng(seed), jitter)
    r, c = (y.mean(1), y.mean(0)) if degree else (np.ones(d), np.ones(n))

    def step() -> None:
        log, mean = beta.log_mean, beta.mean
        prior = theta.log_mean
        theta.reset()
        z = y.T @ log / np.maximum(y.sum(0), 1)[:, None] + prior
        theta.add(y.sum(0)[:, None] * _rho(z, d >= n), np.outer(c, r @ mean))
        prior = beta.log_mean
        beta.reset()
        z = y @ theta.log_mean / np.maximum(y.sum(1), 1)[:, None] + prior
        beta.add(y.sum(1)[:, None] * _rho(z, n > d), np.outer(r, c @ theta.mean))

    score = lambda: log_likelihood(y, beta.mean, theta.mean, r, c)
    return Fit(_iterate(step, score, iterations, eps, score()), beta, theta, col_sum=s)


def fit_cbind(ys: list[np.ndarray], k: int, iterations: int = 100, a0: float = 1.0, b0: float = 1.0, log1p: bool = False, seed: int = 1337, normalize: bool = False, eps: float = 1e-8, jitter: float = 1.0) -> Fit:
    """Y(t) ~ beta theta(t)': the same rows. beta is reset once a round and adds up over matrices."""
    ys = [_prepare(y, log1p, normalize, eps)[0] for y in ys]
    d, most = len(ys[0]), max(y.shape[1] for y in ys)
    k = min(k, min(y.shape[1] for y in ys))
    rng = np.random.default_rng(seed)
    beta = Gamma(d, k, a0, b0)
    thetas = [Gamma(y.shape[1], k, a0, b0) for y in ys]
    for t in thetas:
        _start(t, rng, jitter)
    _start(beta, rng, jitter)
    one = np.ones(d)
    ones = [np.ones(y.shape[1]) for y in ys]

    def step() -> None:
        log, mean, prior = beta.log_mean, beta.mean, beta.log_mean
        a, b = np.zeros(beta.shape), np.zeros(beta.shape)
        for y, t, c in zip(ys, thetas, ones, strict=True):
            z = y.T @ log / np.maximum(y.sum(0), 1)[:, None] + t.log_mean
            t.reset()
            t.add(y.sum(0)[:, None] * _rho(z, d >= most), np.outer(c, one @ mean))
            z = y @ t.log_mean / np.maximum(y.sum(1), 1)[:, None] + prior
            a += y.sum(1)[:, None] * _rho(z, most > d)
            b += np.outer(one, c @ t.mean)
        beta.reset()
        beta.add(a, b)

    score = lambda: sum(log_likelihood(y, beta.mean, t.mean) for y, t in zip(ys, thetas, strict=True))
    return Fit(_iterate(step, score, iterations, eps, score()), beta, thetas)


def fit_rbind(ys: list[np.ndarray], k: int, iterations: int = 100, a0: float = 1.0, b0: float = 1.0, log1p: bool = False, seed: int = 1337, normalize: bool = False, eps: float = 1e-8, jitter: float = 1.0) -> Fit:
    """Y(t) ~ beta(t) theta': the same columns. theta is reset once a round and adds up over matrices."""
    ys = [_prepare(y, log1p, normalize, eps)[0] for y in ys]
    n, most = ys[0].shape[1], max(len(y) for y in ys)
    k = min(k, n, *(len(y) for y in ys))
    rng = np.random.default_rng(seed)
    theta = Gamma(n, k, a0, b0)
    betas = [Gamma(len(y), k, a0, b0) for y in ys]
    for b in betas:
        _start(b, rng, jitter)
    c = np.ones(n)

    def step() -> None:
        prior = theta.log_mean
        theta.reset()
        for y, beta in zip(ys, betas, strict=True):
            r = np.ones(len(y))
            z = y.T @ beta.log_mean / np.maximum(y.sum(0), 1)[:, None] + prior
            theta.add(y.sum(0)[:, None] * _rho(z, most >= n), np.outer(c, r @ beta.mean))
            prior = theta.log_mean
            z = y @ theta.log_mean / np.maximum(y.sum(1), 1)[:, None] + beta.log_mean
            beta.reset()
            beta.add(y.sum(1)[:, None] * _rho(z, n > most), np.outer(r, c @ theta.mean))

    score = lambda: sum(log_likelihood(y, b.mean, theta.mean) for y, b in zip(ys, betas, strict=True))
    return Fit(_iterate(step, score, iterations, eps, score()), betas, theta)


def fit_delta(ref: np.ndarray, ys: list[np.ndarray], k: int, iterations: int = 100, a0: float = 1.0, b0: float = 1.0, log1p: bool = False, seed: int = 1337, normalize: bool = False, eps: float = 1e-8, jitter: float = 1.0) -> Fit:
    """ref ~ beta theta', Y(t) ~ (beta * delta(t)) theta'; all of one shape."""
    if any(y.shape != ref.shape for y in ys):
        raise ValueError("all matrices need the shape of the reference")
    ref, *ys = [_prepare(y, log1p, normalize, eps)[0] for y in (ref, *ys)]
    d, n = ref.shape
    k = min(k, n, d)
    rng = np.random.default_rng(seed)
    beta, theta = Gamma(d, k, a0, b0), Gamma(n, k, a0, b0)
    deltas = [Gamma(d, k, a0, b0) for _ in ys]
    _start(beta, rng, jitter)
    r, c = np.ones(d), np.ones(n)
    by_row, by_col = n > d, d >= n

    def step() -> None:
        prior = theta.log_mean
        theta.reset()
        z = ref.T @ beta.log_mean / np.maximum(ref.sum(0), 1)[:, None] + prior
        theta.add(ref.sum(0)[:, None] * _rho(z, by_col), np.outer(c, r @ beta.mean))
        prior = beta.log_mean
        beta.reset()
        z = ref @ theta.log_mean / np.maximum(ref.sum(1), 1)[:, None] + prior
        beta.add(ref.sum(1)[:, None] * _rho(z, by_row), np.outer(r, c @ theta.mean))
        for y, delta in zip(ys, deltas, strict=True):
            rows, cols = y.sum(1), y.sum(0)
            z = y.T @ (beta.log_mean + delta.log_mean) / np.maximum(cols, 1)[:, None] + theta.log_mean
            theta.add(cols[:, None] * _rho(z, by_col), np.outer(c, r @ (beta.mean * delta.mean)))
            pull = y @ theta.log_mean / np.maximum(rows, 1)[:, None]
            size = c @ theta.mean
            z = pull + delta.log_mean
            delta.reset()
            delta.add(rows[:, None] * _rho(z, by_row, beta.mean) * beta.mean, beta.mean * size)
            z = pull + beta.log_mean
            beta.add(rows[:, None] * _rho(z, by_row, delta.mean) * delta.mean, delta.mean * size)

    score = lambda: log_likelihood(ref, beta.mean, theta.mean) + sum(log_likelihood(y, beta.mean * x.mean, theta.mean) for y, x in zip(ys, deltas, strict=True))
    return Fit(_iterate(step, score, iterations, eps, score()), beta, theta, deltas)


def tree_dependency(depth: int) -> np.ndarray:
    """Nodes x leaves of the complete binary tree: 1 for a leaf's node and all above it."""
    if depth < 2:
        return np.ones((1, 1))
    leaves = 2**depth
    a = np.zeros((2 * leaves - 1, leaves))
    for leaf in range(leaves):
        node = leaves + leaf
        while node:
            a[node - 1, leaf] = 1
            node //= 2
    return a


def fit_larch(y: np.ndarray, depth: int, iterations: int = 100, a0: float = 1.0, b0: float = 1.0, log1p: bool = False, seed: int = 1337, degree: bool = False, normalize: bool = False, eps: float = 1e-8, jitter: float = 1.0) -> Fit:
    """Y ~ beta A theta' for the tree A: beta by node, theta by leaf."""
    y, s = _prepare(y, log1p, normalize, eps)
    d, n = y.shape
    a = tree_dependency(depth)
    nodes, leaves = a.shape
    if nodes > n or leaves > d:
        raise ValueError("the tree has more nodes than columns or more leaves than rows")
    v = a.sum(0)
    beta, theta = Gamma(d, nodes, a0, b0), Gamma(n, leaves, a0, b0)
    _start(beta, np.random.default_rng(seed), jitter)
    r, c = (y.mean(1), y.mean(0)) if degree else (np.ones(d), np.ones(n))
    by_row, by_col = n > d, d >= n
    aux = np.zeros((n, leaves))

    def step() -> None:
        nonlocal aux
        z = y.T @ beta.log_mean @ a / np.maximum(y.sum(0), 1)[:, None] / v + theta.log_mean
        aux = log_softmax(standardize(z), v) if by_col else log_softmax(z)
        theta.reset()
        theta.add(y.sum(0)[:, None] * np.exp(aux) * v, np.outer(c, r @ beta.mean @ a))
        z = y @ theta.log_mean / np.maximum(y.sum(1), 1)[:, None] + beta.log_mean @ a / v
        rho = np.exp(log_softmax(standardize(z)) if by_row else log_softmax(z, v))
        beta.reset()
        beta.add(y.sum(1)[:, None] * (rho @ a.T), np.outer(r, c @ theta.mean @ a.T))

    score = lambda: log_likelihood(y, beta.mean @ a, theta.mean, r, c)
    trace = _iterate(step, score, iterations, eps, score())
    return Fit(trace, beta, theta, tree=a, col_sum=s, log_aux=aux)


# ---- any size: tables (id, a, b) of K-arrays ----


def half_step(coo: DataFrame, own: str, other: str, factor: DataFrame, prior: DataFrame, k: int, stdize: bool, a0: float = 1.0, b0: float = 1.0, n_other: int | None = None) -> DataFrame:
    """New (own, a, b) of one factor given the other (other, a, b) and the current values (own, a, b) in prior.

    coo's keys are row_id and col_id; own and other name them. One join (broadcast only within a counted size, else salted, as a feature may
    hold a large part of all triplets), one pre-aggregated sum of K + 1 numbers, one aggregate of K sums for the rates, and one for the
    standardisation if asked. Every id of prior comes out: without triplets it gets the prior's shape. n_other: the rows of factor, if they were counted.
    """
    log = F.zip_with("a", "b", lambda a, b: digamma_column(a) - F.log(b))
    rate = factor.select(F.zip_with("a", "b", lambda a, b: a / b).alias("m")).agg(v_sums("m", k).alias("rate"))
    logs = factor.select(other, log.alias("__l"))
    if n_other is None:
        joined = lookup_join(coo, logs, [other], "inner")
    else:
        joined = counted_join(coo, logs, [other], n_other, "inner")
    sums = joined.groupBy(own).agg(v_sums("__l", k, F.col("value")).alias("s"), F.sum("value").alias("y"))
    now = prior.select(own, log.alias("g")).join(sums, own, "left")
    y = F.coalesce("y", F.lit(0.0))
    z = v_add(F.transform(F.coalesce("s", F.array_repeat(F.lit(0.0), k)), lambda x: x / F.greatest(y, F.lit(1.0))), F.col("g"))
    now = now.select(own, y.alias("y"), z.alias("v"))
    if stdize:
        now = standardize_columns(materialize(now, "logits")[0], k)
    rho = F.transform(v_log_softmax(F.col("v")), lambda x: F.exp(x))
    out = now.withColumn("rho", rho).crossJoin(F.broadcast(rate))  # rate is one row
    return out.select(own, F.transform("rho", lambda p: F.lit(float(a0)) + F.col("y") * p).alias("a"), F.transform("rate", lambda x: F.lit(float(b0)) + x).alias("b"))


def likelihood(coo: DataFrame, beta: DataFrame, theta: DataFrame, k: int, n_rows: int, n_cols: int) -> DataFrame:
    """One row with llik: (sum y log max(lambda, 1e-8) - sum lambda) / cells, from the triplets and the factors' sums."""
    mean = F.zip_with("a", "b", lambda a, b: a / b)
    b = beta.select("row_id", mean.alias("__b"))
    t = theta.select("col_id", mean.alias("__t"))
    joined = lookup_join(coo, b, ["row_id"], "inner").join(t, "col_id")
    rate = F.aggregate(F.zip_with("__b", "__t", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    fit_ = joined.agg(F.coalesce(F.sum(F.col("value") * F.log(F.greatest(rate, F.lit(1e-8)))), F.lit(0.0)).alias("f"))
    sb, st = b.agg(v_sums("__b", k).alias("sb")), t.agg(v_sums("__t", k).alias("st"))
    whole = F.aggregate(F.zip_with("sb", "st", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    return fit_.crossJoin(sb).crossJoin(st).select(((F.col("f") - whole) / F.lit(float(n_rows) * n_cols)).alias("llik"))  # one row each


def _drawn(ids: DataFrame, key: str, k: int, a0: float, b0: float, seed: int, jitter: float) -> DataFrame:
    """A first factor drawn from hashes of the ids: Gamma(1, 1) by its inverse."""
    draw = lambda i: F.lit(a0) - F.log(uniform_of([F.col(key), F.lit(i)], seed)) * F.lit(jitter)
    return ids.select(key).distinct().select(key, F.array(*[draw(i) for i in range(k)]).alias("a"), F.array_repeat(F.lit(b0 + 1.0), k).alias("b"))


def _flat(ids: DataFrame, key: str, k: int, a0: float, b0: float) -> DataFrame:
    """A factor that is its prior."""
    return ids.select(key).distinct().select(key, F.array_repeat(F.lit(float(a0)), k).alias("a"), F.array_repeat(F.lit(float(b0)), k).alias("b"))


def _log(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: digamma_column(x) - F.log(y))


def _mean(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x / y)


def _pulled(coo: DataFrame, own: str, other: str, logs: DataFrame, prior: DataFrame, k: int, n_other: int) -> DataFrame:
    """prior with y (the sum of its triplets) and s (of their products with the logarithms __l of `other`, by max(y, 1)); zeros without triplets."""
    joined = counted_join(coo, logs, [other], n_other, "inner")
    sums = joined.groupBy(own).agg(v_sums("__l", k, F.col("value")).alias("__s"), F.sum("value").alias("__y"))
    y = F.coalesce("__y", F.lit(0.0))
    s_ = F.transform(F.coalesce("__s", F.array_repeat(F.lit(0.0), k)), lambda x: x / F.greatest(y, F.lit(1.0)))
    return prior.join(sums, own, "left").withColumns({"y": y, "s": s_}).drop("__s", "__y")


class _Held:
    """Factors written to the shared folder; the one before is deleted."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.at: dict[object, tuple[DataFrame, str]] = {}

    def put(self, name: object, make: Callable[[], DataFrame]) -> DataFrame:
        """What make() defines; other tables that it writes are deleted, too."""
        with scratch(self.spark) as keep:
            new = materialize(make(), "factor")
            keep(new)
        if name in self.at:
            release(self.spark, self.at[name][1])
        self.at[name] = new
        return new[0]

    def __getitem__(self, name: object) -> DataFrame:
        return self.at[name][0]


def _rounds(step, score, iterations: int, every: int, eps: float) -> list[float]:
    """The likelihood every few rounds and at the end; until it changes by less than eps, relatively."""
    trace: list[float] = []
    for t in range(iterations):
        step()
        if (t + 1) % every == 0 or t + 1 == iterations:
            trace.append(score())
            if len(trace) > 1 and abs(trace[-1] - trace[-2]) / abs(trace[-1] + eps) < eps:
                break
    return trace


def fit_cbind_distributed(coos: dict[str, DataFrame], rows: DataFrame, cols: dict[str, DataFrame], k: int, iterations: int = 10, a0: float = 1.0, b0: float = 1.0, seed: int = 1337, jitter: float = 1.0, every: int = 5, eps: float = 1e-8, start: tuple[DataFrame, dict[str, DataFrame]] | None = None) -> tuple[DataFrame, dict[str, DataFrame], list[float]]:
    """fit_cbind over triplets of any number: (beta (row_id, a, b), theta (col_id, a, b) by matrix, likelihoods).

    rows (row_id): all rows; cols: all columns (col_id) of each matrix. Each round is two half-steps a matrix; what the matrices add to beta is summed in one aggregate.
    """
    d, n = rows.distinct().count(), {t: c.distinct().count() for t, c in cols.items()}
    most, held = max(n.values()), _Held(rows.sparkSession)
    held.put("beta", lambda: start[0] if start else _drawn(rows, "row_id", k, a0, b0, seed, jitter))
    for i, t in enumerate(coos):
        held.put(t, lambda i=i, t=t: start[1][t] if start else _drawn(cols[t], "col_id", k, a0, b0, seed + 1 + i, jitter))

    def step() -> None:
        beta = held["beta"]
        for t, coo in coos.items():
            held.put(t, lambda coo=coo, t=t: half_step(coo, "col_id", "row_id", beta, held[t], k, d >= most, a0, b0, d))

        def total() -> DataFrame:
            parts = [half_step(coo, "row_id", "col_id", held[t], beta, k, most > d, a0, b0, n[t]) for t, coo in coos.items()]
            more = float(len(parts) - 1)
            added = reduce(DataFrame.unionByName, parts).groupBy("row_id").agg(v_sums("a", k).alias("a"), v_sums("b", k).alias("b"))
            return added.select("row_id", F.transform("a", lambda x: x - more * a0).alias("a"), F.transform("b", lambda x: x - more * b0).alias("b"))

        held.put("beta", total)

    score = lambda: sum(likelihood(coo, held["beta"], held[t], k, d, n[t]).first()[0] for t, coo in coos.items())
    trace = _rounds(step, score, iterations, every, eps)
    return held["beta"], {t: held[t] for t in coos}, trace


def fit_rbind_distributed(coos: dict[str, DataFrame], rows: dict[str, DataFrame], cols: DataFrame, k: int, iterations: int = 10, a0: float = 1.0, b0: float = 1.0, seed: int = 1337, jitter: float = 1.0, every: int = 5, eps: float = 1e-8, start: tuple[dict[str, DataFrame], DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame, list[float]]:
    """fit_rbind over triplets of any number: (beta (row_id, a, b) by matrix, theta (col_id, a, b), likelihoods).

    rows: all rows (row_id) of each matrix; cols (col_id): all columns. theta starts anew in each round and adds up over the matrices, one after the other.
    """
    d, n = {t: r.distinct().count() for t, r in rows.items()}, cols.distinct().count()
    most, held = max(d.values()), _Held(cols.sparkSession)
    held.put("theta", lambda: start[1] if start else _flat(cols, "col_id", k, a0, b0))
    for i, t in enumerate(coos):
        held.put(t, lambda i=i, t=t: start[0][t] if start else _drawn(rows[t], "row_id", k, a0, b0, seed + i, jitter))

    def step() -> None:
        for i, (t, coo) in enumerate(coos.items()):

            def more(i=i, t=t, coo=coo) -> DataFrame:
                new = half_step(coo, "col_id", "row_id", held[t], held["theta"], k, most >= n, a0, b0, d[t])
                if not i:
                    return new
                before = held["theta"].select("col_id", F.col("a").alias("__a"), F.col("b").alias("__b"))
                add = lambda x, y, z: F.zip_with(x, y, lambda u, w: u + w - z)
                return new.join(before, "col_id").select("col_id", add("a", "__a", a0).alias("a"), add("b", "__b", b0).alias("b"))

            theta = held.put("theta", more)
            held.put(t, lambda t=t, coo=coo, theta=theta: half_step(coo, "row_id", "col_id", theta, held[t], k, n > most, a0, b0, n))

    score = lambda: sum(likelihood(coo, held[t], held["theta"], k, d[t], n).first()[0] for t, coo in coos.items())
    trace = _rounds(step, score, iterations, every, eps)
    return {t: held[t] for t in coos}, held["theta"], trace


def fit_delta_distributed(ref: DataFrame, coos: dict[str, DataFrame], rows: DataFrame, cols: DataFrame, k: int, iterations: int = 10, a0: float = 1.0, b0: float = 1.0, seed: int = 1337, jitter: float = 1.0, every: int = 5, eps: float = 1e-8, start: tuple[DataFrame, DataFrame, dict[str, DataFrame]] | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], list[float]]:
    """fit_delta over triplets of any number: (beta (row_id, a, b), theta (col_id, a, b), delta (row_id, a, b) by matrix, likelihoods)."""
    d, n, held = rows.distinct().count(), cols.distinct().count(), _Held(ref.sparkSession)
    by_row, by_col = n > d, d >= n
    held.put("beta", lambda: start[0] if start else _drawn(rows, "row_id", k, a0, b0, seed, jitter))
    held.put("theta", lambda: start[1] if start else _flat(cols, "col_id", k, a0, b0))
    for t in coos:
        held.put(t, lambda t=t: start[2][t] if start else _flat(rows, "row_id", k, a0, b0))
    exp = lambda v: F.transform(v, lambda x: F.exp(x))

    def both(t: str) -> DataFrame:
        return held["beta"].select("row_id", _log("a", "b").alias("bl"), _mean("a", "b").alias("bm"), "a", "b").join(held[t].select("row_id", _log("a", "b").alias("dl"), _mean("a", "b").alias("dm")), "row_id")

    def more_theta(t: str, coo: DataFrame) -> DataFrame:
        x = both(t)
        rate = x.select(v_mul(F.col("bm"), F.col("dm")).alias("m")).agg(v_sums("m", k).alias("rate"))
        now = _pulled(coo, "col_id", "row_id", x.select("row_id", v_add(F.col("bl"), F.col("dl")).alias("__l")), held["theta"], k, d)
        now = now.select("col_id", "a", "b", "y", v_add(F.col("s"), _log("a", "b")).alias("v"))
        now = standardize_columns(materialize(now, "logits")[0], k) if by_col else now
        rho = exp(v_log_softmax(F.col("v")))
        return now.withColumn("rho", rho).crossJoin(F.broadcast(rate)).select("col_id", F.zip_with("a", "rho", lambda a, p: a + F.col("y") * p).alias("a"), v_add(F.col("b"), F.col("rate")).alias("b"))

    def rows_of(t: str, coo: DataFrame) -> DataFrame:
        """(row_id, a, b, da, db): beta with what the matrix adds, and its new delta."""
        theta = held["theta"]
        size = theta.select(_mean("a", "b").alias("m")).agg(v_sums("m", k).alias("size"))
        now = _pulled(coo, "row_id", "col_id", theta.select("col_id", _log("a", "b").alias("__l")), both(t), k, n)
        now = now.select("row_id", "a", "b", "bm", "y", v_add(F.col("s"), F.col("dl")).alias("z1"), v_add(F.col("s"), F.col("bl")).alias("z2"))
        if by_row:
            now = materialize(now, "logits")[0]
            now = standardize_columns(standardize_columns(now, k, "z1"), k, "z2")
        now = now.crossJoin(F.broadcast(size)).withColumn("r1", exp(v_log_softmax_weighted(F.col("z1"), F.col("bm"))))
        scaled = lambda r, m: F.zip_with(r, m, lambda p, x: F.col("y") * p * x)
        now = now.withColumns({"da": F.transform(scaled("r1", "bm"), lambda x: F.lit(float(a0)) + x), "db": F.transform(v_mul(F.col("bm"), F.col("size")), lambda x: F.lit(float(b0)) + x)})
        now = now.withColumn("dm", _mean("da", "db")).withColumn("r2", exp(v_log_softmax_weighted(F.col("z2"), F.col("dm"))))
        return now.select("row_id", v_add(F.col("a"), scaled("r2", "dm")).alias("a"), v_add(F.col("b"), v_mul(F.col("dm"), F.col("size"))).alias("b"), "da", "db")

    def step() -> None:
        held.put("theta", lambda: half_step(ref, "col_id", "row_id", held["beta"], held["theta"], k, by_col, a0, b0, d))
        held.put("beta", lambda: half_step(ref, "row_id", "col_id", held["theta"], held["beta"], k, by_row, a0, b0, n))
        for t, coo in coos.items():
            held.put("theta", lambda t=t, coo=coo: more_theta(t, coo))
            held.put("rows", lambda t=t, coo=coo: rows_of(t, coo))
            held.put(t, lambda: held["rows"].select("row_id", F.col("da").alias("a"), F.col("db").alias("b")))
            held.put("beta", lambda: held["rows"].select("row_id", "a", "b"))

    def score() -> float:
        out = likelihood(ref, held["beta"], held["theta"], k, d, n).first()[0]
        for t, coo in coos.items():
            x = both(t).select("row_id", v_mul(F.col("bm"), F.col("dm")).alias("a"), F.array_repeat(F.lit(1.0), k).alias("b"))
            out += likelihood(coo, x, held["theta"], k, d, n).first()[0]
        return out

    trace = _rounds(step, score, iterations, every, eps)
    return held["beta"], held["theta"], {t: held[t] for t in coos}, trace


def fit_larch_distributed(coo: DataFrame, rows: DataFrame, cols: DataFrame, depth: int, iterations: int = 10, a0: float = 1.0, b0: float = 1.0, seed: int = 1337, jitter: float = 1.0, every: int = 5, eps: float = 1e-8, start: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """fit_larch over triplets of any number: (beta (row_id, a, b) by node, theta (col_id, a, b) by leaf, likelihoods)."""
    d, n, held = rows.distinct().count(), cols.distinct().count(), _Held(coo.sparkSession)
    tree = tree_dependency(depth)
    nodes, leaves = tree.shape
    up = tree.sum(0)
    by_row, by_col = n > d, d >= n
    held.put("beta", lambda: start[0] if start else _drawn(rows, "row_id", nodes, a0, b0, seed, jitter))
    held.put("theta", lambda: start[1] if start else _flat(cols, "col_id", leaves, a0, b0))
    at_leaves = lambda c: F.array(*[sum((F.get(c, F.lit(i)) for i in range(nodes) if tree[i, j]), F.lit(0.0)) for j in range(leaves)])
    at_nodes = lambda c: F.array(*[sum((F.get(c, F.lit(j)) for j in range(leaves) if tree[i, j]), F.lit(0.0)) for i in range(nodes)])
    v = F.array(*[F.lit(float(x)) for x in up])
    over = lambda x: F.zip_with(x, v, lambda a, b: a / b)
    exp = lambda x: F.transform(x, lambda y: F.exp(y))

    def columns() -> DataFrame:
        beta = held["beta"].select("row_id", _log("a", "b").alias("l"), _mean("a", "b").alias("m"))
        rate = beta.select(at_leaves("m").alias("m")).agg(v_sums("m", leaves).alias("rate"))
        now = _pulled(coo, "col_id", "row_id", beta.select("row_id", at_leaves("l").alias("__l")), held["theta"], leaves, d)
        now = now.select("col_id", "y", v_add(over(F.col("s")), _log("a", "b")).alias("v"))
        now = standardize_columns(materialize(now, "logits")[0], leaves) if by_col else now
        rho = exp(v_log_softmax_weighted(F.col("v"), v) if by_col else v_log_softmax(F.col("v")))
        now = now.withColumn("rho", v_mul(rho, v)).crossJoin(F.broadcast(rate))
        return now.select("col_id", F.transform("rho", lambda p: F.lit(float(a0)) + F.col("y") * p).alias("a"), F.transform("rate", lambda x: F.lit(float(b0)) + x).alias("b"))

    def features() -> DataFrame:
        theta = held["theta"].select("col_id", _log("a", "b").alias("__l"), _mean("a", "b").alias("m"))
        rate = theta.agg(v_sums("m", leaves).alias("m")).select(at_nodes("m").alias("rate"))
        prior = held["beta"].select("row_id", _log("a", "b").alias("l"))
        now = _pulled(coo, "row_id", "col_id", theta.select("col_id", "__l"), prior, leaves, n)
        now = now.select("row_id", "y", v_add(F.col("s"), over(at_leaves("l"))).alias("v"))
        now = standardize_columns(materialize(now, "logits")[0], leaves) if by_row else now
        now = now.withColumn("p", exp(v_log_softmax(F.col("v")) if by_row else v_log_softmax_weighted(F.col("v"), v))).withColumn("rho", at_nodes("p")).crossJoin(F.broadcast(rate))
        return now.select("row_id", F.transform("rho", lambda p: F.lit(float(a0)) + F.col("y") * p).alias("a"), F.transform("rate", lambda x: F.lit(float(b0)) + x).alias("b"))

    def step() -> None:
        held.put("theta", columns)
        held.put("beta", features)

    def score() -> float:
        leaf = held["beta"].select("row_id", at_leaves(_mean("a", "b")).alias("a"), F.array_repeat(F.lit(1.0), leaves).alias("b"))
        return likelihood(coo, leaf, held["theta"], leaves, d, n).first()[0]

    trace = _rounds(step, score, iterations, every, eps)
    return held["beta"], held["theta"], trace


def fit_distributed(coo: DataFrame, rows: DataFrame, cols: DataFrame, k: int, iterations: int = 10, a0: float = 1.0, b0: float = 1.0, seed: int = 1337, jitter: float = 1.0, every: int = 5, eps: float = 1e-8) -> tuple[DataFrame, DataFrame, list[float]]:
    """(beta (row_id, a, b), theta (col_id, a, b), likelihoods): coordinate updates over triplets of any number. rows (row_id), cols (col_id): all ids.

    The first beta is drawn from hashes of the row ids. Each half-step is written to the shared folder, the one before is
    deleted. The likelihood is computed every `every` rounds and at the end; the loop ends when it changes by less than eps, relatively.
    """
    n_rows, n_cols, held = rows.distinct().count(), cols.distinct().count(), _Held(coo.sparkSession)
    held.put("beta", lambda: _drawn(rows, "row_id", k, a0, b0, seed, jitter))
    held.put("theta", lambda: _flat(cols, "col_id", k, a0, b0))

    def step() -> None:
        held.put("theta", lambda: half_step(coo, "col_id", "row_id", held["beta"], held["theta"], k, n_rows >= n_cols, a0, b0, n_rows))
        held.put("beta", lambda: half_step(coo, "row_id", "col_id", held["theta"], held["beta"], k, n_cols > n_rows, a0, b0, n_cols))

    score = lambda: likelihood(coo, held["beta"], held["theta"], k, n_rows, n_cols).first()[0]
    trace = _rounds(step, score, iterations, every, eps)
    return held["beta"], held["theta"], trace
