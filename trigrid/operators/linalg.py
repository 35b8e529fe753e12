"""Random projections, singular vectors through a Gram matrix, residuals. Tables of K-vectors are (id, v)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrid.operators.normalize import moments
from trigrid.runtime import lookup_join


def uniform_of(keys: list[Column], seed: int) -> Column:
    """A number in (0, 1) from a hash of the keys: the same whatever the partitioning."""
    h = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def normal_of(keys: list[Column], seed: int) -> Column:
    """A standard normal number from hashes of the keys (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.log(uniform_of([*keys, F.lit(1)], seed))) * F.cos(F.lit(2 * math.pi) * uniform_of([*keys, F.lit(2)], seed))


def integer_sign(row: Column, k: int) -> Column:
    """-1 or 1 by integer arithmetic, for checks in any engine."""
    return F.when(F.pmod(row * F.lit(2654435761) + F.lit(40503 * (k + 1)), F.lit(65537)) % 2 == 0, 1.0).otherwise(-1.0)


def projection(rows: DataFrame, k: int, seed: int = 42, mode: str = "normal") -> DataFrame:
    """(row_id, v): K numbers for each row. mode normal, or rademacher (signs by integer arithmetic)."""
    make = (lambda i: normal_of([F.col("row_id"), F.lit(i)], seed)) if mode == "normal" else (lambda i: integer_sign(F.col("row_id"), i))
    return rows.select("row_id").distinct().select("row_id", F.array(*[make(i) for i in range(k)]).alias("v"))


def project(coo: DataFrame, k: int, seed: int = 42, mode: str = "normal", weights: DataFrame | None = None) -> DataFrame:
    """(id, v): R y for every column. The numbers of R are computed beside each triplet, so nothing is joined but the optional weights (row_id, factor)."""
    if weights is not None:
        coo = lookup_join(coo, weights.select("row_id", "factor"), ["row_id"], "inner").withColumn("value", F.col("value") * F.col("factor"))
    make = (lambda i: normal_of([F.col("row_id"), F.lit(i)], seed)) if mode == "normal" else (lambda i: integer_sign(F.col("row_id"), i))
    return coo.groupBy(F.col("col_id").alias("id")).agg(F.array(*[F.sum(F.col("value") * make(i)) for i in range(k)]).alias("v"))


def gram(vecs: DataFrame, k: int) -> np.ndarray:
    """V'V: one aggregate of k (k + 1) / 2 sums."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = vecs.agg(*[F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((k, k))
    for i, j in pairs:
        g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    return g


def times(vecs: DataFrame, m: np.ndarray) -> DataFrame:
    """(id, v M) for a small k x p matrix M."""
    k, p = m.shape
    return vecs.withColumn("v", F.array(*[sum((F.get("v", F.lit(i)) * F.lit(float(m[i, j])) for i in range(k)), F.lit(0.0)) for j in range(p)]))


def _spectrum(g: np.ndarray, rank: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors) from a Gram matrix.

    Directions with an eigenvalue below 1e-12 of the largest are dropped: they are arbitrary. Signs: the largest entry of a right vector is positive.
    """
    w, u = np.linalg.eigh(g)
    order = np.argsort(-w)
    w, u = w[order], u[:, order]
    keep = w > max(w[0], 0) * 1e-12 if len(w) else w > 0
    w, u = w[keep][:rank], u[:, keep][:, :rank]
    return np.sqrt(w), u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])


def right_vectors(g: np.ndarray) -> np.ndarray:
    """The matrix M for which v M are the left singular vectors of rows v with the Gram matrix g."""
    s, u = _spectrum(g)
    return u / s


def singular(vecs: DataFrame, k: int, rank: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(left vectors (id, v), singular values, right vectors): exact, by the eigenvectors of the k x k Gram matrix on the driver."""
    s, u = _spectrum(gram(vecs, k), rank)
    return times(vecs, u / s), s, u


def residual(y: DataFrame, x: DataFrame, ky: int, kx: int, eps: float = 1e-8) -> DataFrame:
    """Columns of y (id, v) less their projection on the standardised columns of x (id, v). Only k x k sums reach the driver.

    One column of x: the slope has eps in its denominator. More: the projection on their span (directions that are nothing are left out). Ids without x are dropped.
    """
    if kx < 1:
        return y
    mu, sd = moments(x, kx)
    z = F.array(*[(F.get("__x", F.lit(i)) - F.lit(mu[i])) / F.lit(sd[i] + 1e-8) for i in range(kx)])
    both = y.join(x.select("id", F.col("v").alias("__x")), "id").withColumn("__x", z)
    pairs = [F.sum(F.get("__x", F.lit(i)) * F.get("__x", F.lit(j))).alias(f"a{i}_{j}") for i in range(kx) for j in range(kx)]
    pairs += [F.sum(F.get("__x", F.lit(i)) * F.get("v", F.lit(j))).alias(f"b{i}_{j}") for i in range(kx) for j in range(ky)]
    r = both.agg(*pairs).first()
    a = np.array([[r[f"a{i}_{j}"] or 0.0 for j in range(kx)] for i in range(kx)])
    b = np.array([[r[f"b{i}_{j}"] or 0.0 for j in range(ky)] for i in range(kx)])
    c = b / (a[0, 0] + eps) if kx == 1 else np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b
    fit = [sum((F.get("__x", F.lit(i)) * F.lit(float(c[i, j])) for i in range(kx)), F.lit(0.0)) for j in range(ky)]
    return both.withColumn("v", F.array(*[F.get("v", F.lit(j)) - fit[j] for j in range(ky)])).drop("__x")
