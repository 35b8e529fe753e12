"""Bayesian clustering of rows by counts: a collapsed Gibbs sampler. One chain is sequential; chains and matrices run in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trigrid.functions.numeric import digamma, lgamma
from trigrid.runtime import fits

#: Rows of a chain at most.
CHAIN_ROWS = 200_000


class Component:
    """A Gamma-Poisson component: counts summed over its rows, by dimension."""

    def __init__(self, dim: int, a0: float, b0: float) -> None:
        self.sum, self.n, self.a0, self.b0 = np.zeros(dim), 0, a0, b0

    def add(self, x: np.ndarray) -> None:
        self.sum += x
        self.n += 1

    def remove(self, x: np.ndarray) -> None:
        self.sum -= x
        self.n -= 1

    def log_predictive(self, x: np.ndarray) -> float:
        old = self.sum + self.a0
        return float((lgamma(x + old) - lgamma(old) - (x + old) * np.log(self.b0 + self.n + 1) + old * np.log(self.n + self.b0)).sum())

    def mean(self) -> np.ndarray:
        return (self.sum + self.a0) / (self.n + self.b0)

    def log_mean(self) -> np.ndarray:
        return digamma(self.sum + self.a0) - np.log(self.n + self.b0)


def stick_weights(sizes: np.ndarray, alpha: float) -> np.ndarray:
    """Expected logarithms of the weights of a truncated Dirichlet process with the given component sizes."""
    after = np.concatenate([np.cumsum(sizes[::-1])[::-1][1:], [0]])
    a, b = 1 + sizes, alpha + after
    log_v, log_rest = digamma(a) - digamma(a + b), digamma(b) - digamma(a + b)
    log_v[-1] = 0.0
    return log_v + np.concatenate([[0.0], np.cumsum(log_rest[:-1])])


def gibbs(x: np.ndarray, k: int, alpha: float = 1.0, a0: float = 1e-2, b0: float = 1e-4, seed: int = 42, mcmc: int = 100, burnin: int = 10, use_prior: bool = False) -> dict[str, np.ndarray]:
    """elbo, latent (rows x k: shares of the recorded samples), parameter and log_parameter (dimensions x k, means over samples)."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    sums, sizes = np.zeros((k, d)), np.zeros(k)
    member = np.zeros(n, np.int64)

    def scores(row: np.ndarray) -> np.ndarray:
        old = sums + a0
        p = (lgamma(row + old) - lgamma(old) - (row + old) * np.log(b0 + sizes + 1)[:, None] + old * np.log(sizes + b0)[:, None]).sum(1)
        return p + stick_weights(sizes, alpha) if use_prior else p

    def draw(p: np.ndarray) -> int:
        return int((p - np.log(-np.log(rng.random(k)))).argmax())

    def place(i: int, c: int, sign: int) -> None:
        sums[c] += sign * x[i]
        sizes[c] += sign

    for j, i in enumerate(rng.permutation(n)):
        member[i] = draw(scores(x[i]) if j > 3 * k else np.zeros(k))
        place(i, member[i], 1)
    elbo, latent, mean, log_mean, kept = [], np.zeros((n, k)), np.zeros((d, k)), np.zeros((d, k)), 0
    for t in range(mcmc + burnin):
        total = 0.0
        for i in rng.permutation(n):
            place(i, member[i], -1)
            p = scores(x[i])
            member[i] = draw(p)
            place(i, member[i], 1)
            total += p[member[i]]
        elbo.append(total)
        if t >= burnin:
            latent[np.arange(n), member] += 1
            mean += ((sums + a0) / (sizes + b0)[:, None]).T
            log_mean += (digamma(sums + a0) - np.log(sizes + b0)[:, None]).T
            kept += 1
    kept = max(kept, 1)
    return {"elbo": np.array(elbo), "latent": latent / kept, "parameter": mean / kept, "log_parameter": log_mean / kept}


def cluster_rows(rows: DataFrame, k: int, chains: int = 1, seed: int = 42, chain: str = "chain", **options) -> DataFrame:
    """(chain, id, cluster, share): the most frequent cluster (from 1) of every row (id, v) and its share, one chain for each seed.

    A chain is sequential by nature and one task, so rows are a summary (pseudo-bulk) of bounded size: more than CHAIN_ROWS are refused.
    """
    if not fits(rows, CHAIN_ROWS):
        raise ValueError(f"more than {CHAIN_ROWS} rows for a chain: cluster a pseudo-bulk of them")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        out = gibbs(np.stack(pdf["v"].to_list()), k, seed=seed + key[0], **options)
        p = out["latent"]
        return pd.DataFrame({chain: key[0], "id": pdf["id"].to_numpy(), "cluster": p.argmax(1) + 1, "share": p.max(1)})

    every = rows.select("id", "v").withColumn(chain, F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    return every.groupBy(chain).applyInPandas(run, f"{chain} int, id long, cluster long, share double")


def by_size(labels: DataFrame, label: str = "cluster") -> DataFrame:
    """(label, size, rank): clusters numbered 1.. from the largest, ties by label."""
    n = labels.groupBy(label).agg(F.count("*").alias("size"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), label)))  # one row for each cluster


def text_histogram(labels: DataFrame, label: str = "cluster", width: int = 50) -> list[str]:
    """A line for each cluster, from the largest."""
    rows = by_size(labels, label).orderBy("rank").collect()
    most = max((r["size"] for r in rows), default=1)
    return [f"{r[label]!s:>12} {'*' * max(1, round(width * r['size'] / most))} {r['size']}" for r in rows]


def categorical(probs: DataFrame, k: int, seed: int = 42, logits: bool = False) -> DataFrame:
    """(id, draw): one draw (from 1) for each row of probabilities or logits (id, v), by the largest of logits + Gumbel noise from hashes of the id."""
    from trigrid.operators.linalg import uniform_of

    noise = [-F.log(-F.log(uniform_of([F.col("id"), F.lit(i)], seed))) for i in range(k)]
    value = lambda i: F.get("v", F.lit(i)) if logits else F.log(F.get("v", F.lit(i)))
    z = F.array(*[value(i) + noise[i] for i in range(k)])
    return probs.select("id", z.alias("z")).select("id", F.array_position("z", F.array_max("z")).alias("draw"))
