"""Simulated count matrices. All draws come from seeds mixed with ids, so results don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrid.matrixset import MatrixSet
from trigrid.operators.linalg import uniform_of
from trigrid.operators.select import filter_columns_by_nnz

SCHEMA = "row_id long, col_id long, value double"


def poisson_columns(cells: DataFrame, mu: np.ndarray, seed: int) -> DataFrame:
    """(row_id, col_id, value > 0) for cells (id, profile, rho): y ~ Poisson(rho * mu[:, profile]). mu (rows x profiles) goes to all tasks.

    Non-finite depths and rates count as 0. A column without counts gives no row.
    """
    rates = np.nan_to_num(np.asarray(mu, float), nan=0.0, posinf=0.0, neginf=0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for i, p, rho in zip(pdf["id"], pdf["profile"], pdf["rho"], strict=True):
                depth = rho if np.isfinite(rho) else 0.0
                y = np.random.default_rng([seed, int(i)]).poisson(np.maximum(rates[:, int(p)] * depth, 0))
                at = np.flatnonzero(y)
                parts.append(pd.DataFrame({"row_id": at + 1, "col_id": int(i), "value": y[at].astype(float)}))
            yield pd.concat(parts) if parts else pd.DataFrame({"row_id": [], "col_id": [], "value": []})

    return cells.select("id", "profile", "rho").mapInPandas(run, SCHEMA)


def _pick(keys: list, n: int, seed: int):
    return F.floor(uniform_of(keys, seed) * n).cast("long")


def _finish(spark: SparkSession, coo: DataFrame, n_rows: int, cells: DataFrame) -> tuple[MatrixSet, DataFrame]:
    rows = spark.range(1, n_rows + 1).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("name"))
    cols = cells.select(F.col("id").alias("col_id"), F.col("id").cast("string").alias("name"), (F.col("indv") + 1).alias("indv"))
    m = filter_columns_by_nnz(MatrixSet(coo, rows, cols), 1)
    return MatrixSet(m.coo, m.rows, m.cols.select("col_id", "name", F.lit(None).cast("string").alias("batch"))), m.cols.select("col_id", "indv")


def simulate_poisson(spark: SparkSession, mu: np.ndarray, rho: np.ndarray, individuals: list[int] | None = None, seed: int = 42) -> tuple[MatrixSet, DataFrame]:
    """(matrix, (col_id, indv)): as many columns as rho has depths; each belongs to an individual (a column of mu, from 1; drawn if not given), its depth is drawn again from rho. Empty columns are dropped."""
    n = len(rho)
    cells = spark.range(1, n + 1).withColumn("indv", _pick([F.col("id"), F.lit("i")], mu.shape[1], seed))
    if individuals is not None:
        cells = spark.createDataFrame([(i + 1, int(g) - 1) for i, g in enumerate(individuals)], "id long, indv long")
    depths = F.array(*[F.lit(float(r)) for r in rho]) if n <= 1000 else None
    at = _pick([F.col("id"), F.lit("r")], n, seed)
    if depths is not None:
        cells = cells.withColumn("rho", F.get(depths, at.cast("int")))
    else:
        table = spark.createDataFrame(pd.DataFrame({"at": np.arange(n), "rho": np.asarray(rho, float)}))
        cells = cells.withColumn("at", at).join(table, "at").drop("at")
    coo = poisson_columns(cells.withColumn("profile", F.col("indv")), mu, seed)
    return _finish(spark, coo, mu.shape[0], cells)


def simulate_poisson_mixture(spark: SparkSession, mus: list[np.ndarray], n_cells: int, dir_alpha: float = 1.0, gam_alpha: float = 2.0, gam_beta: float = 2.0, seed: int = 42) -> tuple[MatrixSet, DataFrame]:
    """(matrix, (col_id, indv)): each individual mixes the profiles mus[k] (rows x individuals) in Dirichlet shares; depths are Gamma(gam_alpha, scale gam_beta)."""
    d, n_ind = mus[0].shape
    if any(m.shape != (d, n_ind) for m in mus):
        raise ValueError("all mu need the same shape")
    shares = np.random.default_rng([seed, 1]).gamma(dir_alpha, 1.0, (n_ind, len(mus)))
    edges = np.cumsum(shares / shares.sum(1, keepdims=True), 1)
    cells = spark.range(1, n_cells + 1).withColumn("indv", _pick([F.col("id"), F.lit("i")], n_ind, seed))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rngs = [np.random.default_rng([seed, 2, int(i)]) for i in pdf["id"]]
            u = np.array([r.random() for r in rngs])
            k = (edges[pdf["indv"].to_numpy(np.int64)] < u[:, None]).sum(1)
            rho = np.array([r.gamma(gam_alpha, gam_beta) for r in rngs])
            yield pdf.assign(profile=np.minimum(k, len(mus) - 1) * n_ind + pdf["indv"].to_numpy(np.int64), rho=rho)

    drawn = cells.mapInPandas(pick, "id long, indv long, profile long, rho double")
    return _finish(spark, poisson_columns(drawn, np.concatenate(mus, 1), seed), d, cells)
