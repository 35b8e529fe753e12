"""Recalibration of every column against a fixed dictionary. Dictionaries are (row_id, v), statistics (id, v, ysum)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrid.functions.special import digamma
from trigrid.functions.vectors import v_add, v_log_softmax, v_sums
from trigrid.matrixset import MatrixSet
from trigrid.operators.linalg import residual
from trigrid.operators.normalize import l2_columns, moments, standardize, stretch
from trigrid.operators.select import delta_rows
from trigrid.runtime import lookup_join, materialize, numbered, release


def pmf_stat(coo: DataFrame, log_x: DataFrame, k: int, stretch_x: bool = True, log1p: bool = False, cell_norm: float = 0.0, softmax: bool = True, columns: DataFrame | None = None) -> DataFrame:
    """(id, v, ysum): v = log-softmax of y'X / max(sum y, 1) for every column, over the rows the dictionary has.

    The dictionary is stretched first if asked. It is one row per feature and broadcast only within a counted size; else the
    join is salted, as one feature may hold a large part of all triplets. K + 1 sums in one aggregate, pre-aggregated. Columns
    without a triplet in the dictionary's rows come out only if `columns` (col_id) is given: then with a zero sum.
    """
    x = stretch(log_x.select(F.col("row_id"), "v"), k) if stretch_x else log_x.select("row_id", "v")
    if cell_norm >= 1:
        coo = l2_columns(coo, cell_norm)
    y = F.log1p("value") if log1p else F.col("value")
    joined = lookup_join(coo, x.withColumnRenamed("v", "__x"), ["row_id"], "inner").withColumn("value", y)
    sums = joined.groupBy(F.col("col_id").alias("id")).agg(v_sums("__x", k, F.col("value")).alias("v"), F.sum("value").alias("ysum"))
    if columns is not None:
        sums = columns.select(F.col("col_id").alias("id")).distinct().join(sums, "id", "left").select("id", F.coalesce("v", F.array_repeat(F.lit(0.0), k)).alias("v"), F.coalesce("ysum", F.lit(0.0)).alias("ysum"))
    r = sums.withColumn("v", F.transform("v", lambda s: s / F.greatest("ysum", F.lit(1.0))))
    return r.withColumn("v", v_log_softmax(F.col("v"))) if softmax else r


def dictionary_sums(log_beta: DataFrame, k: int) -> tuple[list[float], int]:
    """Column sums of exp(log_beta), and the number of rows."""
    r = log_beta.select(F.transform("v", lambda x: F.exp(x)).alias("v")).agg(v_sums("v", k).alias("s"), F.count("*").alias("n")).first()
    return [x or 0.0 for x in r["s"]], r["n"]


def _theta(stat: DataFrame, sums: list[float], degree: float | None, k: int, a0: float, b0: float, iterations: int, each: str | None) -> DataFrame:
    """The loop: log rho = r + E[log theta], stretched if each == "stretch"; theta ~ Gamma(a0 + ysum rho, b0 + x)."""
    x = F.array(*[F.lit(s) for s in sums])
    x = F.transform(x, lambda s: s * F.col("ysum") / F.lit(degree)) if degree is not None else x
    now = stat.select("id", F.col("v").alias("r"), "ysum", F.array_repeat(F.lit(float(a0)), k).alias("a"), F.array_repeat(F.lit(float(b0)), k).alias("b"))
    log_mean = lambda: F.zip_with("a", "b", lambda a, b: digamma(a) - F.log(b))
    path = None
    for t in range(iterations):
        logits = now.withColumn("v", v_add(F.col("r"), log_mean()))
        if each == "stretch":
            held, held_path = materialize(logits, "logits")
            logits = stretch(held, k)
        rho = F.transform(v_log_softmax(F.col("v")), lambda z: F.exp(z))
        now = logits.withColumn("rho", rho).select("id", "r", "ysum", F.transform("rho", lambda p: F.lit(float(a0)) + F.col("ysum") * p).alias("a"), F.transform(x, lambda s: F.lit(float(b0)) + s).alias("b"))
        if each == "stretch" or t % 4 == 3:  # else the expression doubles with every round
            now, next_path = materialize(now, "theta")
            release(stat.sparkSession, path, held_path if each == "stretch" else None)
            path = next_path
    return now.select("id", F.zip_with("a", "b", lambda a, b: a / b).alias("theta"), log_mean().alias("log_theta"), F.zip_with("a", "b", lambda a, b: F.lit(1.0) / F.sqrt(F.when(a > 1, a - 1).otherwise(a))).alias("log_theta_sd"), F.col("r").alias("corr"), "ysum")


def pmf_theta(log_beta: DataFrame, stat: DataFrame, k: int, a0: float = 1.0, b0: float = 1.0, iterations: int = 10, stretch_r: bool = True) -> DataFrame:
    """(id, theta, log_theta, log_theta_sd, corr, ysum) from statistics (id, v, ysum). Deterministic."""
    sums, n = dictionary_sums(log_beta, k)
    return _theta(stat, sums, float(max(n, 1)), k, a0, b0, iterations, "stretch" if stretch_r else None)


def pmf_regression(coo: DataFrame, log_beta: DataFrame, k: int, log_delta: DataFrame | None = None, k_delta: int = 0, stretch_beta: bool = True, stretch_r: bool = True, log1p: bool = False, a0: float = 1.0, b0: float = 1.0, iterations: int = 10, columns: DataFrame | None = None, extra_stretch: bool = True) -> DataFrame:
    """Loadings of every column. With log_delta (row_id, v) the correlations lose their projection on those with delta first.

    Without it, only the additional stretch of the correlations remains of that step, if extra_stretch and stretch_r.
    """
    stat, _ = materialize(pmf_stat(coo, log_beta, k, stretch_beta, log1p, columns=columns), "stat")
    if log_delta is not None:
        null = pmf_stat(coo, log_delta, k_delta, stretch_beta, log1p, columns=columns)
        stat, _ = materialize(residual(stat, null, k, k_delta), "residual")
    if stretch_r and (extra_stretch or log_delta is not None):
        stat, _ = materialize(stretch(stat, k), "stretched")
    return pmf_theta(log_beta, stat, k, a0, b0, iterations, stretch_r)


def pmf_regression_mtx(spark: SparkSession, header: str, log_beta: DataFrame, k: int, log_delta: DataFrame | None = None, k_delta: int = 0, **options) -> DataFrame:
    """pmf_regression of a file set <header>.*: dictionaries are (name, v), matched with the rows of the file by name; the result has the columns' `name`, too.

    Every column of the file comes out, empty ones with a zero sum. Of a name that the file has several times the rows add up.
    """
    from trigrid.operators.select import relocate

    m = MatrixSet.from_mtx(spark, header)
    names, _ = materialize(numbered(log_beta.select("name").where("name IS NOT NULL").distinct(), ["name"], "pos"), "names")
    keyed = lambda x: x.join(names, "name").select(F.col("pos").alias("row_id"), "v")
    coo, _ = materialize(relocate(m, names), "triplets")
    out = pmf_regression(coo, keyed(log_beta), k, None if log_delta is None else keyed(log_delta), k_delta, columns=m.cols.select("col_id"), **options)
    return out.join(m.cols.select(F.col("col_id").alias("id"), "name"), "id")


def pmf_regression_cbind(batches: dict[str, DataFrame], log_beta: DataFrame, k: int, log_delta: DataFrame | None = None, k_delta: int = 0, stretch_beta: bool = True, stretch_r: bool = True, log1p: bool = False, a0: float = 1.0, b0: float = 1.0, iterations: int = 10) -> DataFrame:
    """(batch, id, theta, log_theta, ...) of several matrices with the same features; ids need to be unique within a batch only.

    Correlations are standardised over all columns, cleared of those with the well-supported rows of delta, standardised
    again; theta is estimated batch by batch.
    """
    key = F.struct("batch", "id")

    def stats(x: DataFrame, kx: int, stretched: bool) -> DataFrame:
        each = [pmf_stat(coo, x, kx, stretched, log1p).select(F.lit(b).alias("batch"), "id", "v", "ysum") for b, coo in batches.items()]
        return reduce(DataFrame.unionByName, each).select(key.alias("id"), "v", "ysum")

    r, _ = materialize(stats(log_beta, k, stretch_beta), "stat")
    if stretch_r:
        r = standardize(r, k)
    if log_delta is not None:
        r0, _ = materialize(stats(delta_rows(log_delta), k_delta, False), "null")
        r0 = standardize(r0, k_delta) if stretch_r else r0
        r, _ = materialize(residual(r, r0, k, k_delta, 1e-4), "residual")
        r = standardize(r, k) if stretch_r else r
    r, _ = materialize(r, "stat")
    out = [pmf_theta(log_beta, r.where(F.col("id.batch") == b), k, a0, b0, iterations, stretch_r) for b in batches]
    return reduce(DataFrame.unionByName, out).select("id.batch", "id.id", "theta", "log_theta", "log_theta_sd", "corr", "ysum")


def topic_pmf(beta: DataFrame, stat: DataFrame, k: int, a0: float = 1.0, b0: float = 1.0, iterations: int = 10, stretch_r: bool = True) -> DataFrame:
    """Loadings from a dictionary (row_id, v, not logarithms) and statistics (id, v, ysum)."""
    return pmf_theta(beta.select("row_id", F.transform("v", lambda x: F.log(F.greatest(x, F.lit(1e-300)))).alias("v")), stat, k, a0, b0, iterations, stretch_r)


def pmf_stat_rbind(views: dict[str, tuple[DataFrame, DataFrame]], k: int, log1p: bool = False) -> DataFrame:
    """(view, id, v, ysum): the statistics of each view (coo, log_beta) of the same columns; dictionaries aren't stretched."""
    return reduce(DataFrame.unionByName, [pmf_stat(coo, b, k, False, log1p).select(F.lit(n).alias("view"), "id", "v", "ysum") for n, (coo, b) in views.items()])


def topic_pmf_rbind(betas: dict[str, DataFrame], stats: DataFrame, k: int, a0: float = 1.0, b0: float = 1.0, iterations: int = 10, stdize_r: bool = True) -> DataFrame:
    """Loadings shared by views: r and ysum add up over views (view, id, v, ysum), x is the sum of the dictionaries' column sums."""
    total = stats.groupBy("id").agg(v_sums("v", k).alias("v"), F.sum("ysum").alias("ysum"))
    total, _ = materialize(standardize(total, k) if stdize_r else total, "stat")
    sums = [0.0] * k
    for b in betas.values():
        r = b.agg(v_sums("v", k).alias("s")).first()["s"]
        sums = [x + (y or 0.0) for x, y in zip(sums, r, strict=True)]
    return _theta(total, sums, None, k, a0, b0, iterations, None)


def standardized_dictionary(x: DataFrame, k: int) -> DataFrame:
    mu, sd = moments(x, k)
    return x.withColumn("v", F.array(*[(F.get("v", F.lit(i)) - mu[i]) / (sd[i] + 1e-8) for i in range(k)]))
