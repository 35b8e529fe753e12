"""Row and column statistics of a sparse matrix, and the catalog of its columns. All over (row_id, col_id, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrid.functions.special import inf_zero, is_obs

#: Fixed value: what counts as an entry.
TINY = 1e-8


def _moments(v: Column) -> list[Column]:
    return [F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.count_if(F.abs(F.col("value")) > TINY).alias("nnz")]


def row_stat(coo: DataFrame, log1p: bool = False) -> DataFrame:
    """(row_id, s1, s2, nnz): sums of values and squares (of log1p of them, if asked), number of entries above TINY in size."""
    return coo.groupBy("row_id").agg(*_moments(F.log1p("value") if log1p else F.col("value")))


def col_stat(coo: DataFrame) -> DataFrame:
    return coo.groupBy("col_id").agg(*_moments(F.col("value")))


def row_col_stat(coo: DataFrame) -> DataFrame:
    """Both in one pass by grouping sets: the key of the other axis is null."""
    return coo.groupingSets([[F.col("row_id")], [F.col("col_id")]], "row_id", "col_id").agg(*_moments(F.col("value")))


def histogram(coo: DataFrame) -> DataFrame:
    """Frequency of the values rounded to whole numbers, halves away from zero."""
    return coo.groupBy(F.round("value").cast("long").alias("bin")).agg(F.count("*").alias("n"))


def row_mean_sd(coo: DataFrame, n_columns: int, log1p: bool = False) -> DataFrame:
    """(row_id, mu, sigma) over all columns, zeros included: sigma = sqrt(s2 / N - mu^2) + TINY."""
    n = F.lit(float(n_columns))
    mu = F.col("s1") / n
    return row_stat(coo, log1p).select("row_id", mu.alias("mu"), (F.sqrt(F.greatest(F.col("s2") / n - mu * mu, F.lit(0.0))) + TINY).alias("sigma"))


def row_degree(coo: DataFrame) -> DataFrame:
    return coo.groupBy("row_id").agg(F.sum(F.abs("value")).alias("degree"))


def row_sd(coo: DataFrame, n_columns: int) -> DataFrame:
    """Sample standard deviation over all columns (n - 1); null for a single column."""
    n = F.lit(float(n_columns))
    return row_stat(coo).select("row_id", F.when(n > 1, F.sqrt(F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / n, F.lit(0.0)) / (n - 1))).alias("sd"))


def running_stat(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample variance and deviation of each cell over iterations."""
    v = F.col(value)
    return samples.groupBy(*keys).agg(F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.stddev_samp(v).alias("sd"))


def safe_sums(coo: DataFrame, by: list[str]) -> DataFrame:
    """Sums with non-finite values as 0, and the number of finite ones."""
    return coo.groupBy(*by).agg(F.sum(inf_zero(F.col("value"))).alias("total"), F.sum(is_obs(F.col("value"))).cast("long").alias("n_obs"))


def observed_products(x: DataFrame, y: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """(row_id, col_id, total, n_obs) of x (row_id, inner_id, value) times y (inner_id, col_id, value): the sum of products over finite pairs, and their number + pseudo."""
    p = F.col("x") * F.col("y")
    joined = x.select("row_id", "inner_id", F.col("value").alias("x")).join(y.select("inner_id", "col_id", F.col("value").alias("y")), "inner_id")
    return joined.groupBy("row_id", "col_id").agg(F.sum(inf_zero(p)).alias("total"), (F.sum(is_obs(p)) + pseudo).alias("n_obs"))


def column_catalog(coo: DataFrame) -> DataFrame:
    """(col_id, nnz, first_offset): of every non-empty column the number of entries and the position of the first, in column order.

    The positions come from sums over ranges of columns, one per partition, so no task sorts all columns. An empty last column is no error.
    """
    per = coo.groupBy("col_id").agg(F.count("*").alias("nnz"))
    width = 4096
    ranges = per.groupBy(F.floor(F.col("col_id") / width).alias("range")).agg(F.sum("nnz").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for 4096 columns
    base = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("col_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = per.withColumn("range", F.floor(F.col("col_id") / width)).join(base, "range")
    return joined.select("col_id", "nnz", (F.col("base") + F.coalesce(F.sum("nnz").over(inside), F.lit(0))).alias("first_offset"))


def complete_catalog(catalog: DataFrame, n_columns: int) -> DataFrame:
    """(col_id, first_offset) for 1..n_columns: an empty column has the offset of the next non-empty one; null after the last."""
    width = 4096
    every = catalog.sparkSession.range(1, n_columns + 1).withColumnRenamed("id", "col_id")
    known = every.join(catalog.select("col_id", "first_offset"), "col_id", "left").withColumn("range", F.floor(F.col("col_id") / width))
    firsts = known.groupBy("range").agg(F.min("first_offset").alias("m"))
    after = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    nxt = firsts.select("range", F.first("m", ignorenulls=True).over(after).alias("next"))
    inside = Window.partitionBy("range").orderBy("col_id").rowsBetween(0, Window.unboundedFollowing)
    return known.join(nxt, "range").select("col_id", F.coalesce(F.first("first_offset", ignorenulls=True).over(inside), "next").alias("first_offset"))


def check_catalog(coo: DataFrame, catalog: DataFrame) -> bool:
    """Whether every column of the catalog starts where it says; columns without entries are tolerated."""
    now = column_catalog(coo).select("col_id", F.col("first_offset").alias("now"))
    return catalog.join(now, "col_id").where(~F.col("now").eqNullSafe(F.col("first_offset"))).isEmpty()
