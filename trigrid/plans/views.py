"""The matrices that the queries run on, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrid.functions.leaves import usable
from trigrid.matrixset import MatrixSet, clean_triplets
from trigrid.runtime import current_rows

#: Topics of the fixed dictionary, digits of rounded results.
K, DIGITS = 4, 4


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def coo(spark: SparkSession, d: str) -> DataFrame:
    """Usable triplets, added up by cell of the matrix; signed."""
    return clean_triplets(table(spark, d, "coo"), distinct=True)


def counts(spark: SparkSession, d: str) -> DataFrame:
    return coo(spark, d).where("value > 0")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(col_id, name, batch): the row of each cell that was registered last; batch in lower case, trimmed."""
    c = current_rows(table(spark, d, "matrix_cols"), ["col_id"], "registered_at", ["name", "batch"])
    return c.withColumn("batch", F.coalesce(F.lower(F.trim("batch")), F.lit("none")))


def matrix_set(spark: SparkSession, d: str) -> MatrixSet:
    return MatrixSet(counts(spark, d), table(spark, d, "matrix_rows").select("row_id", "name"), cells(spark, d))


def dictionary(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    """(row_id, v): logarithms of a fixed dictionary over the features of the matrix."""
    r = table(spark, d, "matrix_rows").select("row_id").distinct()
    return r.select("row_id", F.array(*[F.log(((F.col("row_id") * (7 + 4 * i) + 5 * i) % 13 + 1).cast("double")) for i in range(1, k + 1)]).alias("v"))


def loadings(spark: SparkSession, d: str, column: str = "log_theta", positive: bool = False) -> DataFrame:
    """(id, v): the current usable vectors of loading."""
    c = current_rows(table(spark, d, "loading"), ["id"], "fitted_at", [column])
    return c.where(usable(F.col(column), 10, positive)).select("id", F.col(column).alias("v"))


def projections(spark: SparkSession, d: str) -> DataFrame:
    c = current_rows(table(spark, d, "bulk_cells"), ["col_id"], "computed_at", ["rand_proj"])
    return c.where(usable(F.col("rand_proj"), 24)).select(F.col("col_id").alias("id"), F.col("rand_proj").alias("v"))


def buckets(spark: SparkSession, d: str) -> DataFrame:
    """(id, positions) of the current cells."""
    return current_rows(table(spark, d, "bulk_cells"), ["col_id"], "computed_at", ["positions"]).withColumnRenamed("col_id", "id")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, weight) of the stored graph: copies once, no loops, no null weights; repeated pairs add up."""
    e = table(spark, d, "knn_edges").where("src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL AND src <> dst").distinct()
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def rounded(c, digits: int = DIGITS):
    return F.round(c, digits) + F.lit(0.0)


def wide(df: DataFrame, keys: list[str], v: str, k: int, prefix: str = "v", digits: int = DIGITS) -> DataFrame:
    """keys and the elements of an array as columns prefix1.., rounded."""
    return df.select(*keys, *[rounded(F.get(v, F.lit(i)), digits).alias(f"{prefix}{i + 1}") for i in range(k)])


M = "m AS (SELECT row_id, col_id, sum(value) AS value FROM (SELECT DISTINCT * FROM coo) WHERE row_id IS NOT NULL AND col_id IS NOT NULL AND value IS NOT NULL AND isfinite(value) GROUP BY row_id, col_id)"
Y = M + ", y AS (SELECT * FROM m WHERE value > 0)"
CELLS = "cells AS (SELECT col_id, s.b AS name, coalesce(lower(trim(s.c)), 'none') AS batch FROM (SELECT col_id, max(struct_pack(a := registered_at, b := name, c := batch)) AS s FROM matrix_cols WHERE col_id IS NOT NULL GROUP BY col_id))"
X, X10 = (f"x AS (SELECT row_id, k, ln(CAST((row_id * (7 + 4 * k) + 5 * k) % 13 + 1 AS DOUBLE)) AS v FROM (SELECT DISTINCT row_id FROM matrix_rows), range(1, {n + 1}) t(k))" for n in (K, 10))
EDGES = "e AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT DISTINCT * FROM knn_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL AND src <> dst) GROUP BY src, dst)"
BUCKETS = "b AS (SELECT col_id AS id, max(struct_pack(a := computed_at, b := positions)).b AS positions FROM bulk_cells WHERE col_id IS NOT NULL GROUP BY col_id)"


def long_loadings(column: str = "log_theta", positive: bool = False) -> str:
    """CTE l(id, k, v)."""
    more = " AND v[1] > 0" + "".join(f" AND v[{i}] > 0" for i in range(2, 11)) if positive else ""
    finite = " AND ".join(f"v[{i}] IS NOT NULL AND isfinite(v[{i}])" for i in range(1, 11))
    return f"c AS (SELECT id, max(struct_pack(a := fitted_at, b := {column})).b AS v FROM loading WHERE id IS NOT NULL GROUP BY id), l AS (SELECT id, k, v[k] AS v FROM c, range(1, 11) t(k) WHERE len(v) = 10 AND {finite}{more})"


def wide_sql(source: str, key: str, k: int, value: str = "v", prefix: str = "v", digits: int = DIGITS) -> str:
    cols = ", ".join(f"round(max(CASE WHEN k = {i} THEN {value} END), {digits}) + 0e0 AS {prefix}{i}" for i in range(1, k + 1))
    return f"SELECT {key}, {cols} FROM {source} GROUP BY {key}"


def standard_sql(source: str, out: str, key: str = "id", value: str = "v") -> str:
    """CTEs that standardise the columns k of (key, k, v)."""
    return f"""{out}_m AS (SELECT k, sum({value}) / (count(*) + 1e-8) AS mu, sum({value} * {value}) / (count(*) + 1e-8) AS q FROM {source} GROUP BY k),
{out}_s AS (SELECT k, mu, sqrt(q - mu * mu + 1e-8 - least(0, (SELECT min(q - mu * mu + 1e-8) FROM {out}_m))) AS sd FROM {out}_m),
{out} AS (SELECT s.*, (s.{value} - mu) / (sd + 1e-8) AS z FROM {source} s JOIN {out}_s USING (k))"""


def clip_sql(source: str, out: str, value: str = "v", low: float = 0.01, high: float = 0.99) -> str:
    """CTEs that clip all cells of (.., k, v) at the order statistics ceil(q n), from 0."""
    return f"""{out}_r AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS r, count(*) OVER () AS n FROM {source}),
{out}_b AS (SELECT max(CASE WHEN r = least(ceil({low} * n), n - 1) THEN v END) AS lb, max(CASE WHEN r = least(ceil({high} * n), n - 1) THEN v END) AS ub FROM {out}_r),
{out} AS (SELECT s.* REPLACE (CASE WHEN lb < ub THEN least(greatest(s.{value}, lb), ub) ELSE s.{value} END AS {value}) FROM {source} s, {out}_b)"""


def softmax_sql(source: str, out: str, key: str = "id", value: str = "v") -> str:
    """CTE with lp = v - log sum exp over k."""
    return f"""{out}_x AS (SELECT {key}, max({value}) AS mx FROM {source} GROUP BY {key}),
{out}_e AS (SELECT s.{key}, mx + ln(sum(exp(s.{value} - mx))) AS lse FROM {source} s JOIN {out}_x USING ({key}) GROUP BY s.{key}, mx),
{out} AS (SELECT s.*, s.{value} - lse AS lp FROM {source} s JOIN {out}_e USING ({key}))"""
