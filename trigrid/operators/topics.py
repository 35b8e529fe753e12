"""Topic proportions from a factorisation, and their drawing in the plane. beta (row_id, v), theta (id, v)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrid.functions.vectors import v_sum, v_sums


def pmf_to_topic(beta: DataFrame, theta: DataFrame, k: int, eps: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(beta, prop): beta divided by its column sums u (at least eps); prop (id, v, depth) = theta * u over its row sum, which is the depth (at least eps)."""
    u = beta.agg(v_sums("v", k).alias("u")).select(F.transform("u", lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(eps))).alias("u"))
    b = beta.crossJoin(F.broadcast(u)).select("row_id", F.zip_with("v", "u", lambda x, y: x / y).alias("v"))  # u is one row
    t = theta.crossJoin(F.broadcast(u)).select("id", F.zip_with("v", "u", lambda x, y: x * y).alias("v")).withColumn("depth", F.greatest(v_sum(F.col("v")), F.lit(eps)))
    return b, t.select("id", F.transform("v", lambda x: x / F.col("depth")).alias("v"), "depth")


def project_proportions(prop: DataFrame, k: int, max_angle: float = 2 * math.pi, jitter: bool = False, seed: int = 1) -> DataFrame:
    """(id, xx, yy): proportions around a circle, topic i (from 1) at the angle i / k * max_angle. jitter: normal, of the size max(prop) / k of each row, from a hash of the id."""
    sin = F.array(*[F.lit(math.sin((i + 1) / k * max_angle)) for i in range(k)])
    cos = F.array(*[F.lit(math.cos((i + 1) / k * max_angle)) for i in range(k)])
    out = prop.select("id", v_sum(F.zip_with("v", sin, lambda x, y: x * y)).alias("xx"), v_sum(F.zip_with("v", cos, lambda x, y: x * y)).alias("yy"), (F.array_max("v") / k).alias("__s"))
    if jitter:
        from trigrid.operators.linalg import normal_of

        out = out.withColumn("xx", F.col("xx") + F.col("__s") * normal_of([F.col("id"), F.lit(0)], seed)).withColumn("yy", F.col("yy") + F.col("__s") * normal_of([F.col("id"), F.lit(1)], seed))
    return out.drop("__s")


def tree_matrix(spark, depth: int) -> DataFrame:
    """(node, leaf) entries that are 1, both from 1: a complete binary tree in heap order with 2^depth leaves; a leaf depends on its node and all above it. depth < 2: one node, one leaf."""
    if depth < 2:
        return spark.createDataFrame([(1, 1)], "node long, leaf long")
    leaves = 2**depth
    up = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("up")
    every = spark.range(1, leaves + 1).select(F.col("id").alias("leaf"), up)
    return every.select(F.floor((F.col("leaf") + F.lit(leaves - 1)) / F.pow(F.lit(2.0), "up")).cast("long").alias("node"), "leaf")


def tree_depth(leaves: int) -> int:
    """The depth of the tree that has at least so many leaves."""
    return math.ceil(math.log2(max(leaves, 1)))
