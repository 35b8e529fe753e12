"""Edges of a column graph as pseudo-columns: their vectors, similarities, pseudo-bulk and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrid.operators.bulk import Bulk, bucketize, bulk_sums, posterior_bulk
from trigrid.operators.linalg import project, singular
from trigrid.operators.normalize import l2_columns, standardize
from trigrid.operators.recal import pmf_stat, standardized_dictionary
from trigrid.runtime import lookup_join, materialize


def numbered_edges(edges: DataFrame) -> DataFrame:
    """(edge, src, dst, weight): a key for every edge, from its ends, so that passes agree however they run."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).withColumn("edge", F.xxhash64("src", "dst"))


def product_similarity(edges: DataFrame, lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """edges with `similarity`: sum y1 y2 / (sqrt(sum y1) sqrt(sum y2)), 0 if a sum is below 1. src is a column of rhs, dst one of lhs."""
    s1 = rhs.groupBy(F.col("col_id").alias("src")).agg(F.sum("value").alias("n1"))
    s2 = lhs.groupBy(F.col("col_id").alias("dst")).agg(F.sum("value").alias("n2"))
    a = rhs.select(F.col("col_id").alias("src"), "row_id", F.col("value").alias("y1"))
    b = lhs.select(F.col("col_id").alias("dst"), "row_id", F.col("value").alias("y2"))
    both = edges.select("src", "dst").join(a, "src").join(b, ["dst", "row_id"]).groupBy("src", "dst").agg(F.sum(F.col("y1") * F.col("y2")).alias("n12"))
    out = edges.join(both, ["src", "dst"], "left").join(s1, "src", "left").join(s2, "dst", "left")
    ok = (F.coalesce("n1", F.lit(0.0)) >= 1) & (F.coalesce("n2", F.lit(0.0)) >= 1)
    return out.withColumn("similarity", F.when(ok, F.coalesce("n12", F.lit(0.0)) / (F.sqrt("n1") * F.sqrt("n2"))).otherwise(0.0)).drop("n1", "n2", "n12")


def through(coo: DataFrame, network: DataFrame | None) -> DataFrame:
    """A y for a feature network (src, dst, weight) read as A[src, dst]; y itself without one."""
    if network is None:
        return coo
    a = network.select(F.col("dst").alias("row_id"), F.col("src").alias("__to"), F.col("weight").alias("__a"))
    return lookup_join(coo, a, ["row_id"], "inner").groupBy(F.col("__to").alias("row_id"), "col_id").agg(F.sum(F.col("value") * F.col("__a")).alias("value"))


def edge_vectors(edges: DataFrame, lhs: DataFrame, rhs: DataFrame, network: DataFrame | None = None, product: bool = False) -> DataFrame:
    """(row_id, col_id = edge, value): w / 2 (y1 + A y2 + y2 + A y1), or w / 2 (y1 * A y2 + y2 * A y1); edges have `edge` and `w`."""
    e = edges.select("edge", "src", "dst", "w")
    side = lambda coo, end: e.join(coo.select(F.col("col_id").alias(end), "row_id", "value"), end).select("edge", "w", "row_id", "value")
    parts = [side(rhs, "src"), side(through(lhs, network), "dst"), side(lhs, "dst"), side(through(rhs, network), "src")]
    if not product:
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        return total.groupBy("row_id", F.col("edge").alias("col_id")).agg((F.sum("value") * F.first("w") / 2).alias("value"))
    times = lambda x, y: x.join(y.select("edge", "row_id", F.col("value").alias("__y")), ["edge", "row_id"]).select("edge", "w", "row_id", (F.col("value") * F.col("__y")).alias("value"))
    both = times(parts[0], parts[1]).unionByName(times(parts[2], parts[3]))
    return both.groupBy("row_id", F.col("edge").alias("col_id")).agg((F.sum("value") * F.first("w") / 2).alias("value"))


def random_bulk_edges(lhs: DataFrame, rhs: DataFrame | None, edges: DataFrame, factors: int, network: DataFrame | None = None, product: bool = False, down: bool = False, per_sample: int = 100, seed: int = 42, cell_norm: float = 1e4, a0: float = 1.0, b0: float = 1.0, mode: str = "normal") -> tuple[Bulk, DataFrame]:
    """Pseudo-bulk over edges. The projection uses columns of length cell_norm and their similarity, the sums raw columns and theirs. Returns the Bulk (ids are edge keys) and the edges."""
    rhs = lhs if rhs is None else rhs
    named, _ = materialize(numbered_edges(edges), "edges")
    ln, rn = l2_columns(lhs, cell_norm), l2_columns(rhs, cell_norm)
    scaled = product_similarity(named, ln, rn).withColumn("w", F.col("weight") * F.col("similarity"))
    q, _ = materialize(project(edge_vectors(scaled, ln, rn, network, product), factors, seed, mode), "projected")
    left, s, _ = singular(q, factors)
    v, _ = materialize(standardize(left, len(s)), "vectors")
    positions, _ = materialize(bucketize(v, len(s), down, per_sample, seed), "positions")
    raw = product_similarity(named, lhs, rhs).withColumn("w", F.col("weight") * F.col("similarity"))
    sums, sizes = bulk_sums(edge_vectors(raw, lhs, rhs, network, product), positions)
    return Bulk(posterior_bulk(sums, sizes, a0, b0).select("row_id", "positions", "mean"), sums, sizes, positions, v), named


def pmf_stat_edges(lhs: DataFrame, rhs: DataFrame | None, edges: DataFrame, log_beta: DataFrame, k: int, network: DataFrame | None = None, stdize_beta: bool = True, product: bool = False, cell_norm: float = 1e4) -> DataFrame:
    """(src, dst, weight, v, colsum): y'X / max(sum y, 1) for the vector of every edge; no softmax. X is standardised by column. weight is the edge's weight times the similarity; colsum the floored sum."""
    rhs = lhs if rhs is None else rhs
    ln, rn = (l2_columns(x, cell_norm) for x in (lhs, rhs))
    named = product_similarity(numbered_edges(edges), ln, rn).withColumn("w", F.col("weight") * F.col("similarity"))
    named, _ = materialize(named.select("edge", "src", "dst", "w"), "edges")
    x = standardized_dictionary(log_beta, k) if stdize_beta else log_beta
    stat = pmf_stat(edge_vectors(named, ln, rn, network, product), x, k, False, softmax=False)
    joined = named.join(stat.withColumnRenamed("id", "edge"), "edge", "left")
    return joined.select("src", "dst", F.col("w").alias("weight"), F.coalesce("v", F.array_repeat(F.lit(0.0), k)).alias("v"), F.greatest(F.coalesce("ysum", F.lit(0.0)), F.lit(1.0)).alias("colsum"))
