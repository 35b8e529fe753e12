"""Pseudo-bulk: columns projected, sign-hashed into buckets, summed by bucket; with and without batch adjustment."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrid.matrixset import MatrixSet
from trigrid.operators.graph import k_nearest, match_weights
from trigrid.operators.linalg import project, residual, singular
from trigrid.operators.normalize import l1_columns, l2_columns, standardize
from trigrid.operators.select import common_names, control_mask, down_sample, first_by_name, relocate
from trigrid.operators.stats import row_mean_sd
from trigrid.runtime import lookup_join, materialize, numbered


def sign_code(v: str, k: int) -> Column:
    """Bit i is set where element i is positive."""
    return sum((F.when(F.get(v, F.lit(i)) > 0, F.lit(2**i)).otherwise(F.lit(0)) for i in range(k)), F.lit(0)).cast("long")


def bucketize(vecs: DataFrame, k: int, down: bool = False, per_sample: int = 100, seed: int = 42, drop_last: bool = False) -> DataFrame:
    """(id, positions): sign codes numbered 1.. by first appearance in id order. down: at most per_sample ids keep their bucket, the rest get null.

    drop_last gives the last-found bucket to nobody, as if it were the mark of a dropped id. At most 2^k codes exist, so their table is small.
    """
    coded = vecs.select("id", sign_code("v", k).alias("code"))
    codes = numbered(coded.groupBy("code").agg(F.min("id").alias("first")), ["first", "code"], "positions")
    out = lookup_join(coded, codes.select("code", "positions"), ["code"]).select("id", F.col("positions").cast("long").alias("positions"))
    if drop_last:
        last = out.agg(F.max("positions")).first()[0]
        out = out.withColumn("positions", F.when(F.col("positions") != F.lit(last), F.col("positions")))
    if down:
        kept = down_sample(out, "positions", "id", per_sample, seed).select("id", F.lit(True).alias("__kept"))
        out = out.join(kept, "id", "left").select("id", F.when(F.col("__kept"), F.col("positions")).alias("positions"))
    return out


def bulk_sums(coo: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, positions, total) and (positions, size) over the ids (id, positions) that have a bucket. Sums are pre-aggregated before the shuffle, so a large bucket is no hot spot."""
    b = buckets.where("positions IS NOT NULL")
    joined = coo.join(b.select(F.col("id").alias("col_id"), "positions"), "col_id")
    return joined.groupBy("row_id", "positions").agg(F.sum("value").alias("total")), b.groupBy("positions").agg(F.count("*").alias("size"))


def posterior_bulk(sums: DataFrame, sizes: DataFrame, a0: float, b0: float) -> DataFrame:
    """(row_id, positions, mean, log_mean_a, log_mean_b): (a0 + sum) / (b0 + size) where a sum exists; other cells are a0 / (b0 + size)."""
    return lookup_join(sums, sizes, ["positions"], "inner").select("row_id", "positions", ((F.col("total") + a0) / (F.col("size") + b0)).alias("mean"), (F.col("total") + a0).alias("a"), (F.col("size") + b0).alias("b"))


@dataclass
class Bulk:
    """bulk (row_id, positions, mean), sums (row_id, positions, total), sizes (positions, size), positions (id, positions), proj (id, v)."""

    bulk: DataFrame
    sums: DataFrame
    sizes: DataFrame
    positions: DataFrame
    proj: DataFrame


def random_bulk(m: MatrixSet, factors: int, seed: int = 42, cell_norm: float = 1e4, log1p: bool = False, down: bool = False, weighted: bool = False, per_sample: int = 100, a0: float = 1e-8, b0: float = 1.0, covariates: DataFrame | None = None, n_covariates: int = 0, row_covariates: DataFrame | None = None, n_row_covariates: int = 0, restrict: DataFrame | None = None, drop_last: bool = False, mode: str = "normal") -> Bulk:
    """Random pseudo-bulk of one matrix.

    Columns, scaled to the length cell_norm, are projected on `factors` directions; covariates of columns (id, v) and those that
    come from rows (row_id, v) are regressed out; the singular vectors are standardised and their signs are the buckets. Sums are those of the raw
    values. restrict (name): only rows of these names count. weighted: rows weigh by their deviation.
    """
    coo = m.coo
    if restrict is not None:
        kept = lookup_join(m.rows, restrict.select("name").distinct(), ["name"], "left_semi")
        coo = lookup_join(coo, kept.select("row_id").distinct(), ["row_id"], "left_semi")
    y = coo.withColumn("value", F.log1p("value")) if log1p else coo
    unit = l2_columns(y, cell_norm)
    weights = None
    if weighted:
        n = m.cols.count()
        weights = row_mean_sd(y, n).select("row_id", F.col("sigma").alias("factor"))
    q, _ = materialize(project(unit, factors, seed, mode, weights), "projected")
    if covariates is not None:
        q, _ = materialize(residual(q, covariates, factors, n_covariates), "projected")
    if row_covariates is not None:
        from trigrid.operators.recal import pmf_stat

        x = pmf_stat(unit, row_covariates, n_row_covariates, False, softmax=False)
        x = x.withColumn("v", F.transform("v", lambda s: s * F.greatest("ysum", F.lit(1.0)))).select("id", "v")
        q, _ = materialize(residual(q, x, factors, n_row_covariates), "projected")
    left, s, _ = singular(q, factors)
    v, _ = materialize(standardize(left.select("id", "v"), len(s)), "vectors")
    positions, _ = materialize(bucketize(v, len(s), down, per_sample, seed, drop_last), "positions")
    sums, sizes = bulk_sums(coo, positions)
    return Bulk(posterior_bulk(sums, sizes, a0, b0).select("row_id", "positions", "mean"), sums, sizes, positions, v)


def random_bulk_rbind(views: list[MatrixSet], factors: int, seed: int = 42, down: bool = False, weighted: bool = False, per_sample: int = 100, a0: float = 1e-8, b0: float = 1.0, mode: str = "normal") -> tuple[list[Bulk], DataFrame]:
    """Pseudo-bulk of views with the same columns (by name, those in all views): each view is projected on max(1, factors // views) directions, the
    projections are put side by side, and one bucketing serves all. Returns a Bulk for each view, whose ids are ranks of names, and (name, pos)."""
    names, _ = materialize(common_names([m.cols for m in views]), "names")
    each = max(1, factors // len(views))
    parts, data = [], []
    for b, m in enumerate(views):
        to = first_by_name(m.cols, "col_id").join(names, "name").select("col_id", "pos")
        coo = m.coo.join(to, "col_id").select("row_id", F.col("pos").alias("col_id"), "value")
        data.append(coo)
        weights = row_mean_sd(coo, names.count()).select("row_id", F.col("sigma").alias("factor")) if weighted else None
        parts.append(project(l2_columns(coo, 1e4), each, seed + b, mode, weights).withColumnRenamed("v", f"v{b}"))
    zero = F.array_repeat(F.lit(0.0), each)
    wide = names.select(F.col("pos").alias("id"))
    for p in parts:
        wide = wide.join(p, "id", "left")
    k = each * len(views)
    q = wide.select("id", F.concat(*[F.coalesce(f"v{b}", zero) for b in range(len(views))]).alias("v"))
    q, _ = materialize(standardize(q, k), "projected")
    left, s, _ = singular(q, k)
    v, _ = materialize(standardize(left, len(s)), "vectors")
    positions, _ = materialize(bucketize(v, len(s), down, per_sample, seed), "positions")
    out = []
    for coo in data:
        sums, sizes = bulk_sums(coo, positions)
        out.append(Bulk(posterior_bulk(sums, sizes, a0, b0).select("row_id", "positions", "mean"), sums, sizes, positions, v))
    return out, names


def batch_sums(coo: DataFrame, cells: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, batch, total) over all cells (id, batch), and (batch, positions, n, prob): cells with a bucket, as a share of the bucket's."""
    delta = coo.join(cells.select(F.col("id").alias("col_id"), "batch"), "col_id").groupBy("row_id", "batch").agg(F.sum("value").alias("total"))
    n = buckets.where("positions IS NOT NULL").join(cells, "id").groupBy("batch", "positions").agg(F.count("*").alias("n"))
    whole = n.groupBy("positions").agg(F.sum("n").alias("__w"))
    return delta, n.join(whole, "positions").select("batch", "positions", "n", (F.col("n") / F.col("__w")).alias("prob"))


@dataclass
class AdjustedBulk:
    """bulk (row_id, positions, mu, gamma), effect (row_id, batch, delta, log_delta), sizes, batch_sizes, positions, proj."""

    bulk: DataFrame
    effect: DataFrame | None
    sizes: DataFrame
    batch_sizes: DataFrame
    positions: DataFrame
    proj: DataFrame


def adjust_batches(y: DataFrame, z: DataFrame, sizes: DataFrame, batch_sizes: DataFrame, delta_sums: DataFrame, a0: float = 1.0, b0: float = 1.0, iterations: int = 100) -> tuple[DataFrame, DataFrame]:
    """((row_id, positions, mu, gamma), (row_id, batch, delta, log_delta)) by alternating Gamma means.

    y, z (row_id, positions, total): sums, and counterfactual sums; delta_sums (row_id, batch, total). Rows are independent of each other, so
    each is iterated on its own: the arrays of a row have one element for each bucket and batch, and no shuffle is needed between iterations.
    """
    import numpy as np
    import pyarrow as pa

    from trigrid.functions.numeric import digamma

    spark = y.sparkSession
    by_bucket = sorted((r["positions"], r["size"]) for r in sizes.collect())  # at most 2^k buckets
    s_ids, size = [s for s, _ in by_bucket], np.array([float(n) for _, n in by_bucket])
    by_batch = batch_sizes.collect()  # one row for each batch and bucket
    b_ids = sorted({r["batch"] for r in by_batch})
    at_s, at_b = {s: i for i, s in enumerate(s_ids)}, {b: i for i, b in enumerate(b_ids)}
    n_bs = np.zeros((len(b_ids), len(s_ids)))
    for r in by_batch:
        n_bs[at_b[r["batch"]], at_s[r["positions"]]] = r["n"]

    # one place in the array of a row for each number: sums, counterfactual sums, batches
    n_s, n_b = len(s_ids), len(b_ids)
    s_at = F.broadcast(spark.createDataFrame(list(at_s.items()), "positions long, at int"))
    b_at = F.broadcast(spark.createDataFrame(list(at_b.items()), "batch string, at int"))
    placed = y.join(s_at, "positions").select("row_id", "at", "total")
    placed = placed.unionByName(z.join(s_at, "positions").select("row_id", (F.col("at") + n_s).alias("at"), "total"))
    placed = placed.unionByName(delta_sums.join(b_at, "batch").select("row_id", (F.col("at") + 2 * n_s).alias("at"), "total"))
    rows = placed.groupBy("row_id").agg(F.collect_list("at").alias("at"), F.collect_list("total").alias("total"))  # 2 S + B entries a row

    def run(batches):
        for b in batches:
            n = b.num_rows
            at, total = b.column("at"), b.column("total")
            row = np.repeat(np.arange(n), at.value_lengths().to_numpy())
            held = np.zeros((n, 2 * n_s + n_b))
            held[row, at.flatten().to_numpy()] = total.flatten().to_numpy()
            ys, zs, ds = held[:, :n_s], held[:, n_s : 2 * n_s], held[:, 2 * n_s :]
            delta, gamma = np.ones_like(ds), np.ones_like(ys)
            mu = np.ones_like(ys)
            da, db = ds + a0, np.ones_like(ds)
            for _ in range(iterations):
                mu = (a0 + ys + zs) / (b0 + delta @ n_bs + gamma * size)
                gamma = (a0 + zs) / (b0 + mu * size)
                db = b0 + mu @ n_bs.T
                delta = da / db
            log_delta = digamma(da) - np.log(db)
            lists = lambda x: pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).ravel())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([b.column("row_id"), *(lists(x) for x in (mu, gamma, delta, log_delta))], names=["row_id", "mu", "gamma", "delta", "log_delta"])

    out, _ = materialize(rows.mapInArrow(run, "row_id long, mu array<double>, gamma array<double>, delta array<double>, log_delta array<double>"), "adjusted")
    sk = F.array(*[F.lit(s) for s in s_ids])
    bk = F.array(*[F.lit(b) for b in b_ids])
    bulk = out.select("row_id", F.explode(F.arrays_zip(sk.alias("positions"), "mu", "gamma")).alias("z")).select("row_id", "z.positions", "z.mu", "z.gamma")
    effect = out.select("row_id", F.explode(F.arrays_zip(bk.alias("batch"), "delta", "log_delta")).alias("z")).select("row_id", "z.batch", "z.delta", "z.log_delta")
    return bulk, effect


def random_bulk_cbind(coo: DataFrame, rows: DataFrame, cells: DataFrame, factors: int, controls: DataFrame | None = None, seed: int = 42, cell_norm: float = 1e4, adjust: bool = True, log1p: bool = False, down: bool = True, knn: int = 10, per_sample: int = 100, iterations: int = 100, min_controls: int = 10, a0: float = 1.0, b0: float = 1.0, normalize_matched: bool = False, mode: str = "normal") -> AdjustedBulk:
    """Pseudo-bulk of columns from several batches. cells: (id, batch); coo.col_id are their ids.

    Columns are projected by their shares (L1); with control rows their part is regressed out. Sums are those of columns of the length cell_norm. For every
    cell with a bucket its knn nearest cells in each other batch give a counterfactual column (of raw values, unless normalize_matched), and
    mu, gamma and delta are estimated alternately (adjust_batches). Without adjustment mu = (a0 + sum) / (b0 + size).
    """
    y = coo.withColumn("value", F.log1p("value")) if log1p else coo
    share = l1_columns(y)
    mask = control_mask(rows, controls, min_controls) if controls is not None else rows.select("row_id", F.lit(1.0).alias("neg"), F.lit(1.0).alias("pos"))
    weights = lambda c: mask.select("row_id", F.col(c).alias("factor"))
    q, _ = materialize(project(share, factors, seed, mode, weights("pos")), "projected")
    if controls is not None:
        q0, _ = materialize(project(share, factors, seed, mode, weights("neg")), "projected")
        q, _ = materialize(residual(q, q0, factors, factors), "projected")
    left, s, _ = singular(q, factors)
    k = len(s)
    v, _ = materialize(standardize(left, k), "vectors")
    positions, _ = materialize(bucketize(v, k, down, per_sample, seed), "positions")
    unit = l2_columns(y, cell_norm)
    masked = lookup_join(unit, weights("neg"), ["row_id"], "inner").select("row_id", "col_id", (F.col("value") * F.col("factor")).alias("value"))
    ysum, sizes = bulk_sums(unit, positions)
    delta_sums, batch_sizes = batch_sums(masked, cells, positions)
    batches = cells.select("batch").distinct().count()
    if batches < 2 or not adjust:
        mean = posterior_bulk(ysum, sizes, a0, b0).select("row_id", "positions", F.col("mean").alias("mu"), F.lit(None).cast("double").alias("gamma"))
        return AdjustedBulk(mean, None, sizes, batch_sizes, positions, v)
    unit_v = v.withColumn("v", F.transform("v", lambda x: x / F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, z: a + z * z)), F.lit(1e-8))))
    base = unit_v.join(cells, "id")
    asked = v.join(positions.where("positions IS NOT NULL").select("id"), "id").join(cells, "id")
    found = k_nearest(asked, base, k, knn, by="batch", other_only=True)
    weighted = match_weights(found, "id", "distance")
    per = weighted.join(positions, "id")
    total = per.groupBy("id").agg(F.sum("weight").alias("__w"))
    moved = per.join(total, "id").groupBy("match", "positions").agg(F.sum(F.col("weight") / F.col("__w")).alias("w"))
    source = unit if normalize_matched else coo
    source = lookup_join(source, weights("neg"), ["row_id"], "inner").select("row_id", "col_id", (F.col("value") * F.col("factor")).alias("value"))
    zsum = source.join(moved.withColumnRenamed("match", "col_id"), "col_id").groupBy("row_id", "positions").agg(F.sum(F.col("value") * F.col("w")).alias("total"))
    bulk, effect = adjust_batches(ysum, zsum, sizes, batch_sizes, delta_sums, a0, b0, iterations)
    return AdjustedBulk(bulk, effect, sizes, batch_sizes, positions, v)


def random_bulk_cbind_sets(sets: dict[str, MatrixSet], factors: int, union: bool = False, restrict: DataFrame | None = None, **options) -> tuple[AdjustedBulk, DataFrame, DataFrame]:
    """random_bulk_cbind over several matrices matched by row name. Returns the result, the rows (name, pos) and the cells (id, batch, name): a column is renamed <name>_<batch>."""
    names, _ = materialize(common_names([m.rows for m in sets.values()], union), "names")
    if restrict is not None:
        names = lookup_join(names, restrict.select("name").distinct(), ["name"], "left_semi")
    parts, cells, offset = [], [], 0
    for b, m in sets.items():
        parts.append(relocate(m, names).withColumn("col_id", F.col("col_id") + offset))
        cells.append(m.cols.select((F.col("col_id") + offset).alias("id"), F.lit(b).alias("batch"), F.concat_ws("_", "name", F.lit(b)).alias("name")))
        offset += (m.cols.agg(F.max("col_id")).first()[0] or 0) + 1
    coo, _ = materialize(reduce(DataFrame.unionByName, parts), "joined")
    all_cells = reduce(DataFrame.unionByName, cells)
    rows = names.select(F.col("pos").alias("row_id"), "name")
    return random_bulk_cbind(coo, rows, all_cells.select("id", "batch"), factors, **options), names, all_cells
