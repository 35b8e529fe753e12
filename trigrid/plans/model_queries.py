"""Queries of pseudo-bulk, factorisation, recalibration, edges, clustering and simulation."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrid.functions.special import digamma_sql
from trigrid.matrixset import MatrixSet
from trigrid.operators import bulk, cluster, edges, graph, linalg, normalize, pmf, recal, simulate
from trigrid.plans import views as v
from trigrid.plans.matrix_queries import signs_sql, weights_sql
from trigrid.plans.views import BUCKETS, CELLS, EDGES, K, X, X10, Y, rounded, wide, wide_sql
from trigrid.runtime import materialize, release, shared_dir
from trigrid.sources.mtx import write_fileset

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def y(spark: SparkSession, d: str) -> DataFrame:
    return materialize(v.counts(spark, d), "counts")[0]


# ---- pseudo-bulk ----

# integer projections, centred at the column mean: no sign is decided by rounding of floats
_CODE = " + ".join(f"CASE WHEN v{i + 1} * n > s{i + 1} THEN {2**i} ELSE 0 END" for i in range(K))
_POSITIONS = (
    "q AS (SELECT col_id AS id, " + ", ".join(f"sum(round(value) * {signs_sql(i)}) AS v{i + 1}" for i in range(K)) + " FROM y GROUP BY col_id), "
    "qs AS (SELECT count(*) AS n, " + ", ".join(f"sum(v{i + 1}) AS s{i + 1}" for i in range(K)) + " FROM q), "
    f"qc AS (SELECT id, {_CODE} AS code FROM q, qs), "
    "qf AS (SELECT code, row_number() OVER (ORDER BY min(id)) AS positions FROM qc GROUP BY code), "
    "pos AS (SELECT id, positions FROM qc JOIN qf USING (code))"
)


def _positions(spark: SparkSession, counts: DataFrame, down: bool = False) -> DataFrame:
    q = linalg.project(counts.withColumn("value", F.round("value")), K, mode="rademacher")
    q, _ = materialize(q, "projected")
    s = q.agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(K)]).first()
    centred = q.withColumn("v", F.array(*[F.get("v", F.lit(i)) * s["n"] - s[f"s{i}"] for i in range(K)]))
    return materialize(bulk.bucketize(centred, K, down), "positions")[0]


@query(f"WITH {Y}, {_POSITIONS} SELECT id, positions FROM pos")
def b6_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, y(spark, d))


@query(f"WITH {Y}, {_POSITIONS}, n AS (SELECT positions, count(*) AS n FROM pos GROUP BY positions) SELECT positions, least(n, 100) AS n FROM n UNION ALL SELECT NULL, CAST(sum(n - least(n, 100)) AS BIGINT) FROM n HAVING sum(n - least(n, 100)) > 0")
def b6_down_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of at most 100 cells, drawn by hashes: cells by bucket; those dropped have none."""
    return _positions(spark, y(spark, d), True).groupBy("positions").agg(F.count("*").alias("n"))


@query(f"WITH {Y}, {_POSITIONS} SELECT row_id, positions, round(sum(value), 4) AS total FROM y JOIN pos ON pos.id = y.col_id GROUP BY row_id, positions")
def a18_bulk_sums(spark: SparkSession, d: str) -> DataFrame:
    c = y(spark, d)
    return bulk.bulk_sums(c, _positions(spark, c))[0].withColumn("total", F.round("total", 4))


@query(f"WITH {Y}, {_POSITIONS}, z AS (SELECT positions, count(*) AS size FROM pos GROUP BY positions) SELECT row_id, positions, round((1e-8 + sum(value)) / (1e0 + max(size)), 6) AS mean FROM y JOIN pos ON pos.id = y.col_id JOIN z USING (positions) GROUP BY row_id, positions")
def b1_posterior_bulk(spark: SparkSession, d: str) -> DataFrame:
    """The pseudo-bulk over integer-projected buckets."""
    c = y(spark, d)
    s, n = bulk.bulk_sums(c, _positions(spark, c))
    return bulk.posterior_bulk(s, n, 1e-8, 1.0).select("row_id", "positions", F.round("mean", 6).alias("mean"))


_G = "(1e0 + total)"


@query(f"WITH {Y}, g AS (SELECT row_id, sum(value) AS total, count(*) + 1e0 AS b FROM y GROUP BY row_id) SELECT row_id, round({_G} / b, 4) AS mean, round(sqrt({_G}) / b, 4) AS sd, round({digamma_sql(_G)} - ln(b), 4) + 0e0 AS log_mean, round(1e0 / sqrt(CASE WHEN {_G} > 1 THEN {_G} - 1 ELSE {_G} END), 4) AS log_sd FROM g")
def a19_gamma_moments(spark: SparkSession, d: str) -> DataFrame:
    """Posterior moments of every feature's rate."""
    from trigrid.functions import special as sp

    g = y(spark, d).groupBy("row_id").agg((F.sum("value") + 1.0).alias("a"), (F.count("*") + 1.0).alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.select("row_id", F.round(sp.gamma_mean(a, b), 4).alias("mean"), F.round(sp.gamma_sd(a, b), 4).alias("sd"), rounded(sp.gamma_log_mean(a, b)).alias("log_mean"), F.round(sp.gamma_log_sd(a), 4).alias("log_sd"))


@query(f"WITH {CELLS}, {BUCKETS}, n AS (SELECT batch, positions, count(*) AS n FROM b JOIN cells ON cells.col_id = b.id WHERE positions IS NOT NULL GROUP BY 1, 2) SELECT batch, positions, n, round(n / sum(n) OVER (PARTITION BY positions), 6) AS prob FROM n")
def a20_batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    c = v.cells(spark, d).select(F.col("col_id").alias("id"), "batch")
    return bulk.batch_sums(v.counts(spark, d), c, v.buckets(spark, d))[1].withColumn("prob", F.round("prob", 6))


@query(f"WITH {Y}, {CELLS} SELECT row_id, batch, round(sum(value), 4) AS total FROM y JOIN cells USING (col_id) GROUP BY 1, 2")
def a20_batch_sums(spark: SparkSession, d: str) -> DataFrame:
    c = v.cells(spark, d).select(F.col("col_id").alias("id"), "batch")
    return bulk.batch_sums(v.counts(spark, d), c, v.buckets(spark, d))[0].withColumn("total", F.round("total", 4))


@query()
def b1_random_bulk(spark: SparkSession, d: str) -> DataFrame:
    """The whole operator: Gaussian projection, singular vectors, sign buckets, posterior means."""
    m = v.matrix_set(spark, d)
    b = bulk.random_bulk(MatrixSet(y(spark, d), m.rows, m.cols), 5)
    return b.bulk


@query(f"WITH {Y}, {CELLS}, {BUCKETS}, u AS (SELECT row_id, col_id, value / greatest(sqrt(sum(value * value) OVER (PARTITION BY col_id)), 1e-8) * 10000e0 AS value FROM y), z AS (SELECT positions, count(*) AS size FROM b WHERE positions IS NOT NULL GROUP BY positions) SELECT row_id, positions, round((1e0 + sum(value)) / (1e0 + max(size)), 3) AS mean FROM u JOIN b ON b.id = u.col_id JOIN z USING (positions) GROUP BY row_id, positions")
def b4_unadjusted(spark: SparkSession, d: str) -> DataFrame:
    """The unadjusted path over the recorded buckets: columns of length 10,000."""
    s, n = bulk.bulk_sums(normalize.l2_columns(y(spark, d), 1e4), v.buckets(spark, d))
    return bulk.posterior_bulk(s, n, 1.0, 1.0).select("row_id", "positions", F.round("mean", 3).alias("mean"))


_ADJ = f"""WITH {Y}, {CELLS}, {BUCKETS},
bb AS (SELECT b.id, b.positions AS s, batch FROM b JOIN cells ON cells.col_id = b.id WHERE positions IS NOT NULL),
rr AS (SELECT DISTINCT row_id FROM y JOIN bb ON bb.id = y.col_id), ss AS (SELECT s, count(*) AS size FROM bb GROUP BY s), tt AS (SELECT DISTINCT batch AS t FROM bb),
ys AS (SELECT row_id, s, sum(value) AS total FROM y JOIN bb ON bb.id = y.col_id GROUP BY 1, 2),
zs AS (SELECT row_id, s, sum(value) / 2 AS total FROM y JOIN bb ON bb.id = y.col_id GROUP BY 1, 2),
ds AS (SELECT row_id, batch AS t, sum(value) AS total FROM y JOIN bb ON bb.id = y.col_id GROUP BY 1, 2),
nb AS (SELECT batch AS t, s, count(*) AS n FROM bb GROUP BY 1, 2),
g0 AS (SELECT row_id, s, size, coalesce(ys.total, 0) AS y, coalesce(zs.total, 0) AS z, 1e0 AS g FROM rr CROSS JOIN ss LEFT JOIN ys USING (row_id, s) LEFT JOIN zs USING (row_id, s)),
d0 AS (SELECT row_id, t, coalesce(ds.total, 0) AS d, 1e0 AS delta FROM rr CROSS JOIN tt LEFT JOIN ds USING (row_id, t))"""
for _i in range(2):
    _ADJ += f""",
e{_i} AS (SELECT row_id, s, sum(delta * n) AS dn FROM d{_i} JOIN nb USING (t) GROUP BY 1, 2),
m{_i} AS (SELECT row_id, s, size, y, z, (1e0 + y + z) / (1e0 + dn + g * size) AS mu FROM g{_i} JOIN e{_i} USING (row_id, s)),
g{_i + 1} AS (SELECT row_id, s, size, y, z, mu, (1e0 + z) / (1e0 + mu * size) AS g FROM m{_i}),
d{_i + 1} AS (SELECT row_id, d{_i}.t, d{_i}.d, (1e0 + d{_i}.d) / (1e0 + q) AS delta FROM d{_i} JOIN (SELECT row_id, t, sum(mu * n) AS q FROM m{_i} JOIN nb USING (s) GROUP BY 1, 2) USING (row_id, t))"""


def _adjust(spark: SparkSession, d: str):
    b = v.buckets(spark, d).where("positions IS NOT NULL")
    c = v.cells(spark, d).select(F.col("col_id").alias("id"), "batch")
    b = materialize(b.join(c.select("id"), "id", "left_semi"), "buckets")[0]
    counts = y(spark, d)
    s, n = bulk.bulk_sums(counts, b)
    _, nb = bulk.batch_sums(counts, c, b)
    delta = counts.join(b.select(F.col("id").alias("col_id")), "col_id", "left_semi").join(c.withColumnRenamed("id", "col_id"), "col_id").groupBy("row_id", "batch").agg(F.sum("value").alias("total"))
    return bulk.adjust_batches(s, s.withColumn("total", F.col("total") / 2), n, nb, delta, iterations=2)


@query(_ADJ + " SELECT row_id, s AS positions, round(mu, 4) AS mu, round(g, 4) AS gamma FROM g2")
def b4_adjusted_bulk(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of the batch adjustment over the recorded buckets; half of the sums stand in for the counterfactual."""
    return _adjust(spark, d)[0].select("row_id", "positions", F.round("mu", 4).alias("mu"), F.round("gamma", 4).alias("gamma"))


@query(_ADJ + " SELECT row_id, t AS batch, round(delta, 4) AS delta FROM d2")
def b4_batch_effect(spark: SparkSession, d: str) -> DataFrame:
    return _adjust(spark, d)[1].select("row_id", "batch", F.round("delta", 4).alias("delta"))


@query()
def b2_cbind_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """The whole batch-adjusted pseudo-bulk: projection, buckets, matched cells of other batches, 100 rounds."""
    m = v.matrix_set(spark, d)
    return bulk.random_bulk_cbind(y(spark, d), m.rows, m.cols.select(F.col("col_id").alias("id"), "batch"), 5, knn=3).bulk


@query()
def b3_cbind_sets(spark: SparkSession, d: str) -> DataFrame:
    """Two matrices (cells with and without a known batch) matched by feature name."""
    m = v.matrix_set(spark, d)
    counts = y(spark, d)
    part = lambda cond: MatrixSet(counts.join(m.cols.where(cond).select("col_id"), "col_id", "left_semi"), m.rows, m.cols.where(cond))
    return bulk.random_bulk_cbind_sets({"known": part("batch <> 'none'"), "none": part("batch = 'none'")}, 5, knn=3)[0].bulk


@query()
def b5_rbind(spark: SparkSession, d: str) -> DataFrame:
    """Two views (odd and even features) of the same cells, one bucketing."""
    m = v.matrix_set(spark, d)
    counts = y(spark, d)
    views = [MatrixSet(counts.where(F.col("row_id") % 2 == i), m.rows.where(F.col("row_id") % 2 == i), m.cols) for i in (0, 1)]
    out, _ = bulk.random_bulk_rbind(views, 6)
    return out[0].bulk.withColumn("view", F.lit(0)).unionByName(out[1].bulk.withColumn("view", F.lit(1)))


# ---- recalibration ----

_R8 = f"{Y}, {X}, s AS (SELECT col_id AS id, k, sum(value * v) / greatest(sum(value), 1e0) AS v, sum(value) AS ysum FROM y JOIN x USING (row_id) GROUP BY col_id, k), {v.softmax_sql('s', 'r')}"


def _stat(spark: SparkSession, d: str) -> DataFrame:
    return recal.pmf_stat(v.counts(spark, d), v.dictionary(spark, d), K, False)


@query(f"WITH {_R8} {wide_sql('r', 'id, round(ysum, 4)', K, 'lp', 'r').replace('SELECT id, round(ysum, 4)', 'SELECT id, round(ysum, 4) AS ysum')}")
def r8_stat(spark: SparkSession, d: str) -> DataFrame:
    return wide(_stat(spark, d).withColumn("ysum", F.round("ysum", 4)), ["id", "ysum"], "v", K, "r")


_XS = f"{Y}, {X}, {v.clip_sql('x', 'xc')}, {v.standard_sql('xc', 'xz', 'row_id')}, s AS (SELECT col_id AS id, k, sum(value * z) / greatest(sum(value), 1e0) AS v, sum(value) AS ysum FROM y JOIN xz USING (row_id) GROUP BY col_id, k), {v.softmax_sql('s', 'r')}"


@query(f"WITH {_XS} {wide_sql('r', 'id', K, 'lp', 'r')}")
def r8_stat_stretched(spark: SparkSession, d: str) -> DataFrame:
    """With the dictionary stretched first."""
    return wide(recal.pmf_stat(v.counts(spark, d), v.dictionary(spark, d), K, True), ["id"], "v", K, "r")


def theta_sql(rounds: int, stretched: bool, source: str = "r", rate: str = "ysum / dn * bs", value: str = "lp", a0: float = 1.0, b0: float = 1.0) -> str:
    """CTEs t<rounds>(id, k, r, ysum, bs, dn, a, b) from source (id, k, lp, ysum) and x."""
    out = f"bsum AS (SELECT k, sum(exp(v)) AS bs, CAST(count(*) AS DOUBLE) AS dn FROM x GROUP BY k), t0 AS (SELECT id, k, {value} AS r, ysum, bs, dn, {a0}e0 AS a, {b0}e0 AS b FROM {source} JOIN bsum USING (k))"
    for i in range(rounds):
        out += f", l{i} AS (SELECT *, r + {digamma_sql('a')} - ln(b) AS v FROM t{i})"
        src = f"l{i}"
        if stretched:
            out += f", {v.clip_sql(src, f'c{i}')}, {v.standard_sql(f'c{i}', f'z{i}')}, w{i} AS (SELECT * REPLACE (z AS v) FROM z{i})"
            src = f"w{i}"
        out += f", {v.softmax_sql(src, f'p{i}')}, t{i + 1} AS (SELECT id, k, r, ysum, bs, dn, {a0}e0 + ysum * exp(lp) AS a, {b0}e0 + {rate} AS b FROM p{i})"
    return out


@query(f"WITH {_R8}, {theta_sql(3, False)} {wide_sql('t3', 'id', K, 'a / b', 't')}")
def r9_theta(spark: SparkSession, d: str) -> DataFrame:
    """Statistics against the fixed dictionary, then three rounds of the loadings without stretching."""
    return wide(recal.pmf_theta(v.dictionary(spark, d), _stat(spark, d), K, iterations=3, stretch_r=False), ["id"], "theta", K, "t")


@query(f"WITH {_R8}, {theta_sql(1, True)} {wide_sql('t1', 'id', K, 'a / b', 't')}")
def r9_theta_stretched(spark: SparkSession, d: str) -> DataFrame:
    return wide(recal.pmf_theta(v.dictionary(spark, d), materialize(_stat(spark, d), "stat")[0], K, iterations=1), ["id"], "theta", K, "t")


@query(f"WITH {_XS}, {theta_sql(2, False)} {wide_sql('t2', 'id', K, digamma_sql('a') + ' - ln(b)', 'g')}")
def r1_regression(spark: SparkSession, d: str) -> DataFrame:
    """The whole recalibration with a stretched dictionary: expected logarithms of the loadings."""
    out = recal.pmf_regression(v.counts(spark, d), v.dictionary(spark, d), K, stretch_r=False, iterations=2)
    return wide(out, ["id"], "log_theta", K, "g")


_R2 = "n AS (SELECT max(row_id) AS n FROM matrix_rows), yf AS (SELECT row_id, col_id, value FROM y, n WHERE row_id BETWEEN 1 AND n AND col_id >= 1), q AS (SELECT col_id, row_number() OVER (ORDER BY col_id) AS id FROM yf GROUP BY col_id)"


@query(f"WITH {Y}, {_R2}, {X}, {v.clip_sql('x', 'xc')}, {v.standard_sql('xc', 'xz', 'row_id')}, s AS (SELECT q.id, k, sum(value * z) / greatest(sum(value), 1e0) AS v, sum(value) AS ysum FROM yf JOIN q USING (col_id) JOIN xz USING (row_id) GROUP BY q.id, k), {v.softmax_sql('s', 'r')}, {theta_sql(2, False)} {wide_sql('t2', 'id', K, digamma_sql('a') + ' - ln(b)', 'g')}")
def r2_regression_mtx(spark: SparkSession, d: str) -> DataFrame:
    """The recalibration of a file set without empty columns, features matched by name."""
    c, header = y(spark, d), f"{shared_dir(spark)}/r2"
    n = v.table(spark, d, "matrix_rows").agg(F.max("row_id")).first()[0]
    names = spark.range(1, n + 1).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("name"))
    files = write_fileset(MatrixSet(c.where(F.col("row_id").between(1, n) & (F.col("col_id") >= 1)), names, v.cells(spark, d)), header, drop_empty=True)
    beta = v.dictionary(spark, d).select(F.col("row_id").cast("string").alias("name"), "v")
    out, _ = materialize(recal.pmf_regression_mtx(spark, header, beta, K, stretch_r=False, iterations=2), "loadings")
    release(spark, *files.values())
    return wide(out, ["id"], "log_theta", K, "g")


def _correlations(x: str, out: str) -> str:
    """CTEs <out>(id, k, lp, ysum): log-softmax of the statistics against the stretched dictionary x."""
    return f"{v.clip_sql(x, f'{x}c')}, {v.standard_sql(f'{x}c', f'{x}z', 'row_id')}, {out}s AS (SELECT col_id AS id, k, sum(value * z) / greatest(sum(value), 1e0) AS v, sum(value) AS ysum FROM y JOIN {x}z USING (row_id) GROUP BY col_id, k), {v.softmax_sql(f'{out}s', out)}"


# the projection on two standardised columns, by the inverse of their 2 x 2 products
_R10 = f"""{Y}, {X}, xd AS (SELECT row_id, k, v / 2 AS v FROM x WHERE k <= 2), {_correlations('x', 'r')}, {_correlations('xd', 'rn')}, {v.standard_sql('rn', 'rnz', value='lp')},
zz AS (SELECT id, max(CASE WHEN k = 1 THEN z END) AS z1, max(CASE WHEN k = 2 THEN z END) AS z2 FROM rnz GROUP BY id),
aa AS (SELECT sum(z1 * z1) AS a11, sum(z1 * z2) AS a12, sum(z2 * z2) AS a22 FROM zz JOIN (SELECT DISTINCT id FROM r) USING (id)),
cc AS (SELECT k, (max(a22) * sum(z1 * lp) - max(a12) * sum(z2 * lp)) / max(a11 * a22 - a12 * a12) AS c1, (max(a11) * sum(z2 * lp) - max(a12) * sum(z1 * lp)) / max(a11 * a22 - a12 * a12) AS c2 FROM r JOIN zz USING (id), aa GROUP BY k),
res AS (SELECT r.id, r.k, lp - c1 * z1 - c2 * z2 AS v, ysum FROM r JOIN zz USING (id) JOIN cc ON cc.k = r.k), {v.clip_sql('res', 'rc')}, {v.standard_sql('rc', 'rcz')}"""


@query(f"WITH {_R10}, {theta_sql(10, True, 'rcz', value='z')} {wide_sql('t10', 'id', K, 'a / b', 't')}")
def r10_regression_delta(spark: SparkSession, d: str) -> DataFrame:
    """All defaults, with the correlations of two batch effects regressed out."""
    delta = v.dictionary(spark, d, 2).withColumn("v", F.transform("v", lambda x: x / 2))
    return wide(recal.pmf_regression(y(spark, d), v.dictionary(spark, d), K, delta, 2), ["id"], "theta", K, "t")


def _batch_theta(name: str, cond: str) -> str:
    """The CTEs of theta_sql for the cells of a batch, their names prefixed."""
    ctes = re.sub(r"\b(bsum|[tlczwp]\d+(?:_[a-z]+)?)\b", rf"{name}_\1", theta_sql(10, True, f"{name}_in"))
    return f"{name}_in AS (SELECT id, k, z AS lp, ysum FROM rz JOIN cells ON col_id = id WHERE {cond}), {ctes}"


_R3 = f"{Y}, {CELLS}, {X}, {v.clip_sql('x', 'xc')}, {v.standard_sql('xc', 'xz', 'row_id')}, s AS (SELECT col_id AS id, k, sum(value * xz.z) / greatest(sum(value), 1e0) AS v, sum(value) AS ysum FROM y JOIN xz USING (row_id) WHERE col_id IN (SELECT col_id FROM cells) GROUP BY col_id, k), {v.softmax_sql('s', 'r')}, {v.standard_sql('r', 'rz', value='lp')}"
_R3 = ", ".join([_R3, _batch_theta("known", "batch <> 'none'"), _batch_theta("none", "batch = 'none'")])


@query(f"WITH {_R3} SELECT 'known' AS batch, * FROM ({wide_sql('known_t10', 'id', K, 'a / b', 't')}) UNION ALL SELECT 'none' AS batch, * FROM ({wide_sql('none_t10', 'id', K, 'a / b', 't')})")
def r3_regression_cbind(spark: SparkSession, d: str) -> DataFrame:
    """Cells with and without a known batch as two matrices."""
    c, cells = y(spark, d), v.cells(spark, d)
    part = lambda cond: c.join(cells.where(cond).select("col_id"), "col_id", "left_semi")
    out = recal.pmf_regression_cbind({"known": part("batch <> 'none'"), "none": part("batch = 'none'")}, v.dictionary(spark, d), K)
    return wide(out, ["batch", "id"], "theta", K, "t")


_LX = f"{v.long_loadings()}, {X10}, cs AS (SELECT id, max(struct_pack(a := fitted_at, b := log_theta, c := colsum)).c AS colsum FROM loading GROUP BY id), r AS (SELECT l.id, k, v AS lp, colsum AS ysum FROM l JOIN cs ON cs.id = l.id WHERE colsum IS NOT NULL)"


@query(f"WITH {_LX}, {theta_sql(2, False)} {wide_sql('t2', 'id', 10, 'a / b', 't')}")
def r4_topic_pmf(spark: SparkSession, d: str) -> DataFrame:
    """Loadings from given correlations (the stored logarithms) and column sums."""
    from trigrid.functions.leaves import usable
    from trigrid.runtime import current_rows

    c = current_rows(v.table(spark, d, "loading"), ["id"], "fitted_at", ["log_theta", "colsum"]).where(usable(F.col("log_theta"), 10) & F.col("colsum").isNotNull())
    beta = v.dictionary(spark, d, 10).withColumn("v", F.transform("v", lambda x: F.exp(x)))
    out = recal.topic_pmf(beta, c.select("id", F.col("log_theta").alias("v"), F.col("colsum").alias("ysum")), 10, iterations=2, stretch_r=False)
    return wide(out, ["id"], "theta", 10, "t")


_R5 = f"{Y}, {X}, s AS (SELECT row_id % 2 AS view, col_id AS id, k, sum(value * v) / greatest(sum(value), 1e0) AS v, sum(value) AS ysum FROM y JOIN x USING (row_id) GROUP BY 1, 2, 3), sx AS (SELECT view * 1000000000 + id AS id, k, v, ysum FROM s), {v.softmax_sql('sx', 'rv')}"


def _views(spark: SparkSession, d: str) -> dict:
    c, b = y(spark, d), v.dictionary(spark, d)
    return {str(i): (c.where(F.col("row_id") % 2 == i), b.where(F.col("row_id") % 2 == i)) for i in (0, 1)}


@query(f"WITH {_R5}, o AS (SELECT CAST(id // 1000000000 AS VARCHAR) AS view, id % 1000000000 AS id, k, lp FROM rv) {wide_sql('o', 'view, id', K, 'lp', 'r')}")
def r5_stat_rbind(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of two views: odd and even features."""
    return wide(recal.pmf_stat_rbind(_views(spark, d), K), ["view", "id"], "v", K, "r")


@query(f"WITH {_R5}, o AS (SELECT id % 1000000000 AS id, k, sum(lp) AS v, sum(ysum) AS ysum FROM rv GROUP BY 1, 2), {v.standard_sql('o', 'oz')}, {theta_sql(2, False, 'oz', 'bs', 'z')} {wide_sql('t2', 'id', K, 'a / b', 't')}")
def r6_topic_rbind(spark: SparkSession, d: str) -> DataFrame:
    """Loadings shared by the two views."""
    views = _views(spark, d)
    betas = {n: b.withColumn("v", F.transform("v", lambda x: F.exp(x))) for n, (_, b) in views.items()}
    out = recal.topic_pmf_rbind(betas, recal.pmf_stat_rbind(views, K), K, iterations=2)
    return wide(out, ["id"], "theta", K, "t")


# ---- factorisation ----

_INIT = f"""beta AS (SELECT row_id, k, CAST((row_id * (3 + k) + k) % 11 + 1 AS DOUBLE) AS a, 2e0 AS b FROM (SELECT DISTINCT row_id FROM y), range(1, {K + 1}) t(k)),
theta AS (SELECT col_id, k, CAST((col_id * (5 + k) + k) % 7 + 1 AS DOUBLE) AS a, 3e0 AS b FROM (SELECT DISTINCT col_id FROM y), range(1, {K + 1}) t(k))"""


def _init(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    make = lambda key, m, p, q: c.select(key).distinct().select(key, F.array(*[((F.col(key) * (m + i) + i) % p + 1).cast("double") for i in range(1, K + 1)]).alias("a"), F.array_repeat(F.lit(q), K).alias("b"))
    return make("row_id", 3, 11, 2.0), make("col_id", 5, 7, 3.0)


def _half_sql(own: str, other: str, mine: str, theirs: str, out: str, stdize: bool) -> str:
    s = f"""{out}_s AS (SELECT {own}, k, sum(value * ({digamma_sql('a')} - ln(b))) / greatest(sum(value), 1e0) AS s, sum(value) AS ysum FROM y JOIN {theirs} USING ({other}) GROUP BY {own}, k),
{out}_l AS (SELECT p.{own}, p.k, ysum, s + {digamma_sql('a')} - ln(b) AS v FROM {mine} p JOIN {out}_s USING ({own}, k))"""
    src = f"{out}_l"
    if stdize:
        s += f", {v.standard_sql(src, f'{out}_z', own)}, {out}_w AS (SELECT * REPLACE (z AS v) FROM {out}_z)"
        src = f"{out}_w"
    return s + f", {v.softmax_sql(src, f'{out}_p', own)}, {out}_r AS (SELECT k, sum(a / b) AS rate FROM {theirs} GROUP BY k), {out} AS (SELECT {own}, k, 1e0 + ysum * exp(lp) AS a, 1e0 + rate AS b FROM {out}_p JOIN {out}_r USING (k))"


_F8 = f"{Y}, {_INIT}, {_half_sql('col_id', 'row_id', 'theta', 'beta', 'th', True)}"
_F9 = f"{_F8}, {_half_sql('row_id', 'col_id', 'beta', 'th', 'be', False)}"


@query(f"WITH {_F8} {wide_sql('th', 'col_id', K, 'a / b', 't')}")
def f8_column_update(spark: SparkSession, d: str) -> DataFrame:
    c = y(spark, d)
    beta, theta = _init(c)
    out = pmf.half_step(c, "col_id", "row_id", beta, theta, K, True)
    return wide(out.withColumn("m", F.zip_with("a", "b", lambda a, b: a / b)), ["col_id"], "m", K, "t")


def _f9(spark: SparkSession, d: str):
    c = y(spark, d)
    beta, theta = _init(c)
    th = materialize(pmf.half_step(c, "col_id", "row_id", beta, theta, K, True), "theta")[0]
    return c, materialize(pmf.half_step(c, "row_id", "col_id", th, beta, K, False), "beta")[0], th


@query(f"WITH {_F9} {wide_sql('be', 'row_id', K, 'a / b', 'b')}")
def f9_row_update(spark: SparkSession, d: str) -> DataFrame:
    return wide(_f9(spark, d)[1].withColumn("m", F.zip_with("a", "b", lambda a, b: a / b)), ["row_id"], "m", K, "b")


@query(f"WITH {_F9}, lam AS (SELECT y.row_id, y.col_id, y.value, sum(be.a / be.b * (th.a / th.b)) AS l FROM y JOIN be USING (row_id) JOIN th ON th.col_id = y.col_id AND th.k = be.k GROUP BY 1, 2, 3), w AS (SELECT sum(bs * ts) AS w FROM (SELECT k, sum(a / b) AS bs FROM be GROUP BY k) JOIN (SELECT k, sum(a / b) AS ts FROM th GROUP BY k) USING (k)) SELECT round((sum(value * ln(greatest(l, 1e-8))) - max(w)) / ((SELECT count(DISTINCT row_id) FROM y) * CAST((SELECT count(DISTINCT col_id) FROM y) AS DOUBLE)), 8) AS llik FROM lam, w")
def f7_likelihood(spark: SparkSession, d: str) -> DataFrame:
    c, beta, theta = _f9(spark, d)
    return pmf.likelihood(c, beta, theta, K, beta.count(), theta.count()).select(F.round("llik", 8).alias("llik"))


@query()
def f1_fit_distributed(spark: SparkSession, d: str) -> DataFrame:
    """Ten rounds over all triplets: the loadings."""
    c = y(spark, d)
    _, theta, _ = pmf.fit_distributed(c, c.select("row_id"), c.select("col_id"), K, 10)
    return theta


@query()
def f2_fit_cbind_distributed(spark: SparkSession, d: str) -> DataFrame:
    """Cells with and without a known batch, all triplets: the shared dictionary."""
    c, cells = y(spark, d), v.cells(spark, d)
    part = lambda cond: materialize(c.join(cells.where(cond).select("col_id"), "col_id", "left_semi"), "part")[0]
    parts = {"known": part("batch <> 'none'"), "none": part("batch = 'none'")}
    beta, _, _ = pmf.fit_cbind_distributed(parts, c.select("row_id"), {t: x.select("col_id") for t, x in parts.items()}, K)
    return beta


@query()
def f3_fit_rbind_distributed(spark: SparkSession, d: str) -> DataFrame:
    """Odd and even features of the same cells, all triplets: the shared loadings."""
    c = y(spark, d)
    parts = {str(i): c.where(F.col("row_id") % 2 == i) for i in (0, 1)}
    _, theta, _ = pmf.fit_rbind_distributed(parts, {t: x.select("row_id") for t, x in parts.items()}, c.select("col_id"), K)
    return theta


@query()
def f4_fit_delta_distributed(spark: SparkSession, d: str) -> DataFrame:
    """All triplets with one other matrix of the same shape (roots of the counts): its delta."""
    c = y(spark, d)
    other = c.withColumn("value", F.sqrt("value"))
    _, _, delta, _ = pmf.fit_delta_distributed(c, {"roots": other}, c.select("row_id"), c.select("col_id"), K)
    return delta["roots"]


@query()
def f5_fit_larch_distributed(spark: SparkSession, d: str) -> DataFrame:
    """All triplets over a tree of four leaves: the loadings."""
    c = y(spark, d)
    return pmf.fit_larch_distributed(c, c.select("row_id"), c.select("col_id"), 2)[1]


def _pb(spark: SparkSession, d: str, only=None) -> np.ndarray:
    """The pseudo-bulk over the recorded buckets, as a small dense matrix: features by buckets."""
    c = v.counts(spark, d)
    c = c if only is None else c.where(only)
    s, n = bulk.bulk_sums(c, v.buckets(spark, d))
    ids = [r[0] for r in n.select("positions").orderBy("positions").collect()]
    at = spark.createDataFrame([(p, i + 1) for i, p in enumerate(ids)], "positions long, col_id long")
    rows = v.table(spark, d, "matrix_rows").agg(F.max("row_id")).first()[0]
    t = s.where(F.col("row_id").between(1, rows)).join(at, "positions").select("row_id", "col_id", F.col("total").alias("value"))
    return pmf.dense(t, rows, len(ids))


def _frame(spark: SparkSession, g: pmf.Gamma, kind: str) -> DataFrame:
    m = g.mean
    return spark.createDataFrame([(kind, i + 1, [float(x) for x in r]) for i, r in enumerate(m)], "factor string, id long, v array<double>")


@query()
def f1_fit(spark: SparkSession, d: str) -> DataFrame:
    f = pmf.fit(_pb(spark, d), 5)
    return _frame(spark, f.beta, "beta").unionByName(_frame(spark, f.theta, "theta"))


@query()
def f10_svd_start(spark: SparkSession, d: str) -> DataFrame:
    """The first beta from singular vectors, and the one drawn from the seed."""
    p = _pb(spark, d)
    drawn, svd = pmf.Gamma(len(p), K, 1.0, 1.0), pmf.Gamma(len(p), K, 1.0, 1.0)
    pmf._start(drawn, np.random.default_rng(1337), 1.0)
    pmf._start_svd(p, svd, 1.0)
    return _frame(spark, drawn, "drawn").unionByName(_frame(spark, svd, "svd"))


@query()
def f2_fit_cbind(spark: SparkSession, d: str) -> DataFrame:
    p = _pb(spark, d)
    f = pmf.fit_cbind([p[:, 0::2], p[:, 1::2]], 4)
    return _frame(spark, f.beta, "beta").unionByName(_frame(spark, f.theta[0], "theta1")).unionByName(_frame(spark, f.theta[1], "theta2"))


@query()
def f3_fit_rbind(spark: SparkSession, d: str) -> DataFrame:
    p = _pb(spark, d)
    f = pmf.fit_rbind([p[0::2], p[1::2]], 4)
    return _frame(spark, f.theta, "theta").unionByName(_frame(spark, f.beta[0], "beta1")).unionByName(_frame(spark, f.beta[1], "beta2"))


@query()
def f4_fit_delta(spark: SparkSession, d: str) -> DataFrame:
    p = _pb(spark, d)
    f = pmf.fit_delta(p, [p * 2, np.sqrt(p)], 4)
    return _frame(spark, f.beta, "beta").unionByName(_frame(spark, f.delta[0], "delta1")).unionByName(_frame(spark, f.delta[1], "delta2"))


@query()
def f5_fit_larch(spark: SparkSession, d: str) -> DataFrame:
    f = pmf.fit_larch(_pb(spark, d), 2)
    return _frame(spark, f.beta, "beta").unionByName(_frame(spark, f.theta, "theta"))


# ---- edges ----

_NORM = "u AS (SELECT row_id, col_id, value / greatest(sqrt(sum(value * value) OVER (PARTITION BY col_id)), 1e-8) * 10000e0 AS value FROM y)"
_SIM = "cs AS (SELECT col_id, sum(value) AS n FROM {t} GROUP BY col_id), n12 AS (SELECT src, dst, sum(a.value * b.value) AS n12 FROM e JOIN {t} a ON a.col_id = src JOIN {t} b ON b.col_id = dst AND b.row_id = a.row_id GROUP BY 1, 2), sim AS (SELECT e.src, e.dst, e.weight, CASE WHEN coalesce(a.n, 0) < 1 OR coalesce(b.n, 0) < 1 THEN 0e0 ELSE coalesce(n12, 0) / (sqrt(a.n) * sqrt(b.n)) END AS similarity FROM e LEFT JOIN n12 USING (src, dst) LEFT JOIN cs a ON a.col_id = e.src LEFT JOIN cs b ON b.col_id = e.dst)"


@query(f"WITH {Y}, {EDGES}, {_SIM.format(t='y')} SELECT src, dst, round(weight, 6) AS weight, round(similarity, 6) AS similarity FROM sim")
def e1_similarity(spark: SparkSession, d: str) -> DataFrame:
    c = y(spark, d)
    return edges.product_similarity(v.edges(spark, d), c, c).select("src", "dst", F.round("weight", 6).alias("weight"), F.round("similarity", 6).alias("similarity"))


_E2 = f"{Y}, {EDGES}, {_SIM.format(t='y')}, ev AS (SELECT src, dst, row_id, sum(value) * max(weight * similarity) AS value FROM (SELECT src, dst, weight, similarity, row_id, value FROM sim JOIN y ON y.col_id = src UNION ALL SELECT src, dst, weight, similarity, row_id, value FROM sim JOIN y ON y.col_id = dst) GROUP BY 1, 2, 3)"


@query(f"WITH {_E2} SELECT row_id, round(sum(value), 2) + 0e0 AS total, count(*) AS n FROM ev GROUP BY row_id")
def e2_edge_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The sum vectors of all edges, totalled by feature."""
    c = y(spark, d)
    e = edges.product_similarity(edges.numbered_edges(v.edges(spark, d)), c, c).withColumn("w", F.col("weight") * F.col("similarity"))
    return edges.edge_vectors(e, c, c).groupBy("row_id").agg(rounded(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query()
def b7_bulk_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.random_bulk_edges(y(spark, d), None, v.edges(spark, d), 4)[0].bulk


@query(f"WITH {Y}, {X}, {_NORM}, {EDGES}, {_SIM.format(t='u')}, {v.standard_sql('x', 'xz', 'row_id')}, ev AS (SELECT src, dst, row_id, sum(value) * max(weight * similarity) AS value FROM (SELECT src, dst, weight, similarity, row_id, value FROM sim JOIN u ON u.col_id = src UNION ALL SELECT src, dst, weight, similarity, row_id, value FROM sim JOIN u ON u.col_id = dst) GROUP BY 1, 2, 3), st AS (SELECT src, dst, k, sum(value * z) / greatest(sum(value), 1e0) AS v FROM ev JOIN xz USING (row_id) GROUP BY 1, 2, 3), al AS (SELECT sim.src, sim.dst, k, coalesce(v, 0) AS v FROM sim CROSS JOIN range(1, {K + 1}) t(k) LEFT JOIN st USING (src, dst, k)) {wide_sql('al', 'src, dst', K, 'v', 'r')}")
def r7_stat_edges(spark: SparkSession, d: str) -> DataFrame:
    return wide(edges.pmf_stat_edges(y(spark, d), None, v.edges(spark, d), v.dictionary(spark, d), K), ["src", "dst"], "v", K, "r")


# ---- graphs of statistics ----


@query()
def g6_bbknn(spark: SparkSession, d: str) -> DataFrame:
    """Batch-balanced neighbours by log theta: the adjusted vectors."""
    a = v.loadings(spark, d).join(v.cells(spark, d).select(F.col("col_id").alias("id"), "batch"), "id")
    return graph.bbknn(a, 10)[0]


_G5 = f"{v.long_loadings()}, {CELLS}, w AS (SELECT l.id, any_value(batch) AS batch, list(v ORDER BY k) AS v FROM l JOIN cells ON cells.col_id = l.id GROUP BY l.id), nn AS (SELECT a.id, b.id AS match, b.batch, sqrt(list_sum(list_transform(range(1, 11), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS distance FROM w a, w b), kn AS (SELECT id, match, distance FROM (SELECT *, row_number() OVER (PARTITION BY id, batch ORDER BY distance, match) AS r FROM nn QUALIFY r <= 3) WHERE id <> match)"


@query(f"WITH RECURSIVE {_G5}, {weights_sql('kn', 'kw')} SELECT id AS src, match AS dst, round(weight, 4) AS weight FROM kw")
def g5_balanced_knn(spark: SparkSession, d: str) -> DataFrame:
    a = v.loadings(spark, d).join(v.cells(spark, d).select(F.col("col_id").alias("id"), "batch"), "id")
    return graph.balanced_knn(materialize(a, "vectors")[0], 10, 3).withColumn("weight", F.round("weight", 4))


@query()
def g7_interacting_two(spark: SparkSession, d: str) -> DataFrame:
    """Cells with a known batch matched with those without, by their statistics."""
    c, cells = y(spark, d), v.cells(spark, d)
    part = lambda cond: materialize(c.join(cells.where(cond).select("col_id"), "col_id", "left_semi"), "part")[0]
    return graph.interacting_columns(part("batch <> 'none'"), part("batch = 'none'"), v.dictionary(spark, d), K, 5)


@query()
def g8_interacting_columns(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the matrix matched with each other by their statistics."""
    return graph.interacting_columns(y(spark, d), None, v.dictionary(spark, d), K, 5)


# ---- clustering and simulation ----


@query()
def c1_cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    """Buckets clustered by their counts over batches: two chains."""
    c = v.cells(spark, d).select(F.col("col_id").alias("id"), "batch")
    n = bulk.batch_sums(v.counts(spark, d), c, v.buckets(spark, d))[1]
    names = [r[0] for r in n.select("batch").distinct().orderBy("batch").collect()]
    rows = n.groupBy(F.col("positions").alias("id")).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("batch") == b, F.col("n").cast("double"))), F.lit(0.0)) for b in names]).alias("v"))
    return cluster.cluster_rows(rows, 5, 2)


@query(f"WITH {BUCKETS} SELECT positions, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, positions) AS rank FROM b WHERE positions IS NOT NULL GROUP BY positions")
def c4_by_size(spark: SparkSession, d: str) -> DataFrame:
    return cluster.by_size(v.buckets(spark, d).where("positions IS NOT NULL"), "positions").withColumn("rank", F.col("rank").cast("long"))


@query()
def c5_categorical(spark: SparkSession, d: str) -> DataFrame:
    """A draw from the topic proportions of every cell."""
    from trigrid.functions.vectors import v_softmax

    return cluster.categorical(v.loadings(spark, d).withColumn("v", v_softmax(F.col("v"))), 10)


@query()
def x1_simulate(spark: SparkSession, d: str) -> DataFrame:
    """As many columns as there are cells, of depths drawn from theirs, with the mean rates of the features."""
    c = v.counts(spark, d)
    n = c.select("col_id").distinct().count()
    rows = v.table(spark, d, "matrix_rows").agg(F.max("row_id")).first()[0]
    mu = np.zeros((rows, 1))
    for r in c.where(F.col("row_id").between(1, rows)).groupBy("row_id").agg(F.sum("value").alias("s")).collect():  # one row for each of a fixed number of features
        mu[r["row_id"] - 1, 0] = r["s"] / n
    return simulate.simulate_poisson(spark, mu, np.linspace(0.5, 1.5, n))[0].coo


@query()
def x2_simulate_mixture(spark: SparkSession, d: str) -> DataFrame:
    rng = np.random.default_rng(1)
    return simulate.simulate_poisson_mixture(spark, [rng.gamma(1, 1, (50, 4)) for _ in range(3)], 500)[0].coo


@query(f"WITH {Y}, n AS (SELECT CAST(max(row_id) AS DOUBLE) AS r FROM y), s AS (SELECT col_id, sum(value) AS s FROM y GROUP BY col_id) SELECT y.row_id, y.col_id, round(value / (s + 1e-8) * r, 6) AS value FROM y JOIN s USING (col_id), n")
def f1_normalized_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns scaled to add up to the number of rows, as a fit takes them."""
    c = v.counts(spark, d)
    r = c.agg(F.max("row_id")).first()[0]
    s = c.groupBy("col_id").agg(F.sum("value").alias("__s"))
    return c.join(s, "col_id").select("row_id", "col_id", F.round(F.col("value") / (F.col("__s") + 1e-8) * F.lit(float(r)), 6).alias("value"))

