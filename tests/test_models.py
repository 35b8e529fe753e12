from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trigrid import MatrixSet
from trigrid.functions import leaves, numeric
from trigrid.operators import bulk, cluster, edges, graph, pmf, recal, simulate


def coo_of(spark, y):
    r, c = np.nonzero(y)
    return spark.createDataFrame(pd.DataFrame({"row_id": r + 1, "col_id": c + 1, "value": y[r, c].astype(float)})).repartition(4)


def dictionary_of(spark, x):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(np.asarray(x, float).tolist())], "row_id long, v array<double>")


def arrays(df, key="id", v="v"):
    return np.array([r[v] for r in df.orderBy(key).collect()])


def planted(seed=1331, d=60, n=300, k=3):
    rng = np.random.default_rng(seed)
    beta, theta = rng.gamma(0.3, 1, (d, k)), rng.gamma(0.3, 1, (n, k))
    return rng.poisson(beta @ theta.T * 5), beta, theta


def matched(a, b):
    """The mean over planted factors of the best correlation."""
    c = np.corrcoef(a.T, b.T)[: a.shape[1], a.shape[1] :]
    return np.nan_to_num(c).max(0).mean()


def test_fit_recovers_factors():
    y, beta, theta = planted()
    f = pmf.fit(y, 3, 100)
    assert matched(f.beta.mean, beta) > 0.8 and matched(f.theta.mean, theta) > 0.8
    assert np.isfinite(f.llik).all() and f.llik[-1] > f.llik[0]
    assert pmf.fit(y, 500, 2).beta.shape[1] == 60
    assert np.isfinite(pmf.fit(y, 3, 5, svd_init=True, degree=True, normalize=True, log1p=True).llik).all()


def test_fits_of_several_matrices_recover_factors():
    y, beta, theta = planted()
    f = pmf.fit_cbind([y[:, :150], y[:, 150:]], 3, 60)
    assert matched(f.beta.mean, beta) > 0.8 and matched(f.theta[1].mean, theta[150:]) > 0.7
    f = pmf.fit_rbind([y[:30], y[30:]], 3, 60)
    assert matched(f.theta.mean, theta) > 0.8
    f = pmf.fit_delta(y, [y * 3], 3, 60)
    assert matched(f.beta.mean, beta) > 0.7 and len(f.delta) == 1
    with pytest.raises(ValueError):
        pmf.fit_delta(y, [y[:5]], 3)
    f = pmf.fit_larch(y, 2, 40)
    assert f.beta.shape == (60, 7) and f.theta.shape == (300, 4) and np.isfinite(f.llik).all() and f.llik[-1] > f.llik[0]
    with pytest.raises(ValueError):
        pmf.fit_larch(y[:3], 3)


def test_half_steps_agree_with_numpy(spark):
    y, *_ = planted(n=80)
    rng = np.random.default_rng(0)
    k = 3
    beta, theta = pmf.Gamma(60, k, 1, 1), pmf.Gamma(80, k, 1, 1)
    beta.set(rng.gamma(1, 1, beta.shape), np.ones(beta.shape))
    theta.set(rng.gamma(1, 1, theta.shape), np.ones(theta.shape))
    to = lambda g, key: spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(zip(g.a.tolist(), g.b.tolist(), strict=True))], f"{key} long, a array<double>, b array<double>")
    coo = coo_of(spark, y)
    for stdize in (False, True):
        got = pmf.half_step(coo, "col_id", "row_id", to(beta, "row_id"), to(theta, "col_id"), k, stdize)
        z = y.T @ beta.log_mean / np.maximum(y.sum(0), 1)[:, None] + theta.log_mean
        rho = np.exp(numeric.log_softmax(numeric.standardize(z) if stdize else z))
        assert np.allclose(arrays(got, "col_id", "a"), 1 + y.sum(0)[:, None] * rho, atol=1e-6)
        assert np.allclose(arrays(got, "col_id", "b"), 1 + beta.mean.sum(0))
    got = pmf.likelihood(coo, to(beta, "row_id"), to(theta, "col_id"), k, 60, 80).first()[0]
    assert got == pytest.approx(pmf.log_likelihood(y, beta.mean, theta.mean), rel=1e-9)


def test_distributed_fit_recovers_factors(spark):
    y, beta, _ = planted(n=200)
    coo = coo_of(spark, y)
    ids = lambda n, c: spark.range(1, n + 1).withColumnRenamed("id", c)
    b, t, trace = pmf.fit_distributed(coo, ids(60, "row_id"), ids(200, "col_id"), 3, 15)
    mean = arrays(b, "row_id", "a") / arrays(b, "row_id", "b")
    assert mean.shape == (60, 3) and t.count() == 200 and matched(mean, beta) > 0.6 and np.isfinite(trace).all()


def numpy_theta(log_beta, r, ysum, iterations, stretch):
    from tests.test_numbers import stretched

    a = np.ones_like(r)
    b = np.ones_like(r)
    x = np.outer(ysum / len(log_beta), np.exp(log_beta).sum(0))
    for _ in range(iterations):
        z = r + numeric.digamma(a) - np.log(b)
        rho = np.exp(numeric.log_softmax(stretched(z) if stretch else z))
        a, b = 1 + ysum[:, None] * rho, 1 + x
    return a / b


@pytest.mark.parametrize("stretch", [False, True])
def test_recalibration_agrees_with_numpy(spark, stretch):
    y, beta, _ = planted(n=70)
    y[:, 0] = 0
    log_beta = np.log(beta + 0.01)
    cols = spark.range(1, 71).withColumnRenamed("id", "col_id")
    out = recal.pmf_regression(coo_of(spark, y), dictionary_of(spark, log_beta), 3, stretch_beta=False, stretch_r=stretch, iterations=4, columns=cols, extra_stretch=False)
    r = numeric.log_softmax(y.T @ log_beta / np.maximum(y.sum(0), 1)[:, None])
    assert np.allclose(arrays(out, v="corr"), r, atol=1e-8)
    assert np.allclose(arrays(out, v="theta"), numpy_theta(log_beta, r, y.sum(0), 4, stretch), atol=1e-6)


def test_recalibration_finds_topics(spark):
    y, beta, theta = planted(n=250)
    log_beta = np.log(beta + 1e-3)
    coo, b = coo_of(spark, y), dictionary_of(spark, log_beta)
    out = recal.pmf_regression(coo, b, 3, iterations=5)
    got = {r["id"]: r["theta"] for r in out.collect()}
    ids = sorted(got)
    assert matched(np.array([got[i] for i in ids]), theta[np.array(ids) - 1]) > 0.5
    delta = dictionary_of(spark, np.random.default_rng(0).normal(0, 1, (60, 2)))
    assert recal.pmf_regression(coo, b, 3, delta, 2, iterations=2).count() == len(ids)
    two = recal.pmf_regression_cbind({"p": coo, "q": coo}, b, 3, delta, 2, iterations=2)
    assert two.groupBy("batch").count().count() == 2


def test_buckets_by_first_appearance(spark):
    v = [[1.0, -1.0], [1.0, 1.0], [-1.0, -1.0], [1.0, -1.0], [0.0, 0.0]]
    df = spark.createDataFrame([(i * 10, x) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    got = [r["positions"] for r in bulk.bucketize(df, 2).orderBy("id").collect()]
    assert got == [1, 2, 3, 1, 3]
    assert [r["positions"] for r in bulk.bucketize(df, 2, drop_last=True).orderBy("id").collect()] == [1, 2, None, 1, None]
    few = bulk.bucketize(df, 2, down=True, per_sample=1)
    assert few.where("positions IS NULL").count() == 2 and few.count() == 5


def test_random_bulk_keeps_totals(spark):
    y, *_ = planted()
    m = MatrixSet.from_table(coo_of(spark, y), "row_id", "col_id", "value")
    b = bulk.random_bulk(m, 4)
    assert b.sums.agg(F.sum("total")).first()[0] == y.sum()
    assert b.sizes.agg(F.sum("size")).first()[0] == (y.sum(0) > 0).sum()
    size = {r["positions"]: r["size"] for r in b.sizes.collect()}
    total = {(r["row_id"], r["positions"]): r["total"] for r in b.sums.collect()}
    assert all(abs(r["mean"] - (1e-8 + total[r["row_id"], r["positions"]]) / (1 + size[r["positions"]])) < 1e-9 for r in b.bulk.collect())
    again = bulk.random_bulk(MatrixSet(m.coo.repartition(7), m.rows, m.cols), 4)
    assert sorted(map(tuple, again.positions.collect())) == sorted(map(tuple, b.positions.collect()))
    cov = spark.createDataFrame([(i + 1, [float(i)]) for i in range(300)], "id long, v array<double>")
    assert bulk.random_bulk(m, 4, weighted=True, log1p=True, covariates=cov, n_covariates=1, down=True, per_sample=10).sizes.agg(F.max("size")).first()[0] <= 10
    views, names = bulk.random_bulk_rbind([m, m], 4)
    assert len(views) == 2 and views[0].sums.agg(F.sum("total")).first()[0] == y.sum() and names.count() == m.cols.count()


def numpy_adjust(y, z, size, n_bs, ds, iterations, a0=1.0, b0=1.0):
    delta, gamma = np.ones_like(ds), np.ones_like(y)
    for _ in range(iterations):
        mu = (a0 + y + z) / (b0 + delta @ n_bs + gamma * size)
        gamma = (a0 + z) / (b0 + mu * size)
        delta = (a0 + ds) / (b0 + mu @ n_bs.T)
    return mu, gamma, delta


def test_batch_adjustment(spark):
    """A planted batch effect on some features: the estimated effect agrees with it."""
    rng = np.random.default_rng(1331)
    d, n = 80, 400
    beta, theta = rng.gamma(1, 1, (d, 3)), rng.gamma(1, 1, (n, 3))
    batch = rng.integers(0, 2, n)
    effect = np.ones((d, 2))
    effect[:30, 1] = 6.0
    y = rng.poisson(beta @ theta.T * effect[:, batch])
    coo = coo_of(spark, y)
    cells = spark.createDataFrame([(i + 1, f"b{b}") for i, b in enumerate(batch)], "id long, batch string")
    rows = spark.range(1, d + 1).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("name"))
    out = bulk.random_bulk_cbind(coo, rows, cells, 4, knn=5, down=False, iterations=50, normalize_matched=True)
    e = {(r["row_id"], r["batch"]): r["delta"] for r in out.effect.collect()}
    ratio = np.array([e[i + 1, "b1"] / e[i + 1, "b0"] for i in range(d)])
    assert np.median(ratio[:30]) > 2 * np.median(ratio[30:])
    s = out.bulk.groupBy("positions").count().collect()
    assert all(r["count"] == d for r in s)
    controls = spark.createDataFrame([(str(i),) for i in range(1, 21)], "name string")
    assert bulk.random_bulk_cbind(coo, rows, cells, 4, controls=controls, adjust=False).effect is None


def test_adjustment_agrees_with_numpy(spark):
    rng = np.random.default_rng(3)
    y, z, ds = rng.gamma(1, 5, (6, 4)), rng.gamma(1, 5, (6, 4)), rng.gamma(1, 5, (6, 2))
    size, n_bs = np.array([3.0, 4, 5, 6]), np.array([[1.0, 2, 3, 3], [2, 2, 2, 3]])
    long = lambda x, c, names: spark.createDataFrame([(i + 1, names[j], float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1])], f"row_id long, {c}, total double")
    p = [1, 2, 3, 4]
    sizes = spark.createDataFrame(list(zip(p, size.tolist(), strict=True)), "positions long, size double")
    nb = spark.createDataFrame([(b, p[j], float(n_bs[i, j])) for i, b in enumerate("uv") for j in range(4)], "batch string, positions long, n double")
    got, effect = bulk.adjust_batches(long(y, "positions long", p), long(z, "positions long", p), sizes, nb, long(ds, "batch string", "uv"), iterations=20)
    mu, gamma, delta = numpy_adjust(y, z, size, n_bs, ds, 20)
    at = {(r["row_id"], r["positions"]): (r["mu"], r["gamma"]) for r in got.collect()}
    assert all(np.allclose(at[i + 1, j + 1], (mu[i, j], gamma[i, j])) for i in range(6) for j in range(4))
    e = {(r["row_id"], r["batch"]): r["delta"] for r in effect.collect()}
    assert all(e[i + 1, "uv"[j]] == pytest.approx(delta[i, j]) for i in range(6) for j in range(2))


def test_several_matrices_agree_with_numpy(spark):
    """Two rounds of the distributed fits of matrices beside and above each other, from the same start."""
    rng = np.random.default_rng(4)
    k, y = 3, rng.poisson(2.0, (14, 20)).astype(float)
    y[3] = 0
    to = lambda key, a, b: spark.createDataFrame([(i + 1, p, q) for i, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True))], f"{key} long, a array<double>, b array<double>")
    ids = lambda key, n: spark.range(1, n + 1).withColumnRenamed("id", key)
    make = lambda n: (rng.gamma(2, 1, (n, k)) + 0.5, rng.gamma(2, 1, (n, k)) + 0.5)
    log = lambda g: numeric.digamma(g[0]) - np.log(g[1])
    mean = lambda g: g[0] / g[1]
    rho = lambda z, std: np.exp(numeric.log_softmax(numeric.standardize(z) if std else z))
    half = lambda m, f, p, std: (m.sum(1)[:, None] * rho(m @ log(f) / np.maximum(m.sum(1), 1)[:, None] + log(p), std), np.ones((len(m), 1)) * mean(f).sum(0))

    def check(got, want, key):
        for r in got.collect():
            assert np.allclose(r["a"], want[0][r[key] - 1]) and np.allclose(r["b"], want[1][r[key] - 1])

    parts = {"p": y[:, :12], "q": y[:, 12:]}
    beta, theta = make(14), {t: make(m.shape[1]) for t, m in parts.items()}
    out = pmf.fit_cbind_distributed({t: coo_of(spark, m) for t, m in parts.items()}, ids("row_id", 14), {t: ids("col_id", m.shape[1]) for t, m in parts.items()}, k, 2, start=(to("row_id", *beta), {t: to("col_id", *g) for t, g in theta.items()}))
    for _ in range(2):
        a, b = np.ones_like(beta[0]), np.ones_like(beta[1])
        for t, m in parts.items():
            theta[t] = tuple(1 + x for x in half(m.T, beta, theta[t], True))
            x = half(m, theta[t], beta, False)
            a, b = a + x[0], b + x[1]
        beta = (a, b)
    check(out[0], beta, "row_id")
    check(out[1]["q"], theta["q"], "col_id")

    parts = {"p": y[:8], "q": y[8:]}
    theta, betas = make(20), {t: make(len(m)) for t, m in parts.items()}
    out = pmf.fit_rbind_distributed({t: coo_of(spark, m) for t, m in parts.items()}, {t: ids("row_id", len(m)) for t, m in parts.items()}, ids("col_id", 20), k, 2, start=({t: to("row_id", *g) for t, g in betas.items()}, to("col_id", *theta)))
    for _ in range(2):
        prior, total = theta, (np.ones_like(theta[0]), np.ones_like(theta[1]))
        for t, m in parts.items():
            x = half(m.T, betas[t], prior, False)
            prior = total = (total[0] + x[0], total[1] + x[1])
            betas[t] = tuple(1 + z for z in half(m, total, betas[t], True))
        theta = total
    check(out[1], theta, "col_id")
    check(out[0]["p"], betas["p"], "row_id")


def test_delta_and_tree_agree_with_numpy(spark):
    """Two rounds of the distributed fits with delta and over a tree, from the start that the fits on the driver draw."""
    rng = np.random.default_rng(6)
    to = lambda key, g: spark.createDataFrame([(i + 1, p, q) for i, (p, q) in enumerate(zip(g.a.tolist(), g.b.tolist(), strict=True))], f"{key} long, a array<double>, b array<double>")
    ids = lambda key, n: spark.range(1, n + 1).withColumnRenamed("id", key)

    def check(got, want, key):
        for r in got.collect():
            assert np.allclose(r["a"], want.a[r[key] - 1]) and np.allclose(r["b"], want.b[r[key] - 1])

    for d, n in ((9, 16), (16, 9)):
        ref, y = rng.poisson(2.0, (d, n)).astype(float), rng.poisson(3.0, (d, n)).astype(float)
        k = 3
        want = pmf.fit_delta(ref, [y, ref * 2], k, 2, eps=0.0)
        beta = pmf.Gamma(d, k, 1.0, 1.0)
        pmf._start(beta, np.random.default_rng(1337), 1.0)
        flat = lambda m: pmf.Gamma(m, k, 1.0, 1.0)
        b, t, deltas, llik = pmf.fit_delta_distributed(coo_of(spark, ref), {"p": coo_of(spark, y), "q": coo_of(spark, ref * 2)}, ids("row_id", d), ids("col_id", n), k, 2, start=(to("row_id", beta), to("col_id", flat(n)), {"p": to("row_id", flat(d)), "q": to("row_id", flat(d))}))
        check(b, want.beta, "row_id")
        check(t, want.theta, "col_id")
        check(deltas["p"], want.delta[0], "row_id")
        check(deltas["q"], want.delta[1], "row_id")
        assert llik[-1] == pytest.approx(want.llik[-1])
        want = pmf.fit_larch(y, 2, 2, eps=0.0)
        beta = pmf.Gamma(d, 7, 1.0, 1.0)
        pmf._start(beta, np.random.default_rng(1337), 1.0)
        b, t, llik = pmf.fit_larch_distributed(coo_of(spark, y), ids("row_id", d), ids("col_id", n), 2, 2, start=(to("row_id", beta), to("col_id", pmf.Gamma(n, 4, 1.0, 1.0))))
        check(b, want.beta, "row_id")
        check(t, want.theta, "col_id")
        assert llik[-1] == pytest.approx(want.llik[-1])


def points(spark, x, **more):
    extra = [np.asarray(c).tolist() for c in more.values()]
    rows = list(zip(range(1, len(x) + 1), np.asarray(x, float).tolist(), *extra, strict=True))
    return spark.createDataFrame(rows, ", ".join(["id long", "v array<double>", *(f"{c} string" for c in more)])).repartition(3)


def test_neighbours_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (250, 4))
    x[10] = x[11] = x[12]  # ties go to the smaller id
    b = np.array(["a", "b", "c"])[rng.integers(0, 3, 250)]
    df = points(spark, x, batch=b)
    got = {}
    for r in graph.k_nearest(df, df, 4, 3, by="batch", probe_share=1.0).collect():
        got.setdefault((r["id"], r["batch"]), set()).add(r["match"])
    for i in range(250):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        for g in "abc":
            j = np.flatnonzero(b == g)
            want = j[np.lexsort((j, d[j]))][:3] + 1
            assert got[i + 1, g] == set(want.tolist())
    other = graph.k_nearest(df, df, 4, 3, by="batch", other_only=True, probe_share=1.0)
    at = dict(zip(range(1, 251), b, strict=True))
    assert all(r["batch"] != at[r["id"]] for r in other.collect()) and other.count() == 250 * 6
    assert graph.k_nearest(df, df.limit(0), 4, 3).count() == 0


@pytest.mark.parametrize("other_only", [False, True])
def test_neighbours_of_shifted_batches(spark, monkeypatch, other_only):
    """By default every query has its true neighbours in each batch, however far from it the batch lies, and however small it is."""
    monkeypatch.setattr(leaves.centroids, "__defaults__", (60, 7))
    monkeypatch.setattr(leaves.Leaves.__init__, "__defaults__", (60, 4096))
    rng = np.random.default_rng(12)
    n, names = [500, 400, 60, 2], ["a", "b", "c", "none"]
    x = np.concatenate([rng.normal(0, 1, (m, 5)) + 6 * i for i, m in enumerate(n)])
    b = np.repeat(names, n)
    df = spark.createDataFrame([(i + 1, v, g) for i, (v, g) in enumerate(zip(x.tolist(), b.tolist(), strict=True))], "id long, v array<double>, batch string").repartition(3)
    got = {}
    for r in graph.k_nearest(df, df, 5, 3, by="batch", other_only=other_only).collect():
        got.setdefault((r["id"], r["batch"]), set()).add(r["match"])
    want = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        for g in names:
            if not (other_only and g == b[i]):
                j = np.flatnonzero(b == g)
                want[i + 1, g] = set((j[np.lexsort((j, d[j]))][:3] + 1).tolist())
    assert got == want


def test_weights():
    d = np.array([[1.0, 1.2, 2.0, 5.0], [0.3, np.inf, np.inf, np.inf], [1.0, 1.0, np.inf, np.inf]])
    w = graph.weights_of(d, np.array([4, 1, 2]))
    assert abs(w[0].sum() - 2) < 0.15 and w[0, 0] == 1 and (np.diff(w[0]) < 0).all()
    assert w[1].tolist() == [1, 0, 0, 0] and w[2].tolist() == [1, 1, 0, 0]


def test_edges_of_graphs(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (1, 3, 1.0), (4, 4, 9.0), (2, 3, 0.1), (2, 3, 0.1)], "src long, dst long, weight double")
    assert sorted(tuple(r)[:2] for r in graph.keep_reciprocal(e).collect()) == [(1, 2), (2, 1), (2, 3), (2, 3)]
    assert sorted(map(tuple, graph.keep_reciprocal(e, True).collect())) == [(1, 2, 0.75), (2, 3, 0.2)]
    s = {(r["src"], r["dst"]): r["weight"] for r in graph.symmetric(e).collect()}
    assert s[1, 2] == s[2, 1] == 0.375 and s[4, 4] == 9.0 and s[3, 1] == 0.5
    p = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 7)], "id long, positions long")
    assert {(r["s"], r["t"]): round(r["weight"], 6) for r in graph.collapse_network(e, p, 2).collect()} == {(1, 1): 0.75, (1, 2): 1.2}
    b = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.0, 3.0])], "row_id long, v array<double>")
    assert {(r["src"], r["dst"]): r["topic"] for r in graph.decompose_network(e, b).collect()} == {(1, 2): 1, (2, 1): 1, (1, 3): 2, (2, 3): 2}


def test_batches_move_together(spark):
    rng = np.random.default_rng(7)
    group = rng.integers(0, 8, 300)
    x = rng.normal(0, 3, (8, 5))[group] + rng.normal(0, 0.1, (300, 5))
    b = np.array(["a", "b"])[rng.integers(0, 2, 300)]
    x[b == "b"] += 0.7
    df = points(spark, x, batch=b)
    adjusted, g, after = graph.bbknn(df, 5, 3, 1.0)
    y = arrays(adjusted)
    # by planted group, as batches differ in how many cells of each group they have
    gap = lambda z: np.mean([np.linalg.norm(z[(b == "a") & (group == i)].mean(0) - z[(b == "b") & (group == i)].mean(0)) for i in range(8)])
    assert gap(y) < 0.5 * gap(x) and np.allclose(y[b == "a"], x[b == "a"])
    w = {(r["src"], r["dst"]): r["weight"] for r in after.collect()}
    assert all(abs(w[i, j] - w[j, i]) < 1e-9 for i, j in w) and g.count() > 0


def test_edge_vectors(spark):
    rng = np.random.default_rng(8)
    y = rng.poisson(1.0, (12, 10)).astype(float)
    a = np.triu(rng.gamma(1, 1, (12, 12)) * (rng.random((12, 12)) < 0.3))
    coo = coo_of(spark, y)
    net = spark.createDataFrame([(int(i) + 1, int(j) + 1, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "src long, dst long, weight double")
    e = spark.createDataFrame([(1, 2, 0.5), (3, 3, 1.0), (4, 9, 2.0)], "src long, dst long, weight double")
    named = edges.product_similarity(edges.numbered_edges(e), coo, coo).withColumn("w", F.col("weight") * F.col("similarity"))
    for product in (False, True):
        for network in (None, net):
            m = np.eye(12) if network is None else a
            got = {}
            for r in edges.edge_vectors(named, coo, coo, network, product).join(named.withColumnRenamed("edge", "col_id"), "col_id").collect():
                got.setdefault((r["src"], r["dst"]), np.zeros(12))[r["row_id"] - 1] = r["value"]
            for s, t, w in ((1, 2, 0.5), (3, 3, 1.0), (4, 9, 2.0)):
                y1, y2 = y[:, s - 1], y[:, t - 1]
                sim = y1 @ y2 / np.sqrt(y1.sum() * y2.sum())
                want = (y1 * (m @ y2) + y2 * (m @ y1) if product else y1 + m @ y2 + y2 + m @ y1) / 2 * w * sim
                assert np.allclose(got.get((s, t), np.zeros(12)), want)
    assert edges.random_bulk_edges(coo, None, e, 2)[0].sizes.agg(F.sum("size")).first()[0] == 3
    stat = edges.pmf_stat_edges(coo, None, e, dictionary_of(spark, rng.normal(0, 1, (12, 2))), 2)
    assert stat.count() == 3 and all(r["colsum"] >= 1 for r in stat.collect())


def test_clusters_of_rows(spark):
    rng = np.random.default_rng(9)
    truth = rng.integers(0, 3, 45)
    x = rng.poisson(np.array([[20, 1, 1, 5], [1, 20, 1, 5], [1, 1, 20, 5]])[truth]).astype(float)
    out = cluster.gibbs(x, 5, mcmc=30, burnin=10)
    found = out["latent"].argmax(1)
    assert all(len(set(truth[found == c])) == 1 for c in set(found)) and len(out["elbo"]) == 40
    assert np.isfinite(cluster.gibbs(x, 4, mcmc=5, burnin=2, use_prior=True)["elbo"]).all()
    c = cluster.Component(4, 0.01, 0.0001)
    c.add(x[0])
    before = c.log_predictive(x[0])
    c.add(x[1])
    c.remove(x[1])
    assert c.log_predictive(x[0]) == before and len(c.mean()) == len(c.log_mean()) == 4
    labels = cluster.cluster_rows(points(spark, x), 5, 2, mcmc=5, burnin=2)
    assert labels.count() == 90
    sizes = cluster.by_size(labels).orderBy("rank").collect()
    assert [r["size"] for r in sizes] == sorted((r["size"] for r in sizes), reverse=True)
    assert len(cluster.text_histogram(labels)) == len(sizes)


def test_categorical_frequencies(spark):
    p = [0.1, 0.6, 0.3]
    df = spark.range(6000).select("id", F.array(*[F.lit(x) for x in p]).alias("v"))
    n = {r["draw"]: r["count"] / 6000 for r in cluster.categorical(df, 3).groupBy("draw").count().collect()}
    assert all(abs(n[i + 1] - p[i]) < 0.03 for i in range(3))


def test_simulators(spark):
    mu = np.random.default_rng(1).gamma(1, 1, (10, 2))
    m, who = simulate.simulate_poisson(spark, mu, np.array([2.0] * 400), seed=3)
    y = m.coo.groupBy("row_id").agg(F.sum("value").alias("s")).orderBy("row_id").collect()
    share = {r["indv"]: r["count"] for r in who.groupBy("indv").count().collect()}
    want = 2 * (mu[:, 0] * share[1] + mu[:, 1] * share[2])
    assert np.allclose([r["s"] for r in y], want, rtol=0.15)
    again, _ = simulate.simulate_poisson(spark, mu, np.array([2.0] * 400), seed=3)
    assert sorted(map(tuple, again.coo.collect())) == sorted(map(tuple, m.coo.collect()))
    given, who = simulate.simulate_poisson(spark, mu, np.array([1.0, np.inf, 5.0]), [1, 1, 2])
    assert who.count() == given.cols.count() <= 3
    m, who = simulate.simulate_poisson_mixture(spark, [mu, mu * 3], 100)
    assert m.coo.count() > 0 and m.cols.count() == who.count() <= 100
