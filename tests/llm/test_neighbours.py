from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from trigrid.functions import leaves as L
from trigrid.llm import neighbours
from trigrid.llm.neighbours import Block, Codebook, fewest_copies, mutual_pairs, search


@pytest.fixture(scope="module")
def data():
    """Blobs, lone vectors, groups of equal vectors of every size around k."""
    rng = np.random.default_rng(4)
    x = [rng.normal(0, 3, (400, 6))]
    for n in (2, 3, 4, 5, 9, 40, 200):
        x.append(rng.normal(0, 3, 6) + rng.normal(0, 0.03, (n, 6)))
    for n in (2, 3, 4, 5, 30, 300):
        x.append(np.repeat(rng.normal(0, 3, (1, 6)), n, 0))
    x = np.concatenate(x)
    ids = rng.permutation(len(x)) * 3 + 1
    return ids, x


def frame(spark, ids, x):
    return spark.createDataFrame([(i, v, "clash") for i, v in zip(ids.tolist(), x.tolist(), strict=True)], "id long, vec array<double>, leaf string").repartition(4)


def brute_top(ids, x, k):
    out = {}
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        o = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[ids[i]] = [(ids[j], d[j]) for j in o]
    return out


def brute_mutual(ids, x, k, radius):
    top = brute_top(ids, x, k)
    return {(int(a), int(b)) for a in top for b, d in top[a] if a < b and d <= radius**2 and a in [c for c, _ in top[b]]}


@pytest.mark.parametrize(("leaf", "block"), [(1536, 4096), (60, 50)])
def test_mutual_pairs(spark, data, monkeypatch, leaf, block):
    """One leaf, and many leaves and blocks that groups lie across; lossless reach."""
    make = L.Leaves.__init__
    monkeypatch.setattr(L.Leaves, "__init__", lambda self, sample, total, **_: make(self, sample, total, leaf, block))
    ids, x = data
    got = {(r["id_a"], r["id_b"]) for r in mutual_pairs(frame(spark, ids, x), 6, 3, 0.25, len(x), x, lossless=True).collect()}
    assert got == brute_mutual(ids, x, 3, 0.25)


@pytest.mark.parametrize("dims", [2, 6])
def test_dense_group_across_blocks(monkeypatch, dims):
    """A vector's nearest foreign queries come out though it isn't near the top for them: true and no false pairs in a dense group over blocks."""
    rng = np.random.default_rng(3)
    x = np.zeros((900, 6))
    x[:, :dims] = rng.exponential(0.02, (900, dims))
    ids = rng.permutation(900)
    leaves = L.Leaves(x, 900, 10**6)
    leaves.blocks[:] = 3
    book = Codebook(x - leaves.c[leaves.own])
    monkeypatch.setattr(neighbours, "QUERIES", 128)
    routed = pa.Table.from_batches(list(neighbours._route(leaves, 6, 0.25, True, 4, False)([pa.RecordBatch.from_pydict({"id": pa.array(ids), "vec": pa.array(x.tolist())})])))
    look = neighbours._look(leaves, book, 6, 3, 0.25, 4, True)
    near: dict[int, set] = {}
    for block in range(3):
        part = look((pa.scalar(0), pa.scalar(block)), routed.filter(pc.equal(routed.column("block"), block)))
        for a, b, d in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            near.setdefault(a, set()).add((d, b))
            near.setdefault(b, set()).add((d, a))
    top = {a: [b for _, b in sorted(v)[:3]] for a, v in near.items()}
    got = {(a, b) for a in top for b in top[a] if a < b and a in top[b]}
    want = brute_mutual(ids, x, 3, 0.25)
    assert got == want


def test_groups_of_few_directions(spark, monkeypatch):
    """By default nothing is lost where near vectors of many dimensions vary in few, across leaves."""
    make = L.Leaves.__init__
    monkeypatch.setattr(L.Leaves, "__init__", lambda self, sample, total, **_: make(self, sample, total, 20, 4096))
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 3, 24) + rng.normal(0, 0.15, (250, 2)) @ np.linalg.qr(rng.normal(0, 1, (24, 2)))[0].T for _ in range(4)])
    ids = rng.permutation(len(x)) + 1
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "id long, vec array<double>").repartition(4)
    got = {(r["id_a"], r["id_b"]) for r in mutual_pairs(df, 24, 3, 0.05, len(x), x).collect()}
    want = brute_mutual(ids, x, 3, 0.05)
    assert got == want


def test_unit_vectors(spark, data):
    ids, x = data
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r["id_a"], r["id_b"]) for r in mutual_pairs(frame(spark, ids, x), 6, 3, 0.2, len(x), x, unit=True, lossless=True).collect()}
    assert got == brute_mutual(ids, u, 3, 0.2)


@pytest.mark.parametrize(("n", "leaf"), [(6000, 1536), (6000, 200), (500, 1536)])
def test_search_recall(spark, n, leaf):
    """High-dimensional noise without structure is the worst case; recall against brute force reaches 0.9 with few leaves and with many."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (n, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    df = frame(spark, ids, x)
    got = search(df.where("id % 100 = 0"), df, 24, 3, len(x), x[:4000], unit=True, leaves=L.Leaves(x[:4000], len(x), leaf)).collect()
    have = {(r["id_a"], r["id_b"]) for r in got}
    hit = total = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        want = set(np.argsort(d)[:3])
        hit += len({b for a, b in have if a == q} & want)
        total += 3
    assert hit / total >= 0.9
    assert all(sum(a == q for a, _ in have) == 3 for q in range(0, len(x), 100))


def test_probes_follow_the_data(spark):
    """Tight groups need few of many leaves."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 5, (40, 8))[rng.integers(0, 40, 4000)] + rng.normal(0, 0.05, (4000, 8))
    leaves = L.Leaves(x, len(x), 60)
    assert len(leaves.c) > 30 and neighbours.probes_for(frame(spark, np.arange(len(x)), x), leaves, 8, 3, len(x)) <= len(leaves.c) // 4


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_recall_on_tables(spark):
    """p3_knn on whole tables against brute force: both kinds reach 0.9."""
    from trigrid.llm.queries import _vectors, p3_knn

    got = p3_knn(spark, DATA).collect()
    for kind in ("theta", "rand_proj"):
        rows = _vectors(spark, DATA, kind)[0].orderBy("id").collect()
        ids, x = np.array([r["id"] for r in rows]), np.array([r["vec"] for r in rows])
        x = x / np.linalg.norm(x, axis=1, keepdims=True) if kind == "rand_proj" else x
        have = {(r["id_a"], r["id_b"]) for r in got if r["vec_kind"] == kind}
        want = {(int(ids[i]), int(b)) for i in np.flatnonzero(ids % 100 == 0) for d in [((x - x[i]) ** 2).sum(1)] for b in [ids[j] for j in np.lexsort((ids, d)) if j != i][:3]}
        assert want and len(have & want) / len(want) >= 0.9


def test_search_is_exact_with_all_leaves(spark, data):
    ids, x = data
    got = {}
    df = frame(spark, ids, x)
    for r in search(df, df, 6, 3, len(x), x, recall=1.0).collect():
        got.setdefault(r["id_a"], []).append((r["rank"], r["id_b"]))
    want = brute_top(ids, x, 3)
    assert {a: [b for _, b in sorted(v)] for a, v in got.items()} == {a: [b for b, _ in v] for a, v in want.items()}


def test_bounds_hold_and_the_loss_is_score_aware():
    """Scanned scores are within the stored errors; the parallel error is below that of plain quantisation."""
    rng = np.random.default_rng(2)
    u = rng.normal(0, 1, (3000, 8))
    book = Codebook(u)
    got = book.decode(book.encode(u), 8)
    plain = np.zeros_like(u)
    x = book.split(u)
    for j in range(book.m):
        d = ((x[:, j][:, None] - book.words[j][None]) ** 2).sum(2)
        plain[:, 2 * j : 2 * j + 2] = book.words[j][d.argmin(1)]
    way = u / np.linalg.norm(u, axis=1, keepdims=True)
    parallel = lambda y: (((u - y) * way).sum(1) ** 2).mean()
    assert parallel(got) < parallel(plain)
    block = Block(u, np.arange(3000), np.zeros(8), book, 4)
    q = rng.normal(0, 1, (5, 8))
    scan = sum(t.take(c, axis=1) for t, c in zip(book.tables(q), block.codes, strict=True))
    assert (np.abs(scan - q @ block.u.T) <= np.linalg.norm(q, axis=1)[:, None] * block.error + 1e-4).all()


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "id long, vec array<double>")
    assert mutual_pairs(empty, 6, 3, 0.25, 0, np.zeros((0, 6))).count() == 0
    assert search(empty, empty, 6, 3, 0, np.zeros((0, 6))).count() == 0
    one = frame(spark, np.array([5]), np.ones((1, 6)))
    assert mutual_pairs(one, 6, 3, 0.25, 1, np.ones((1, 6))).count() == 0
    two = frame(spark, np.array([5, 9]), np.ones((2, 6)))
    assert [tuple(r)[:2] for r in mutual_pairs(two, 6, 3, 0.25, 2, np.ones((2, 6))).collect()] == [(5, 9)]


def test_fewest_copies():
    x = np.array([[1.0, 2], [1, 2], [3, 4], [1, 2]])
    assert fewest_copies(x, np.array([9, 1, 5, 4]), 2).tolist() == [1, 2, 3]


def test_usable(spark):
    from pyspark.sql import functions as F

    rows = [([1.0, 2.0],), ([1.0, None],), ([1.0, float("nan")],), ([1.0, float("inf")],), ([1.0],), (None,), ([],), ([0.0, 1.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert [r[0] for r in df.select(L.usable(F.col("v"), 2)).collect()] == [True] + [False] * 6 + [True]
    assert [r[0] for r in df.select(L.usable(F.col("v"), 2, True)).collect()] == [True] + [False] * 7
