from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trigrid.functions import leaves as leaves_module
from trigrid.functions.leaves import Leaves
from trigrid.llm import clusters as clusters_module
from trigrid.llm.clusters import EDGES, average_linkage, clusters, connected, described, merge_rounds, spanning_edges


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    x = [rng.normal(0, 2, (300, 4))]
    for n in (2, 3, 4, 50, 120):
        x.append(rng.normal(0, 2, 4) + rng.normal(0, 0.06, (n, 4)))
    chain = np.zeros((60, 4))
    chain[:, 0] = 20 + np.arange(60) * 0.2  # linked only step by step
    x += [chain, np.repeat(rng.normal(0, 2, (1, 4)), 80, 0), np.repeat(rng.normal(0, 2, (1, 4)), 2, 0)]
    x = np.concatenate(x)
    return rng.permutation(len(x)) + 10, x


def brute(ids, x, radius, least=3):
    root = np.arange(len(x))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(x)):
        for j in np.flatnonzero(((x - x[i]) ** 2).sum(1) <= radius**2):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    sets = {}
    for i in range(len(x)):
        sets.setdefault(find(i), []).append(int(ids[i]))
    return {(min(s), i) for s in sets.values() if len(s) >= least for i in s}


def frame(spark, ids, x):
    return spark.createDataFrame([(i, v, "clash") for i, v in zip(ids.tolist(), x.tolist(), strict=True)], "id long, vec array<double>, cluster_id string").repartition(3)


@pytest.mark.parametrize(("leaf", "block"), [(1536, 4096), (40, 30)])
def test_connected_sets(spark, data, leaf, block):
    """In one block, and across leaves and blocks."""
    ids, x = data
    got = clusters(frame(spark, ids, x), 4, 0.25, len(x), x, leaves=Leaves(x, len(x), leaf, block)).collect()
    assert {(r["cluster_id"], r["id"]) for r in got} == brute(ids, x, 0.25) and len(got) == len({r["id"] for r in got})
    groups = {}
    for r in got:
        groups.setdefault(r["group_id"], []).append(r)
    at = dict(zip(ids.tolist(), x, strict=True))
    for g, rs in groups.items():  # groups are within sets, and tight: on average as near as the radius
        assert len({r["cluster_id"] for r in rs}) == 1 and g == min(r["id"] for r in rs)
        v = np.array([at[r["id"]] for r in rs])
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
        assert d.sum() <= 0.5 * len(v) ** 2
    assert any(len(rs) > 2 for rs in groups.values()) and len(groups) > len({r["cluster_id"] for r in got})


def test_description(spark, data):
    ids, x = data
    df = frame(spark, ids, x)
    members = clusters(df, 4, 0.25, len(x), x)
    rows = described(members, df, 4).collect()
    size = {}
    for c, _ in brute(ids, x, 0.25):
        size[c] = size.get(c, 0) + 1
    assert {r["cluster_id"]: r["size"] for r in rows} == size
    at = dict(zip(ids.tolist(), x, strict=True))
    for c in size:
        own = sorted(r["id"] for r in rows if r["cluster_id"] == c)
        mean = np.mean([at[i] for i in own], 0)
        best = sorted(own, key=lambda i: (round(((at[i] - mean) ** 2).sum(), 12), i))[:3]
        got = [r["id"] for r in sorted((r for r in rows if r["cluster_id"] == c and r["typical_rank"]), key=lambda r: r["typical_rank"])]
        assert len(got) == 3 and (size[c] == 80 or got == best)


def sequential(u, v, s, threshold):
    """The best pair of clusters, one after the other; a pair without an edge counts 0."""
    own = {int(i): {int(i)} for i in np.concatenate([u, v])}
    edge = {(int(a), int(b)): float(x) for a, b, x in zip(u, v, s, strict=True)}
    while True:
        total = {}
        at = {i: c for c, m in own.items() for i in m}
        for (a, b), x in edge.items():
            if at[a] != at[b]:
                k = (min(at[a], at[b]), max(at[a], at[b]))
                total[k] = total.get(k, 0) + x
        mean = {k: x / (len(own[k[0]]) * len(own[k[1]])) for k, x in total.items()}
        if not mean or max(mean.values()) < threshold:
            return {i: c for c, m in own.items() for i in m}, mean
        a, b = max(mean, key=mean.get)
        own[a] |= own.pop(b)


def test_average_linkage_stops_below_the_threshold(spark):
    """1-2 merge first; the mean of their two edges to 3 is then below the threshold, though one of them is above."""
    u, v, s = np.array([1, 2, 1, 4]), np.array([2, 3, 3, 5]), np.array([0.9, 0.8, 0.2, 0.95])
    ids, label, ru, rv, total, nu, nv = merge_rounds(u, v, s, 0.6)
    assert dict(zip(ids.tolist(), label.tolist(), strict=True)) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert (ru.tolist(), rv.tolist(), total.tolist(), nu.tolist(), nv.tolist()) == ([1], [3], [1.0], [2], [1])
    df = spark.createDataFrame([(*map(int, e), float(t), 1, 1) for e, t in zip(zip(u, v, strict=True), s, strict=True)], EDGES)
    labels, left = average_linkage(df, 0.6)
    assert {tuple(r) for r in labels.collect()} == {(2, 1), (5, 4)}
    assert [tuple(r) for r in left.collect()] == [(1, 3, 1.0, 2, 1)]


@pytest.mark.parametrize("levels", [2**40, 16])
def test_average_linkage_against_sequential(spark, monkeypatch, levels):
    """With fine steps the rounds, in a block and by joins, end with the clusters of the sequential algorithm; with coarse ones no pair is left that should merge."""
    monkeypatch.setattr(clusters_module, "LEVELS", levels)
    rng = np.random.default_rng(4)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (400, 2)) // 4 * 4 + rng.integers(0, 5, (400, 2)) if a != b})
    u, v = np.array(pairs).T
    s = rng.uniform(0.5, 1, len(u))
    want, _ = sequential(u, v, s, 0.5)
    ids, label, ru, rv, total, nu, nv = merge_rounds(u, v, s, 0.5)
    labels, left = average_linkage(spark.createDataFrame([(a, b, float(t), 1, 1) for (a, b), t in zip(pairs, s, strict=True)], EDGES), 0.5)
    moved = {r["node"]: r["label"] for r in labels.collect()}
    rest = left.collect()
    assert all(r["total"] / (r["size_a"] * r["size_b"]) < 0.5 for r in rest) and (total / (nu * nv) < 0.5).all() and len(rest)
    if levels > 16:
        assert dict(zip(ids.tolist(), label.tolist(), strict=True)) == want == {i: moved.get(i, i) for i in want}
        assert len(set(want.values())) < len(want) - 10


def test_ties_merge_in_few_rounds(spark):
    """All edges of a chain equal, or falling: rounds don't grow with its length, and a merged pair is tight."""
    n = 400
    for s in (np.ones(n - 1), np.linspace(1, 0.9, n - 1)):
        _, label, ru, rv, total, nu, nv = merge_rounds(np.arange(n - 1), np.arange(1, n), s, 0.5)
        assert (total / (nu * nv) < 0.5).all() and np.bincount(label).max() <= 3 and len(ru) == len(set(label.tolist())) - 1


def test_connected(spark):
    rng = np.random.default_rng(5)
    chain, star, some = [(i, i + 1) for i in range(150)], [(1000, 1001 + i) for i in range(100)], rng.integers(2000, 2150, (120, 2)).tolist()
    edges = [*chain, *star, *map(tuple, some), (5, 5), (1, 0)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        root[find(a)] = find(b)
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    name = lambda i: got.get(i, i)
    sets = {}
    for i in list(root):
        sets.setdefault(find(i), set()).add(name(i))
    assert all(len(x) == 1 for x in sets.values()) and len({min(x) for x in sets.values()}) == len(sets)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_edges():
    x = np.random.default_rng(0).normal(0, 1, (200, 2))
    a, b, d2, part = spanning_edges(x, 0.3)
    assert np.allclose(((x[a] - x[b]) ** 2).sum(1), d2) and (d2 <= 0.09).all()
    assert len(a) == 200 - len(set(part.tolist()))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert all(part[i] == part[j] for i, j in zip(*np.nonzero(d <= 0.09), strict=True))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_nearest_within(monkeypatch, spread):
    """In a dense group and a loose one: the k nearest, and the nearest in each part, ties by row."""
    monkeypatch.setattr(clusters_module, "QUERIES", 16)
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, spread, (50, 3)), rng.normal(0, spread, (70, 3))
    y[5] = y[9]
    x[0] = y[5]
    part = rng.integers(0, 4, 70)
    d = ((x[:, None] - y[None]) ** 2).sum(2)
    want = set()
    for i in range(50):
        o = [j for j in np.lexsort((np.arange(70), d[i])) if d[i, j] <= 0.25]
        want |= {(i, j) for j in o[:3]} | {(i, next(j for j in o if part[j] == p)) for p in set(part[o])}
    i, j, got = clusters_module.nearest_within(x, y, 0.5, 3, part)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and np.allclose(got, d[i, j]) and len(i) == len(want)
    d = ((y[:, None] - y[None]) ** 2).sum(2) + np.diag(np.full(70, np.inf))
    i, j, _ = clusters_module.nearest_within(y, y, 0.5, 3)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(i, j) for i in range(70) for j in np.lexsort((np.arange(70), d[i]))[:3] if d[i, j] <= 0.25}


def test_nothing_to_cluster(spark):
    empty = spark.createDataFrame([], "id long, vec array<double>")
    assert clusters(empty, 4, 0.25, 0, np.zeros((0, 4))).count() == 0
    lone = frame(spark, np.array([1, 2]), np.array([[0.0] * 4, [9.0] * 4]))
    assert clusters(lone, 4, 0.25, 2, np.zeros((1, 4))).count() == 0


def test_many_leaves_in_bounded_memory(monkeypatch):
    """Of a large table: neither the driver, which makes the leaves, nor a worker that routes a batch holds all rows by all leaves; the rows are the same."""
    x = np.random.default_rng(8).normal(0, 1, (8000, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x))], names=["id", "vec"])

    def routed(cells):
        monkeypatch.setattr(leaves_module, "CELLS", cells, raising=False)
        tracemalloc.start()
        leaves = Leaves(x, 10**9)
        made = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        rows = [r for b in clusters_module._route(leaves, 4, 0.05)(iter([batch])) for r in zip(*(b.column(c).to_pylist() for c in ("leaf", "block", "role", "id")), strict=True) if r[1] == 0]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return sorted(rows), len(leaves.c), made, most

    monkeypatch.setattr(clusters_module, "_spread", lambda _, row, leaf: (row, leaf, np.zeros(len(row), np.int64)))
    monkeypatch.setattr(clusters_module, "_vector_hash", lambda v: np.zeros(len(v), np.int64))
    want, n, _, _ = routed(2**30)
    rows, same, made, most = routed(2**18)
    assert rows == want and len(rows) > len(x) and same == n > 1000
    assert made < len(x) * n * 8 / 4 and most < len(x) * n * 8 / 4
