"""Similarity clusters: reciprocal-nearest-neighbour average linkage on a sparse graph, then the sets that its edges connect.

The graph has, within a radius, the nearest neighbours of every vector in each block it meets, the least spanning edges of each block, and,
between blocks, the shortest edge from a vector to each connected part of the other block: no set of mutually similar vectors
is written out pair by pair, and two vectors are connected by it if and only if they are in the graph of all pairs.

Average linkage: each round merges all pairs of clusters that are each other's best, in parallel. The similarity of two clusters is the sum over the
edges between them divided by the number of all pairs between them (a pair that isn't stored is not similar: 0), so it falls
where clusters touch at few points only, and the rounds end when no pair reaches the threshold. Similarities within one of LEVELS steps
count as equal and go by a hash of the pair, so chains of falling similarities do not merge one by one. Clusters whose
edges are all known to a block are merged there; the rest is merged by joins over the whole graph.

Finish: linkage leaves tight groups with edges between them. Where connected sets are asked for, groups go to neighbours of the least
hash and the graph is contracted, until no edge is left: a logarithmic number of rounds, all of them joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigrid.functions.leaves import Leaves, from_bytes, matrix, squared
from trigrid.llm.neighbours import ROUTED, _spread, _vector_hash, ranked, to_bytes
from trigrid.llm.words import mix
from trigrid.runtime import counted_join, lookup_join, materialize, release, salted_join, scratch

#: Nearest neighbours of a vector that the graph has from each block it meets; queries compared with a block at once.
NEIGHBOURS, QUERIES = 5, 512
#: Steps of the similarity (from 0 to 1) within which pairs count as equally similar.
LEVELS = 16
FOREIGN, CLOSED, OPEN = 0, 1, 2


def pair_hash(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix(mix(np.asarray(lo, np.int64).view(np.uint64)) * np.uint64(31) + np.asarray(hi, np.int64).view(np.uint64))


def merge_rounds(u: np.ndarray, v: np.ndarray, total: np.ndarray, threshold: float, open_ids: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(ids, labels, u, v, total, size of u, size of v): clusters (named by their smallest id) of single nodes and the edges left between them.

    Every pair of nodes has one edge. Pairs are ordered by the step of their mean similarity, then by hash, so the best pair of a cluster is unique
    and every round merges at least the best pair of each connected part. Ids in open_ids have edges elsewhere and aren't merged.
    """
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label, size = np.arange(len(ids)), np.ones(len(ids), np.int64)
    shut = np.isin(ids, open_ids) if open_ids is not None and len(open_ids) else np.zeros(len(ids), bool)
    total = np.asarray(total, float)
    while len(u):
        lo, hi = np.minimum(u, v), np.maximum(u, v)
        key, back = np.unique(lo * len(ids) + hi, return_inverse=True)
        total = np.bincount(back, total, len(key))
        u, v = key // len(ids), key % len(ids)
        mean = total / (size[u] * size[v])
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((pair_hash(ids[u], ids[v]), -np.floor(mean * LEVELS + 1e-9)))] = np.arange(len(key))
        best = np.full(len(ids), len(key))
        np.minimum.at(best, u, rank)
        np.minimum.at(best, v, rank)
        go = (best[u] == rank) & (best[v] == rank) & (mean >= threshold - 1e-12) & ~shut[u] & ~shut[v]
        if not go.any():
            break
        to = np.arange(len(ids))
        to[v[go]] = u[go]
        size[u[go]] += size[v[go]]
        label = to[label]
        u, v = to[u], to[v]
        apart = u != v
        u, v, total = u[apart], v[apart], total[apart]
    return ids, ids[label], ids[u], ids[v], total, size[u], size[v]


def spanning_edges(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, squared distance) of the least spanning forest of all pairs within radius; the part of each vector."""
    n = len(x)
    near, frm, out = np.full(n, np.inf), np.zeros(n, np.int64), []
    part, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    rest = np.arange(n)
    parts = 0
    limit = radius**2
    # parts can't be nearer than their first coordinates: vectors are taken in the order of one coordinate
    while len(rest):
        k = int(near[rest].argmin())
        i = rest[k]
        if near[i] <= limit:
            out.append((frm[i], i, near[i]))
            part[i] = part[frm[i]]
        else:
            part[i] = parts
            parts += 1
        open_[i] = False
        rest[k] = rest[-1]
        rest = rest[:-1]
        if len(rest):
            d = ((x[rest] - x[i]) ** 2).sum(1)
            better = d < near[rest]
            r = rest[better]
            near[r] = d[better]
            frm[r] = i
    e = np.array(out, float).reshape(-1, 3)
    return e[:, 0].astype(np.int64), e[:, 1].astype(np.int64), e[:, 2], part


def _route(leaves: Leaves, size: int, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in leaves.slices(batches):
            ids, x = b.column("id").to_numpy(), matrix(b.column("vec"), size)
            home, d = leaves.home(x)
            own = _vector_hash(x) % leaves.blocks[home]
            r, leaf = leaves.touched(home, d, radius)
            open_ = leaves.blocks[home] > 1
            open_[r] = True
            after = leaf > home[r]
            r, leaf, block = _spread(leaves, r[after], leaf[after])
            q, l2, b2 = _spread(leaves, np.arange(len(x)), home)
            later = b2 > own[q]
            r, leaf, block = np.concatenate([np.arange(len(x)), r, q[later]]), np.concatenate([home, leaf, l2[later]]), np.concatenate([own, block, b2[later]])
            role = np.full(len(r), FOREIGN, np.int8)
            role[: len(x)] = np.where(open_, OPEN, CLOSED)
            for s in range(0, len(r), 10_000):
                at = r[s : s + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[s : s + 10_000].astype(np.int32)), pa.array(block[s : s + 10_000].astype(np.int32)), pa.array(role[s : s + 10_000]), pa.array(ids[at]), to_bytes(x[at])], names=["leaf", "block", "role", "id", "vec"])

    return run


def nearest_within(x: np.ndarray, y: np.ndarray, radius: float, k: int, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance) within the radius: the k nearest of each row of x, ties by the row of y, and the nearest in each part of y.

    Without parts, y is x, and a row is left out for itself. Few of the pairs of a dense group are looked at twice.
    """
    limit = radius**2
    order = np.argsort(part, kind="stable") if part is not None else np.arange(len(y))
    y = y[order]
    if part is not None:
        sizes = np.unique(part, return_counts=True)[1]
        starts = np.cumsum(sizes) - sizes
    slack = 1e-12 * (1 + max((x * x).sum(1).max(initial=0), (y * y).sum(1).max(initial=0)))  # of distances by a matrix product
    up = lambda bound: bound * (1 + 1e-9) + slack
    out = []
    for s in range(0, len(x) if len(y) else 0, QUERIES):
        q = x[s : s + QUERIES]
        d = squared(q, y)
        if part is None:
            d[np.arange(len(q)), s + np.arange(len(q))] = np.inf
        near = d <= up(limit)
        if near.sum() > 16 * k * len(q):  # a dense group: only what can be among those asked for
            first = d <= up(np.partition(d, k - 1, axis=1)[:, k - 1 : k]) if d.shape[1] > k else np.ones(d.shape, bool)
            if part is not None:
                first |= d <= np.repeat(up(np.minimum.reduceat(d, starts, axis=1)), sizes, axis=1)
            near &= first
        i, j = np.nonzero(near)
        d = ((q[i] - y[j]) ** 2).sum(1)
        held = d <= limit
        i, j, d = i[held], order[j[held]], d[held]
        keep = ranked(i, d, j) < k
        if part is not None:
            keep |= ranked(i * (int(part.max()) + 1) + part[j], d, j) < 1
        out.append((i[keep] + s, j[keep], d[keep]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def similarity(d2: np.ndarray, radius: float) -> np.ndarray:
    """1 for equal vectors, 1/2 at the radius."""
    return 1 - np.sqrt(d2) / (2 * radius)


def _link(size: int, radius: float, k: int, threshold: float):
    """A block -> labels of what was merged in it (size_a = 0) and the edges left, with the sizes of their ends."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        role, ids, x = table.column("role").to_numpy(), table.column("id").to_numpy(), from_bytes(table.column("vec"), size)
        none = np.zeros(0, np.int64)
        a, b, total, na, nb = none, none, np.zeros(0), none, none
        own = role != FOREIGN
        if own.any():
            order = np.argsort(ids[own])
            base, base_ids, base_role = x[own][order], ids[own][order], role[own][order]
            i, j, d2, part = spanning_edges(base, radius)
            i2, j2, d3 = nearest_within(base, base, radius, k)
            i, j, d2 = np.concatenate([i, i2]), np.concatenate([j, j2]), np.concatenate([d2, d3])
            once = np.unique(np.minimum(i, j) * len(base) + np.maximum(i, j), return_index=True)[1]
            i, j, d2 = i[once], j[once], d2[once]
            names, label, u, v, t, nu, nv = merge_rounds(base_ids[i], base_ids[j], similarity(d2, radius), threshold, base_ids[base_role == OPEN])
            moved = names != label
            q, q_ids = x[~own], ids[~own]
            r, c, d = nearest_within(q, base, radius, k, part)  # base is in the order of its ids
            one, zero = np.ones(len(r), np.int64), np.zeros(int(moved.sum()), np.int64)
            a, b = np.concatenate([names[moved], u, q_ids[r]]), np.concatenate([label[moved], v, base_ids[c]])
            total = np.concatenate([zero.astype(float), t, similarity(d, radius)])
            na, nb = np.concatenate([zero, nu, one]), np.concatenate([zero, nv, one])
        return pa.table({"a": a, "b": b, "total": total, "size_a": na, "size_b": nb})

    return run


EDGES = "a long, b long, total double, size_a long, size_b long"


def sparse_graph(rows: DataFrame, size: int, radius: float, leaves: Leaves, k: int = NEIGHBOURS, threshold: float = 0.5) -> DataFrame:
    """Labels (size_a = 0) and edges of rows (id, vec), both distinct."""
    routed = rows.select("id", "vec").mapInArrow(_route(leaves, size, radius), ROUTED.replace("home boolean", "role tinyint"))
    return routed.groupBy("leaf", "block").applyInArrow(_link(size, radius, k, threshold), EDGES)


def _merged(edges: DataFrame) -> DataFrame:
    """One row for a pair of clusters, a < b; edges within a cluster go."""
    turned = F.col("a") > F.col("b")
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", F.when(turned, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"), F.when(turned, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"))
    return e.groupBy("a", "b").agg(F.sum("total").alias("total"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))


def _ends(spark: SparkSession, moves: list[DataFrame]) -> DataFrame:
    """(node, label): moves (node, label) of successive rounds, followed to their ends. A node moves once, so no way is longer than the number of rounds."""
    if not moves:
        return spark.createDataFrame([], "node long, label long")
    now, path = materialize(reduce(DataFrame.unionByName, moves), "moves")
    for _ in range((len(moves) - 1).bit_length()):
        on = now.select(F.col("node").alias("label"), F.col("label").alias("__on"))
        after, after_path = materialize(lookup_join(now, on, ["label"]).select("node", F.coalesce("__on", "label").alias("label")), "moves")
        release(spark, path)
        now, path = after, after_path
    return now


def average_linkage(edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((node, label) of every node that was merged into another, the edges left between clusters); a label is the smallest node of its cluster.

    edges: a, b, total (sum of similarities), size_a, size_b (nodes of each end). Every round is a handful of joins and pre-aggregated sums over all
    edges; nothing is gathered in one task or on the driver.
    """
    spark = edges.sparkSession
    now, path = materialize(_merged(edges), "edges")
    done: list[DataFrame] = []
    paths: list[str] = []
    mean = F.col("total") / (F.col("size_a") * F.col("size_b"))
    order = F.struct((-F.floor(mean * LEVELS + 1e-9)).alias("w"), F.xxhash64("a", "b").alias("h"), F.col("a").alias("a"), F.col("b").alias("b"))
    while True:
        ends = now.select(order.alias("e"), (mean >= threshold - 1e-12).alias("ok"), "a", "b", (F.col("size_a") + F.col("size_b")).alias("size")).select("e", "ok", "size", F.explode(F.array("a", "b")).alias("node"))
        best = ends.groupBy("node").agg(F.min(F.struct("e", "ok", "size")).alias("x"))
        pairs = best.where("x.ok").groupBy("x.e.a", "x.e.b").agg(F.count("*").alias("n"), F.max("x.size").alias("size")).where("n = 2")
        moves, moves_path = materialize(pairs.select("a", "b", "size"), "moves")
        paths.append(moves_path)
        n = moves.count()
        if not n:
            labels = _ends(spark, done)
            release(spark, *paths)
            return labels, now
        done.append(moves.select(F.col("b").alias("node"), F.col("a").alias("label")))
        gone = moves.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("to"), "size"), F.struct(F.col("b").alias("node"), F.col("a").alias("to"), "size"))).alias("m")).select("m.*")
        renamed = now
        for c in ("a", "b"):
            to = gone.select(F.col("node").alias(c), F.col("to").alias("__to"), F.col("size").alias("__size"))
            renamed = counted_join(renamed, to, [c], 2 * n).withColumns({c: F.coalesce("__to", c), f"size_{c}": F.coalesce("__size", f"size_{c}")}).drop("__to", "__size")
        after, after_path = materialize(_merged(renamed), "edges")
        release(spark, path)
        now, path = after, after_path


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge (a, b) that isn't the representative of its connected set.

    In each round a node looks at the one of least hash among itself and its neighbours, and from there once more; if it stands at one that is
    least itself, it goes there, and the graph is contracted. The hash is another one in every round, so a share of the nodes
    that doesn't depend on their number is expected to go: rounds grow with its logarithm.
    """
    spark = edges.sparkSession
    once = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, path = materialize(once(edges), "links")
    done: list[DataFrame] = []
    paths: list[str] = []
    while not now.isEmpty():
        h = lambda c: F.struct(F.xxhash64(F.lit(len(done)), F.col(c)).alias("h"), F.col(c).alias("id"))
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.min(h("b")).alias("n")).select(F.col("a").alias("node"), F.least(h("a"), F.col("n"))["id"].alias("label"))
        first, first_path = materialize(least, "first")
        n = first.count()
        on = counted_join(first, first.select(F.col("node").alias("label"), F.col("label").alias("__on")), ["label"], n, "inner").select("node", F.col("__on").alias("label"))
        roots = first.where("node = label").select("label")
        moves, moves_path = materialize(counted_join(on.where("node <> label"), roots, ["label"], n, "left_semi").select("node", "label"), "moves")
        renamed = now
        for c in ("a", "b"):
            renamed = counted_join(renamed, moves.select(F.col("node").alias(c), F.col("label").alias("__to")), [c], n).withColumn(c, F.coalesce("__to", c)).drop("__to")
        after, after_path = materialize(once(renamed), "links")
        release(spark, path, first_path)
        done.append(moves)
        paths.append(moves_path)
        now, path = after, after_path
    labels = _ends(spark, done)
    release(spark, path, *paths)
    return labels


def clusters(rows: DataFrame, size: int, radius: float, total: int, sample: np.ndarray, least: int = 3, leaves: Leaves | None = None, neighbours: int = NEIGHBOURS, threshold: float = 0.5) -> DataFrame:
    """(cluster_id, id, group_id): the connected sets of at least `least` ids; cluster_id is the smallest id of the set. group_id: the tight group within it.

    rows: id (unique), vec (arrays of `size` finite doubles). Groups are those of average linkage: the similarity of a pair is 1 less half its distance in
    radii, and groups merge while the mean over all pairs between them is at least `threshold` (the similarity at the radius). What edges within the radius still
    link is one connected set. Equal vectors are one node and share their group. An empty table gives no rows.
    """
    spark = rows.sparkSession
    if not len(sample):
        return spark.createDataFrame([], "cluster_id long, id long, group_id long")
    leaves = leaves or Leaves(sample, total)
    with scratch(spark) as keep:
        nodes, _ = materialize(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "nodes")
        graph, _ = materialize(sparse_graph(nodes, size, radius, leaves, neighbours, threshold), "graph")
        local = graph.where("size_a = 0").select(F.col("a").alias("id"), F.col("b").alias("group_id"))
        groups, links = average_linkage(graph.where("size_a > 0"), threshold)
        sets = connected(links.select("a", "b"))
        named = nodes.join(local, "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))
        for moved, c in ((groups, "group_id"), (sets, "set_id")):
            named = named.withColumn(c, F.col("group_id"))
            named = lookup_join(named, moved.select(F.col("node").alias(c), F.col("label").alias("__to")), [c]).withColumn(c, F.coalesce("__to", c)).drop("__to")
        named, _ = materialize(named, "named")
        whole = named.groupBy("set_id").agg(F.sum("n").alias("__n"), F.min("id").alias("cluster_id")).where(F.col("__n") >= least).select("set_id", "cluster_id")
        kept, _ = materialize(lookup_join(named, whole, ["set_id"], "inner"), "kept")
        copied = kept.where("n > 1").select("vec", F.col("id").alias("rep"), "cluster_id", "group_id")
        copies = salted_join(rows.select("id", "vec"), copied, ["vec"], "inner", F.xxhash64("id")).where("id <> rep")
        return keep(materialize(kept.select("cluster_id", "id", "group_id").unionByName(copies.select("cluster_id", "id", "group_id")), "clusters"))


def described(members: DataFrame, rows: DataFrame, size: int, top: int = 3) -> DataFrame:
    """(cluster_id, id, size, typical_rank, and other columns of members): every member, the size of its cluster, and 1..top for the ids nearest to the cluster's mean."""
    more = [c for c in members.columns if c not in ("cluster_id", "id")]
    m, _ = materialize(members.join(rows.select("id", "vec"), "id"), "members")
    means = m.groupBy("cluster_id").agg(F.count("*").alias("size"), F.array(*[F.avg(F.col("vec")[i]) for i in range(size)]).alias("mean"))
    means, _ = materialize(means, "means")
    d = F.round(F.aggregate(F.zip_with("vec", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y), 12)  # ties by id, not by the last bit
    far = lookup_join(m, means, ["cluster_id"], "inner").select("cluster_id", "id", "size", *more, d.alias("d"))
    best = far.withColumn("typical_rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("d", "id"))).where(F.col("typical_rank") <= top)
    return far.drop("d").join(best.select("id", "typical_rank"), "id", "left").select("cluster_id", "id", "size", "typical_rank", *more)
