"""The most similar vectors of every vector: anisotropic four-bit quantisation, table scans, exact reranking.

Vectors go to leaves (leaves.py). Within a leaf each is held as its residual to the centroid, quantised in subspaces of
two dimensions with 16 code words each. The code words minimise a score-aware loss: the part of the error that is parallel
to the vector weighs more than the rest, as it shifts large inner products most. A query scans tables of its inner
products with all code words (two codes to a byte), which gives the inner product with every residual up to a known bound
(Cauchy-Schwarz with the stored length of the error). What can still be among the nearest within the bound is reranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trigrid.functions.leaves import Leaves, from_bytes, k_means, matrix, squared, to_bytes
from trigrid.llm.words import mix

#: Inner products from this share of the vectors' length on matter for the loss; queries scanned at once.
MATTERS, QUERIES = 0.4, 512
#: A query with more candidates than this share of the block is reranked by a matrix product.
DENSE = 0.1
#: Rows aimed at in a leaf, and of a block: larger than elsewhere, as codes are scanned fast and fewer leaves mean fewer copies.
LEAF, BLOCK = 3072, 8192
#: Residuals that a codebook is fitted on at most. Queries that the number of probes is measured on at most, and the recall it has to reach on them.
FITTED, MEASURED, RECALL = 8192, 256, 0.98
#: Standard deviations of a neighbour's way towards a border that are followed into the other leaf (1 / reach of the lossless way).
SIGMAS = 3.0


class Codebook:
    """16 code words for each pair of dimensions, fitted on residuals by the anisotropic loss."""

    def __init__(self, u: np.ndarray, rounds: int = 6, seed: int = 11) -> None:
        """u: residuals of a sample in the order of a hash; the first FITTED of it are used."""
        d = u.shape[1]
        self.m = m = (d + 1) // 2
        self.weight = max(1.0, (d - 1) * MATTERS**2 / (1 - MATTERS**2)) - 1
        rng = np.random.default_rng(seed)
        u = u[:FITTED]
        x = self.split(u)
        self.words = np.zeros((m, 16, 2))
        for j in range(m):
            c = k_means(x[:, j], 16, 8, rng)
            self.words[j, : len(c)] = c
            self.words[j, len(c) :] = c[0]
        way = self.split(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300))
        for _ in range(rounds):
            codes = self.encode(u, 1)
            for j in range(m):
                got = self.words[np.arange(m), codes]  # n, m, 2
                rest = ((x - got) * way).sum((1, 2)) - ((x[:, j] - got[:, j]) * way[:, j]).sum(1)
                a = np.zeros((16, 2, 2))
                b = np.zeros((16, 2))
                target = (x[:, j] * way[:, j]).sum(1) + rest
                for p in range(2):
                    b[:, p] = np.bincount(codes[:, j], x[:, j, p] + self.weight * way[:, j, p] * target, 16)
                    for q in range(2):
                        a[:, p, q] = np.bincount(codes[:, j], (p == q) + self.weight * way[:, j, p] * way[:, j, q], 16)
                full = np.bincount(codes[:, j], minlength=16) > 0
                self.words[j, full] = np.linalg.solve(a[full], b[full][..., None])[..., 0]

    def split(self, u: np.ndarray) -> np.ndarray:
        return np.pad(u, ((0, 0), (0, u.shape[1] % 2))).reshape(len(u), self.m, 2)

    def encode(self, u: np.ndarray, passes: int = 2) -> np.ndarray:
        """The codes (n, m): the nearest words, then word by word those of the least anisotropic loss."""
        x = self.split(u)
        way = self.split(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300))
        codes = np.zeros((len(u), self.m), np.uint8)
        plain = []
        for j in range(self.m):
            e = squared(x[:, j], self.words[j])
            codes[:, j] = e.argmin(1)
            plain.append(e)
        along = ((x - self.words[np.arange(self.m), codes]) * way).sum((1, 2))
        row = np.arange(len(u))
        for _ in range(passes):
            for j in range(self.m):
                toward = (x[:, j] * way[:, j]).sum(1)[:, None] - way[:, j] @ self.words[j].T  # the parallel error of each word
                rest = along - toward[row, codes[:, j]]
                loss = plain[j] + self.weight * (rest[:, None] + toward) ** 2
                codes[:, j] = loss.argmin(1)
                along = rest + toward[row, codes[:, j]]
        return codes

    def decode(self, codes: np.ndarray, size: int) -> np.ndarray:
        return self.words[np.arange(self.m), codes].reshape(len(codes), -1)[:, :size]

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each pair of subspaces the inner products with all 256 pairs of words."""
        x = self.split(q)
        t = [(x[:, j] @ self.words[j].T).astype(np.float32) for j in range(self.m)]
        out = []
        for j in range(0, self.m, 2):
            high = t[j + 1] if j + 1 < self.m else np.zeros((len(q), 1), np.float32)
            out.append((high[:, :, None] + t[j][:, None, :]).reshape(len(q), -1))
        return out

    @staticmethod
    def packed(codes: np.ndarray) -> list[np.ndarray]:
        """Two four-bit codes to a byte."""
        m = codes.shape[1]
        return [codes[:, j] + (codes[:, j + 1] << 4 if j + 1 < m else 0) for j in range(0, m, 2)]


class Block:
    """The distinct vectors of a block, quantised, each with its smallest ids."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, centre: np.ndarray, book: Codebook, copies: int) -> None:
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids = x[order], ids[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(1)
        group = np.cumsum(new) - 1
        keep = np.arange(len(x)) - np.flatnonzero(new)[group] < copies
        self.x, self.ids, self.group = x[new], ids[keep], group[keep]
        self.first = np.searchsorted(self.group, np.arange(len(self.x)))
        self.n_ids = np.bincount(self.group, minlength=len(self.x))
        self.centre, self.book = centre, book
        self.u = self.x - centre
        codes = book.encode(self.u)
        self.error = np.linalg.norm(self.u - book.decode(codes, x.shape[1]), axis=1).astype(np.float32) * np.float32(1.0001)
        self.half = (self.u**2).sum(1).astype(np.float32) / 2
        self.codes = book.packed(codes)

    def candidates(self, q: np.ndarray, k: int, radius: float | None, both: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, squared distance) of all that may be among the k nearest within the radius.

        both: queries (a mask) that may also be among the k nearest, of these queries, of a vector.
        """
        foreign = np.zeros(len(q), bool) if both is None else both
        qc = q - self.centre
        size = np.linalg.norm(qc, axis=1).astype(np.float32)
        scan = np.zeros((len(q), len(self.x)), np.float32)
        for t, c in zip(self.book.tables(qc), self.codes, strict=True):
            scan += t.take(c, axis=1)
        scan -= self.half
        slack = size[:, None] * self.error + np.float32(1e-5) * (size[:, None] ** 2 + self.half)
        scan += slack  # upper bounds of the score; distance^2 = size^2 - 2 * score
        hold = np.full(len(q), -np.inf, np.float32)
        if radius is not None:
            hold = (size**2 - np.float32(radius**2 * (1 + 1e-6))) / 2
        may = scan >= hold[:, None]
        many = np.flatnonzero(may.sum(1) > 16 * k)
        if len(many) and len(self.x) > k:
            low = scan[many] - 2 * slack[many]
            kth = np.partition(low, len(self.x) - k - 1, axis=1)[:, len(self.x) - k - 1]  # k + 1: the query itself may be among them
            near = scan[many] >= kth[:, None]
            if foreign.any():  # what a vector's own k-th best upper bound doesn't exclude stays, too
                f = np.flatnonzero(foreign)
                d = size[f, None] ** 2 - 2 * scan[f]  # lower bounds of the squared distance
                last = np.full(len(self.x), np.inf, np.float32)
                if len(f) > k:
                    last = np.partition(d + 4 * slack[f], k - 1, axis=0)[k - 1]
                place = np.full(len(q), -1)
                place[f] = np.arange(len(f))
                mine = np.flatnonzero(foreign[many])
                near[mine] |= d[place[many[mine]]] <= last
            may[many] &= near
        n = may.sum(1)
        dense = np.flatnonzero(n > max(16 * k, DENSE * len(self.x)))
        out = []
        if len(dense):
            d = squared(qc[dense], self.u)
            far = np.partition(d, min(k + 4, d.shape[1] - 1), axis=1)[:, min(k + 4, d.shape[1] - 1)]
            near = d <= far[:, None] * (1 + 1e-9) + 1e-9
            f = np.flatnonzero(foreign[dense])
            if len(f):
                last = np.partition(d[f], min(k, len(f)) - 1, axis=0)[min(k, len(f)) - 1]
                near[f] |= d[f] <= last * (1 + 1e-9) + 1e-9
            r, c = np.nonzero(near)
            out.append((dense[r], c))
            may[dense] = False
        out.append(np.nonzero(may))
        r, c = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
        d = np.zeros(len(r))
        for s in range(0, len(r), 200_000):
            d[s : s + 200_000] = ((q[r[s : s + 200_000]] - self.x[c[s : s + 200_000]]) ** 2).sum(1)
        if radius is not None:
            near = d <= radius**2
            r, c, d = r[near], c[near], d[near]
        return r, c, d

    def nearest(self, q: np.ndarray, q_ids: np.ndarray, k: int, radius: float | None, both: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, squared distance): the k nearest of each query in this block, ties by id, itself left out.

        both: queries (a mask) for which the vectors' k nearest among these queries come out, too.
        """
        a, b, dist = [], [], []
        for s in range(0, len(q), QUERIES):
            r, c, d = self.candidates(q[s : s + QUERIES], k, radius, None if both is None else both[s : s + QUERIES])
            n = self.n_ids[c]
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x, y, d = np.repeat(r, n) + s, self.ids[np.repeat(self.first[c], n) + each], np.repeat(d, n)
            other = q_ids[x] != y
            x, y, d = x[other], y[other], d[other]
            keep = ranked(x, d, y) < k
            if both is not None and both.any():
                f = np.flatnonzero(both[x])
                keep[f[ranked(y[f], d[f], q_ids[x[f]]) < k]] = True
            a.append(q_ids[x[keep]])
            b.append(y[keep])
            dist.append(d[keep])
        return tuple(np.concatenate(v) for v in (a, b, dist)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def ranked(key: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """The rank of each row among those with its key, from 0."""
    order = np.lexsort((*by[::-1], key))
    k = key[order]
    start = np.ones(len(k), bool)
    start[1:] = k[1:] != k[:-1]
    out = np.empty(len(k), np.int64)
    out[order] = np.arange(len(k)) - np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))
    return out


def fewest_copies(x: np.ndarray, ids: np.ndarray, copies: int) -> np.ndarray:
    """Rows to keep so that every distinct vector keeps its smallest ids."""
    order = np.lexsort((ids, *x.T[::-1]))
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    at = np.arange(len(s))
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < copies
    return np.sort(order[keep])


ROUTED = "leaf int, block int, home boolean, id long, vec binary"
FOUND = "id_a long, id_b long, d2 double"


def _batch(leaf: np.ndarray, block: np.ndarray, home: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(home), pa.array(ids), to_bytes(x)], names=["leaf", "block", "home", "id", "vec"])


def _vector_hash(x: np.ndarray) -> np.ndarray:
    """The same for equal vectors, so that copies meet in one block."""
    h = np.zeros(len(x), np.uint64)
    for c in np.ascontiguousarray(x + 0.0).view(np.uint64).reshape(x.shape).T:
        h = mix(h * np.uint64(31) + c)
    return (h >> np.uint64(1)).astype(np.int64)


def _spread(leaves: Leaves, row: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, block) for every block of the leaves."""
    n = leaves.blocks[leaf]
    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(row, n), np.repeat(leaf, n), each


def _route(leaves: Leaves, size: int, radius: float, lossless: bool, copies: int, unit: bool):
    reach = radius if lossless else radius * min(1.0, SIGMAS / np.sqrt(max(size - 1, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column("id").to_numpy(), matrix(b.column("vec"), size)
            if unit:
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            keep = fewest_copies(x, ids, copies)
            ids, x = ids[keep], x[keep]
            home, d = leaves.home(x)
            row = np.arange(len(x))
            own = _vector_hash(x) % leaves.blocks[home]
            yield _batch(home, own, np.ones(len(x), bool), ids, x)
            # a pair in two leaves is looked at once: in the leaf of the larger number
            r, leaf = leaves.touched(home, d, reach)
            after = leaf > home[r]
            r, leaf, block = _spread(leaves, r[after], leaf[after])
            q, l2, b2 = _spread(leaves, row, home)  # the later blocks of its own leaf
            later = b2 > own[q]
            r, leaf, block = np.concatenate([r, q[later]]), np.concatenate([leaf, l2[later]]), np.concatenate([block, b2[later]])
            for s in range(0, len(r), 10_000):
                at = r[s : s + 10_000]
                yield _batch(leaf[s : s + 10_000], block[s : s + 10_000], np.zeros(len(at), bool), ids[at], x[at])

    return run


def _look(leaves: Leaves, book: Codebook, size: int, k: int, radius: float | None, copies: int, mutual: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        ids, x = table.column("id").to_numpy(), from_bytes(table.column("vec"), size)
        a, b, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if home.any():
            block = Block(x[home], ids[home], leaves.c[key[0].as_py()], book, copies)
            if mutual:
                kept = np.concatenate([np.repeat(block.x, block.n_ids, 0), x[~home]])
                q_ids = np.concatenate([block.ids, ids[~home]])
                a, b, d = block.nearest(kept, q_ids, k, radius, np.arange(len(q_ids)) >= len(block.ids))
            else:
                a, b, d = block.nearest(x[~home], ids[~home], k, radius)
        return pa.table({"id_a": a, "id_b": b, "d2": d})

    return run


def mutual_pairs(rows: DataFrame, size: int, k: int, radius: float, total: int, sample: np.ndarray, unit: bool = False, lossless: bool = True) -> DataFrame:
    """(id_a, id_b, d2), id_a < id_b: pairs where each is among the other's k nearest (ties: smaller id), within the radius.

    rows: id (unique), vec (arrays of `size` finite doubles). unit: vectors are scaled to length 1 first. Of equal vectors
    only the k + 1 smallest ids can be in such a pair, so no more of them are routed, whatever the number of copies. Every
    vector goes to its leaf's block and to the blocks that its radius touches: nothing is lost. lossless=False cuts the radius to SIGMAS
    standard deviations of a random direction, which loses pairs of neighbours that vary in few directions.
    """
    if unit:
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    if not len(sample):
        return rows.sparkSession.createDataFrame([], FOUND)
    leaves = Leaves(sample, total, leaf=LEAF, block=BLOCK)
    book = Codebook(sample - leaves.c[leaves.own])
    routed = rows.select("id", "vec").mapInArrow(_route(leaves, size, radius, lossless, k + 1, unit), ROUTED)
    found = routed.groupBy("leaf", "block").applyInArrow(_look(leaves, book, size, k, radius, k + 1, True), FOUND)
    turned = F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "d2")
    both = found.select(F.explode(F.array(F.struct("id_a", "id_b", "d2"), turned)).alias("p")).select("p.*")
    best = both.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("id_a").orderBy("d2", "id_b"))).where(F.col("rank") <= k)
    pairs = best.groupBy(F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y")).agg(F.count("*").alias("n"), F.min("d2").alias("d2"))
    return pairs.where("n = 2").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), "d2")


def _route_base(leaves: Leaves, size: int, copies: int, unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column("id").to_numpy(), matrix(b.column("vec"), size)
            x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
            keep = fewest_copies(x, ids, copies)
            ids, x = ids[keep], x[keep]
            home, _ = leaves.home(x)
            yield _batch(home, _vector_hash(x) % leaves.blocks[home], np.ones(len(x), bool), ids, x)

    return run


def _route_queries(leaves: Leaves, size: int, probes: int, unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column("id").to_numpy(), matrix(b.column("vec"), size)
            x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
            _, d = leaves.home(x)
            p = min(probes, d.shape[1])
            leaf = np.argpartition(d, p - 1, axis=1)[:, :p] if p < d.shape[1] else np.tile(np.arange(p), (len(x), 1))
            r, leaf, block = _spread(leaves, np.repeat(np.arange(len(x)), p), leaf.ravel())
            for s in range(0, len(r), 10_000):
                at = r[s : s + 10_000]
                yield _batch(leaf[s : s + 10_000], block[s : s + 10_000], np.zeros(len(at), bool), ids[at], x[at])

    return run


def _measure(queries: np.ndarray, ids: np.ndarray, size: int, k: int, unit: bool):
    """The k nearest rows of a split for each of few queries, exactly: (query, id, squared distance, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.full((len(queries), k), np.inf)
        who, vec = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k, size))
        for b in batches:
            x = matrix(b.column("vec"), size)
            own = b.column("id").to_numpy()
            x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
            d = squared(queries, x)
            d[ids[:, None] == own[None, :]] = np.inf
            m = min(k, d.shape[1])
            col = np.argpartition(d, m - 1, axis=1)[:, :m]
            near, who, vec = np.concatenate([near, np.take_along_axis(d, col, 1)], 1), np.concatenate([who, own[col]], 1), np.concatenate([vec, x[col]], 1)
            top = np.argpartition(near, k - 1, axis=1)[:, :k]
            near, who, vec = np.take_along_axis(near, top, 1), np.take_along_axis(who, top, 1), np.take_along_axis(vec, top[:, :, None], 1)
        row, at = np.nonzero(near < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(who[row, at]), pa.array(near[row, at]), to_bytes(vec[row, at])], names=["query", "id", "d2", "vec"])

    return run


def probes_for(base: DataFrame, leaves: Leaves, size: int, k: int, total: int, unit: bool = False, recall: float = RECALL, measured: int = MEASURED) -> int:
    """How many of the leaves nearest to a query hold at least this share of the true neighbours.

    Measured by brute force: at most about `measured` rows, taken by a hash of their ids, against all rows of base, in one pass; k rows a query and split are
    shuffled, k a query come to the driver.
    """
    share = int(min(1.0, measured / max(total, 1)) * 2**30)
    got = base.where(F.pmod(F.xxhash64("id", F.lit("probes")), F.lit(2**30)) < share).select("id", "vec").toArrow()
    if not got.num_rows or len(leaves.c) == 1:
        return len(leaves.c)
    q, ids = matrix(got.column("vec"), size), got.column("id").to_numpy()
    q = q / np.linalg.norm(q, axis=1, keepdims=True) if unit else q
    found = base.select("id", "vec").mapInArrow(_measure(q, ids, size, k, unit), "query int, id long, d2 double, vec binary")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "id"))).where(F.col("rank") <= k).select("query", "vec").toArrow()
    if not best.num_rows:
        return len(leaves.c)
    home, _ = leaves.home(from_bytes(best.column("vec"), size))
    _, d = leaves.home(q)
    d = d[best.column("query").to_numpy()]
    place = np.sort((d < d[np.arange(len(home)), home][:, None]).sum(1))
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1


def search(queries: DataFrame, base: DataFrame, size: int, k: int, total: int, sample: np.ndarray, unit: bool = False, recall: float = RECALL, leaves: Leaves | None = None) -> DataFrame:
    """(id_a, id_b, d2, rank): the k nearest rows of base for every query, by Euclidean distance (of the unit vectors), ties by id.

    A row is not its own neighbour. Every row of base is in the index; of equal vectors the k + 1 smallest ids are held,
    which are all that can come out. A query looks into a number of leaves that is measured on the data to reach the recall
    (probes_for); only this loses anything, and recall=1.0 looks into all.
    """
    if not len(sample):
        return queries.sparkSession.createDataFrame([], FOUND + ", rank int")
    if unit:
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    leaves = leaves or Leaves(sample, total, leaf=LEAF, block=BLOCK)
    book = Codebook(sample - leaves.c[squared(sample, leaves.c).argmin(1)])
    probes = probes_for(base, leaves, size, k, total, unit, recall) if recall < 1 else len(leaves.c)
    routed = base.select("id", "vec").mapInArrow(_route_base(leaves, size, k + 1, unit), ROUTED).unionByName(queries.select("id", "vec").mapInArrow(_route_queries(leaves, size, probes, unit), ROUTED))
    found = routed.groupBy("leaf", "block").applyInArrow(_look(leaves, book, size, k, None, k + 1, False), FOUND)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id_a").orderBy("d2", "id_b"))).where(F.col("rank") <= k)
