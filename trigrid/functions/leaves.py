"""Leaves of a vector space: centroids from a bounded sample, the home leaf of every vector, the leaves a ball around it touches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows the centroids and codebooks are fitted on at most; rows aimed at in a leaf; rows of a block (a leaf of more is split).
SAMPLE, LEAF, BLOCK = 32_768, 1536, 4096
#: Borders that are tried together.
NEAR = 4
#: Distances from rows to all centroids that are held at once.
CELLS = 2**20


def usable(v: Column, size: int, positive: bool = False) -> Column:
    """Whether an array has `size` elements, all finite (and > 0). A null array isn't usable."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & ((x > 0) if positive else F.lit(True))
    return F.coalesce((F.size(v) == size) & F.forall(v, good), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """A list<double> column as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), size)


def from_bytes(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, size)


def to_bytes(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x @ y.T
    d *= -2
    d += (x * x).sum(1)[:, None]
    d += (y * y).sum(1)
    return np.maximum(d, 0, out=d)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c for every row of x, CELLS distances at a time."""
    step = max(1, CELLS // max(len(c), 1))
    return np.concatenate([squared(x[s : s + step], c).argmin(1) for s in range(0, max(len(x), 1), step)])


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, centres: np.ndarray | None = None) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)] if centres is None else centres
    for _ in range(rounds):
        own = squared(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, i], len(c)) for i in range(x.shape[1])], 1)
        c = total[n > 0] / n[n > 0, None]
    return c


def centroids(sample: np.ndarray, total: int, leaf: int = LEAF, seed: int = 7) -> np.ndarray:
    """Centroids such that a leaf holds about `leaf` of `total` rows: dense regions are split again and again.

    No part of at most 8 rows of the sample is split, but one may have fewer: however large total is, there are never more leaves than rows of
    the sample (about a fifth as many, as measured on 28.5 million rows of log_theta); the blocks of a leaf take the rest.
    """
    rng = np.random.default_rng(seed)
    most = max(8.0, leaf * len(sample) / max(total, 1))
    done, open_ = [], [sample]
    while open_:
        x = open_.pop()
        if len(x) <= most or (x == x[0]).all():
            done.append(x.mean(0))
            continue
        c = k_means(x, min(16, max(2, int(np.ceil(len(x) / most)))), 6, rng)
        own = squared(x, c).argmin(1)
        parts = [x[own == i] for i in range(len(c))]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:
            done.append(x.mean(0))
        else:
            open_.extend(parts)
    return np.array(done)


class Leaves:
    """Sent to all tasks: the centroids, and the number of blocks of each."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int = LEAF, block: int = BLOCK) -> None:
        self.c = centroids(sample, total, leaf)
        own = nearest(sample, self.c)
        share = np.bincount(own, minlength=len(self.c)) / max(len(sample), 1)
        self.blocks = np.maximum(1, np.ceil(share * total / block)).astype(np.int64)
        self.own = own

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = squared(x, self.c)
        return d.argmin(1), d

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches in pieces of so few rows that home() and touched() hold CELLS distances at a time."""
        step = max(1, CELLS // len(self.c))
        return (b.slice(s, step) for b in batches for s in range(0, b.num_rows, step))

    def touched(self, home: np.ndarray, d: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the other leaves that may hold a vector within reach of the row.

        If y is at home in leaf j, it is no farther from that centroid than from any other: it lies beyond the border between j and each
        other leaf. If the way from x to one of these borders, or to what several of them leave together, is longer than reach, y isn't within reach of x:
        nothing is lost. The border of x's own leaf is tried first, then those of the NEAR leaves nearest to x.
        """
        row = np.arange(len(home))
        far = d.copy()
        near = np.zeros((len(d), min(NEAR, d.shape[1])), np.int64)
        for t in range(near.shape[1]):
            near[:, t] = far.argmin(1)
            far[row, near[:, t]] = np.inf
        # two centroids are no farther apart than from x to both: no border of other leaves is within reach
        most = (np.sqrt(d[row, home]) + 2 * reach) ** 2 * (1 + 1e-6) + 1e-9
        row, leaf = np.divmod(np.flatnonzero(d <= most[:, None]), d.shape[1])
        keep = leaf != home[row]
        row, leaf = row[keep], leaf[keep]
        apart_from = lambda i, j: np.sqrt(((self.c[i] - self.c[j]) ** 2).sum(-1))
        out = []
        for s in range(0, len(row), 20_000):
            r, j = row[s : s + 20_000], leaf[s : s + 20_000]
            gap = d[r, j] - d[r, home[r]] <= 2 * reach * apart_from(home[r], j) * (1 + 1e-9) + 1e-12
            r, j = r[gap], j[gap]
            other = near[r]
            apart = np.maximum(apart_from(j[:, None], other), 1e-300)
            margin = np.maximum((d[r, j][:, None] - d[r[:, None], other]) / (2 * apart), 0)
            margin[other == j[:, None]] = 0
            w = margin / apart  # each border's normal counts by its margin
            normal = w.sum(1)[:, None] * self.c[j] - np.einsum("nt,ntk->nk", w, self.c[other])
            way = (margin**2).sum(1) / np.maximum(np.sqrt((normal**2).sum(1)), 1e-300)
            keep = np.maximum(way, margin.max(1)) <= reach * (1 + 1e-6) + 1e-9
            out.append((r[keep], j[keep]))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (row, leaf)


def sample_of(rows: DataFrame, vec: str, key: list[str], size: int, total: int, n: int = SAMPLE) -> np.ndarray:
    """About n of at most `total` vectors (all, if there are no more): those whose key has a hash in the first n / total of the range.

    The same whatever the partitioning; filtered where they are read, so no task and not the driver gets more than the sample.
    """
    share = int(min(1.0, n / max(total, 1)) * 2**30)
    part = rows.where(F.pmod(F.xxhash64(*key), F.lit(2**30)) < share)
    got = part.select(F.col(vec).alias("v"), F.xxhash64(*key).alias("h")).toArrow()
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    return matrix(got.column("v"), size)[order]
