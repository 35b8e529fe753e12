"""Per-key totals without hot tasks: dense accumulator arrays over equal input splits, added up block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrid.runtime import numbered, salted_join

#: Keys of a dictionary that is sent to all tasks: at most so many (8 bytes each).
DICTIONARY_KEYS = 1_000_000
#: Keys of one array block, and splits added up in the first level of the reduction.
BLOCK, FAN = 4096, 64


def _accumulate(key: str, measures: list[str], keys: np.ndarray | None):
    """Batches -> one row (block, part, n, sums...) for each touched block of the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            codes = b.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            if keys is not None:
                codes = np.searchsorted(keys, codes)
            values = [b.column(m).to_numpy(zero_copy_only=False).astype(float) for m in measures]
            block = codes // BLOCK
            for k in np.unique(block):
                at = block == k
                slot = codes[at] - k * BLOCK
                n = np.bincount(slot, minlength=BLOCK)
                v = np.stack([np.bincount(slot, np.nan_to_num(x[at], nan=0.0), BLOCK) for x in values]) if values else np.zeros((0, BLOCK))
                if k in counts:
                    counts[k] += n
                    sums[k] += v
                else:
                    counts[k], sums[k] = n, v
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if counts:
            at = sorted(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array([part] * len(at), pa.int64()), pa.array([counts[k].tobytes() for k in at], pa.binary()), pa.array([sums[k].tobytes() for k in at], pa.binary())],
                names=["block", "part", "n", "sums"],
            )

    return run


def _add(n_measures: int):
    """The rows of one block (and fan) -> one row, added element by element."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(BLOCK, np.int64), np.zeros((n_measures, BLOCK))
        for b in batches:
            for x, y in zip(b.column("n").to_pylist(), b.column("sums").to_pylist(), strict=True):
                n += np.frombuffer(x, np.int64)
                s += np.frombuffer(y).reshape(n_measures, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([0], pa.int64()), pa.array([n.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["block", "part", "n", "sums"])

    return run


def dense_totals(df: DataFrame, key: str, measures: list[str], count: str = "n") -> DataFrame:
    """For every key that isn't null: key, the number of its rows as `count`, the sum of each measure (nulls and NaN add 0).

    Keys are whole numbers. They are dictionary-encoded (sorted distinct keys; a dictionary of more than DICTIONARY_KEYS
    is joined, salted, in place of being sent to the tasks). Each input split adds its rows into dense arrays with
    bincount, however they spread over keys, so no task gets more than its split; the arrays, in blocks of BLOCK keys, are
    added up in two levels. Rows with a null key are left out; an empty table gives no rows.
    """
    schema = "block long, part long, n binary, sums binary"
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__key"), *[F.col(m).cast("double").alias(f"__m{i}") for i, m in enumerate(measures)])
    distinct = rows.select("__key").distinct()
    names = [f"__m{i}" for i in range(len(measures))]
    known = distinct.limit(DICTIONARY_KEYS + 1).toArrow().column(0).to_numpy()
    if len(known) <= DICTIONARY_KEYS:
        known = np.sort(known)
        parts = rows.mapInArrow(_accumulate("__key", names, known), schema)
    else:
        known = None
        codes = numbered(distinct, ["__key"], "__code", 0)
        parts = salted_join(rows, codes, ["__key"], "inner").select(F.col("__code").alias("__key"), *names).mapInArrow(_accumulate("__key", names, None), schema)
    add = _add(len(measures))
    first = parts.groupBy("block", F.pmod("part", F.lit(FAN)).alias("fan")).applyInArrow(add, schema)
    total = first.groupBy("block").applyInArrow(add, schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x, y in zip(b.column("block").to_pylist(), b.column("n").to_pylist(), b.column("sums").to_pylist(), strict=True):
                n, s = np.frombuffer(x, np.int64), np.frombuffer(y).reshape(len(names), BLOCK)
                at = np.flatnonzero(n)
                code = at + k * BLOCK
                yield pa.RecordBatch.from_arrays([pa.array(code if known is None else known[code], pa.int64()), pa.array(n[at]), *[pa.array(v[at]) for v in s]], names=["code", "n", *names])

    out = total.mapInArrow(spread, "code long, n long" + "".join(f", {m} double" for m in names))
    if known is None:
        out = out.join(codes.withColumnRenamed("__code", "code"), "code").withColumnRenamed("__key", "__k")
    else:
        out = out.withColumnRenamed("code", "__k")
    return out.select(F.col("__k").alias(key), F.col("n").alias(count), *[F.col(f"__m{i}").alias(m) for i, m in enumerate(measures)])
