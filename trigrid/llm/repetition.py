"""Repetition inside a document: hashed n-gram log-likelihood ratios, length-normalised, with one threshold for all documents.

Every window of n words is a feature: its hash bucket, and whether an equal window came before it in the document. Two multinomials over
these features are fitted on all documents. The raw corpus has every window. The trusted target is the corpus without its repetitions: its
windows are those that say something new, and a repeated one has the mass of the smoothing only. The log-likelihood ratio (target to
raw) of a document is divided by its number of windows. A window that says something new weighs the same in every bucket; a
repeated one weighs by how many repetitions of the whole corpus fall into its bucket, so that a phrase that many documents repeat
counts more against a document than one that it alone repeats. No repeated window weighs less than one in the emptiest bucket with
repetitions, so a document with the share asked for can't be above a known ratio: this is the threshold, alike for every document, and
no such document is lost. What passes it is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrid.llm.words import Vocabulary, window_hashes, words
from trigrid.runtime import materialize

#: Words of a window, hash buckets, share of repeated windows from which a document is repetitive, weight of the smoothing.
N, BUCKETS, SHARE, SMOOTH = 4, 65_536, 0.30, 0.5
#: Buckets of a block of counters.
BLOCK = 4096


def repeated_windows(w: list[str], n: int) -> np.ndarray:
    """Whether an equal window came before, for every window of n words; words are compared by number, not by hash."""
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    number: dict[str, int] = {}
    at = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    window = at[:m]
    for i in range(1, n):  # pairs of (window so far, next word) are numbered again, so the numbers stay below m
        window = np.unique(window * len(number) + at[i : i + m], return_inverse=True)[1]
    again = np.ones(m, bool)
    again[np.unique(window, return_index=True)[1]] = False
    return again


def _features(n: int, buckets: int):
    """A document -> its number of windows, of repeated ones, and the buckets of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in batches:
            total, held = [], []
            for text in b.column("text").to_pylist():
                w = words(text)
                again = repeated_windows(w, n)
                total.append(len(again))
                at = window_hashes(vocabulary.hashes(w), n)[again] % np.uint64(buckets) if again.any() else np.zeros(0)
                held.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(total, pa.int64()), pa.array([len(x) for x in held], pa.int64()), pa.array([x.tobytes() for x in held], pa.binary())], names=["id", "n_windows", "n_repeated", "buckets"])

    return run


def _count(buckets: int):
    """Counters of a split: new windows (their buckets don't matter) in the block -1, repeated ones by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, repeated = 0, np.zeros(buckets, np.int64)
        for b in batches:
            fresh += int(b.column("n_windows").to_numpy().sum() - b.column("n_repeated").to_numpy().sum())
            repeated += np.bincount(np.frombuffer(b"".join(b.column("buckets").to_pylist()), np.int32), minlength=buckets)
        blocks = [(-1, np.array([fresh]))] + [(i, repeated[i : i + BLOCK]) for i in range(0, buckets, BLOCK)]
        blocks = [(i, x) for i, x in blocks if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int64()), pa.array([x.tobytes() for _, x in blocks], pa.binary())], names=["first", "counts"])

    return run


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for x in b.column("counts").to_pylist():
            v = np.frombuffer(x, np.int64)
            total = v + total if len(total) else v
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["first", "counts"])


def fit(features: DataFrame, buckets: int = BUCKETS) -> dict:
    """Log ratios of the target to the raw corpus: `new`, of any window that says something new; `repeated`, by bucket of a repeated one.

    features: n_windows, n_repeated, buckets of every document. Each split adds into arrays; these are added in two levels, and at most
    `buckets` + 1 counters reach the driver.
    """
    schema = "first long, counts binary"
    counted = features.select("n_windows", "n_repeated", "buckets").mapInArrow(_count(buckets), schema).withColumn("part", F.spark_partition_id() % 64)
    counted = counted.groupBy("first", "part").applyInArrow(_add, schema).groupBy("first").applyInArrow(_add, schema)
    fresh, repeated = 0, np.zeros(buckets)
    for r in counted.collect():
        v = np.frombuffer(bytes(r["counts"]), np.int64)
        if r["first"] < 0:
            fresh = int(v[0])
        else:
            repeated[r["first"] : r["first"] + len(v)] = v
    smooth = 2 * buckets * SMOOTH  # of new and of repeated features
    raw, target = fresh + repeated.sum() + smooth, fresh + smooth
    ratio = np.log(SMOOTH / target) - np.log((repeated + SMOOTH) / raw)
    return {"new": np.log(raw / target), "repeated": ratio, "most": ratio[repeated > 0].max(initial=-np.inf)}


def threshold(model: dict, share: float) -> float:
    """The largest ratio that a document with the share of repeated windows can have; below all if no window of the corpus is repeated."""
    return (1 - share) * model["new"] + share * model["most"]


def _score(model: dict, share: float):
    new, repeated, line = model["new"], model["repeated"], threshold(model, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, r = b.column("n_windows").to_numpy().astype(float), b.column("n_repeated").to_numpy().astype(float)
            row = np.repeat(np.arange(len(m)), r.astype(np.int64))
            at = np.frombuffer(b"".join(b.column("buckets").to_pylist()), np.int32)
            some = np.maximum(m, 1)
            ratio = ((m - r) * new + np.bincount(row, repeated[at], len(m))) / some
            found = (m > 0) & (ratio <= line + 1e-9)
            exact = found & (r >= share * m)  # the final check
            none = m == 0
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_windows"), b.column("n_repeated"), pa.array(r / some, mask=none), pa.array(ratio, mask=none), pa.array(found), pa.array(exact)], names=["id", "n_windows", "n_repeated", "share", "llr", "suspect", "repetitive"])

    return run


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, share: float = SHARE, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: id, n_windows, n_repeated, share, llr (per window), suspect (by the threshold), repetitive (checked).

    A document with fewer than n words (null and empty texts too) has no windows: share and ratio null, not repetitive. Copies of a
    row each come out, null ids too. Whole texts are read once, by one pass that writes the features (some bytes for each repeated window); nothing is
    shuffled but the counters.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)[doc_id]
    features, _ = materialize(rows.mapInArrow(_features(n, buckets), f"id {kind}, n_windows long, n_repeated long, buckets binary"), "windows")
    return features.mapInArrow(_score(fit(features, buckets), share), f"id {kind}, n_windows long, n_repeated long, share double, llr double, suspect boolean, repetitive boolean")
