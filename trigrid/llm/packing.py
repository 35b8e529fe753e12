"""Containers of fixed capacity filled with items: bulk-synchronous best-fit.

Items are numbered from the largest down; as many containers are opened as the items fill at least (and one for each item of more than half of the
capacity), with the largest items. Then rounds follow, in which each gap takes at most one item. All open items and gaps are range-sorted by size, from the
largest down. Sweeping down, the gaps that were passed and not yet used lie on a stack, and an item takes the topmost: the smallest that holds it. Every range
is swept by itself and leaves items that found no gap in it, before gaps that found no item. How many of each a range leaves is all that is needed to
match them across ranges: the items of a range take the gaps of the ranges before it, again from the top of a stack, which is a stack of runs. So
a conflict about a gap is decided by rank, and placing the r-th item of a range in the r-th gap of another is a join. Gaps are updated, and the round repeats.
When no item fits into any gap, items are bundled in order (to about four for each container they fill) and new containers are opened.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrid.runtime import materialize, numbered, scratch

CAPACITY = 2048
#: A tokenizer file (ranks of a byte-level BPE); it has to be readable at this path on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Items and gaps aimed at in a range.
RANGE = 100_000
#: Bundles for each container they fill, where no item fits into a gap.
BUNDLES = 4
#: Fixed value: how a byte-level BPE splits a text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) for every row; a null or empty text has 0 tokens. Whole texts are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(tokenizer)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], names=["id", "tokens"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, tokens long")


GAP, ITEM, PLACED, COUNTS = 0, 1, 2, 3
#: A row of a round. GAP: id (container), value. ITEM: id, value. PLACED: id (item), other (container), value (what is left of the gap). COUNTS: of a range, see _sweep.
STATE = "part int, seq long, kind int, id long, other long, value long"


def matched(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gap: whether each element of a sequence is a gap (else an item). (position of an item, position of the gap it takes): the last gap before it that no item took."""
    stack: list[int] = []
    items, gaps = [], []
    for i, g in enumerate(gap.tolist()):
        if g:
            stack.append(i)
        elif stack:
            items.append(i)
            gaps.append(stack.pop())
    return np.array(items, np.int64), np.array(gaps, np.int64)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range -> what was placed in it; what is left, numbered in order; a row of counts: id gaps, other items, value their sizes, seq the largest of them."""
    part = TaskContext.get().partitionId()
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None:
        return
    kind, ids, value = (table.column(c).to_numpy() for c in ("kind", "id", "value"))
    item, gap = matched(kind == GAP)
    free = np.ones(len(kind), bool)
    free[item] = free[gap] = False
    g, i = np.flatnonzero(free & (kind == GAP)), np.flatnonzero(free & (kind == ITEM))
    none = np.zeros(0, np.int64)
    left = value[i]
    rows = [
        (np.arange(len(g)), GAP, ids[g], none, value[g]), (np.arange(len(i)), ITEM, ids[i], none, left), (none, PLACED, ids[item], ids[gap], value[gap] - value[item]),
        (np.array([left.max(initial=0)]), COUNTS, np.array([len(g)]), np.array([len(i)]), np.array([left.sum()])),
    ]
    for seq, what, a, b, v in rows:
        n = len(a)
        full = lambda x: x if len(x) == n else np.zeros(n, np.int64)  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(full(seq)), pa.array(np.full(n, what, np.int32)), pa.array(a), pa.array(full(b)), pa.array(v)], names=["part", "seq", "kind", "id", "other", "value"])


def across(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """counts: (range, gaps left, items left) in order. Runs (range of items, first item, number, range of gaps, last gap): the r-th item of a run takes the gap r before the last."""
    stack: list[list[int]] = []
    runs = []
    for part, gaps, items in counts:
        at = 0
        while at < items and stack:
            q, n = stack[-1]
            take = min(n, items - at)
            runs.append((part, at, take, q, n - 1))
            at += take
            if take == n:
                stack.pop()
            else:
                stack[-1][1] -= take
        if gaps:
            stack.append([part, gaps])
    return runs


def _meet(state: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """What items and gaps of different ranges come to: (part, seq, kind, id, other, value), PLACED rows, and the GAP and ITEM rows that are left."""
    run = np.array(sorted(runs), np.int64).reshape(-1, 5)
    first = (run[:, 0] << 40) | run[:, 1]

    def target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, seq = b.column("part").to_numpy().astype(np.int64), b.column("seq").to_numpy()
            at = np.maximum(np.searchsorted(first, (part << 40) | seq, "right") - 1, 0)
            off = seq - run[at, 1]
            some = (run[at, 0] == part) & (off >= 0) & (off < run[at, 2])
            yield pa.RecordBatch.from_arrays([pa.array(np.where(some, run[at, 3], -1).astype(np.int32)), pa.array(np.where(some, run[at, 4] - off, seq)), b.column("id"), b.column("value")], names=["part", "seq", "item", "size"])

    items = state.where(F.col("kind") == ITEM).mapInArrow(target, "part int, seq long, item long, size long")
    both = state.where(F.col("kind") == GAP).select("part", "seq", "id", "value").join(items, ["part", "seq"], "full")
    kind = F.when(F.col("item").isNull(), GAP).when(F.col("id").isNull(), ITEM).otherwise(PLACED)
    value = F.coalesce(F.col("value") - F.col("size"), "value", "size")
    return both.select("part", "seq", kind.alias("kind"), F.coalesce("item", "id").alias("id"), F.when(F.col("item").isNotNull(), F.col("id")).alias("other"), value.alias("value"))


def _row(kind: int, id_: str | Column, value: str | Column, other: str | Column | None = None) -> list[Column]:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return [F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(kind).alias("kind"), c(id_).cast("long").alias("id"), (c(other) if other is not None else F.lit(None)).cast("long").alias("other"), c(value).cast("long").alias("value")]


def _live(state: DataFrame) -> DataFrame:
    """Gaps and items of the next round: gaps that are placed in have what is left of them."""
    placed = state.where((F.col("kind") == PLACED) & (F.col("value") > 0)).select(*_row(GAP, "other", "value"))
    return state.where((F.col("kind") == ITEM) | ((F.col("kind") == GAP) & (F.col("value") > 0))).unionByName(placed)


def best_fit(items: DataFrame, capacity: int, range_rows: int = RANGE) -> DataFrame:
    """(item, container_id) for every row of items (item: 0.. from the largest down, size: 1..capacity). Containers are numbered 0.., too.

    The driver sees four numbers for each range and round.
    """
    spark = items.sparkSession
    n, whole, large = items.agg(F.count("*"), F.sum("size"), F.sum((F.col("size") * 2 > capacity).cast("long"))).first()
    if not n:
        return spark.createDataFrame([], "item long, container_id long")
    opened = min(n, max(large, -(-whole // capacity)))
    begun = F.col("item") < opened
    now = items.select(F.when(begun, GAP).otherwise(ITEM).alias("kind"), F.col("item").alias("id"), F.when(begun, F.lit(capacity) - F.col("size")).otherwise(F.col("size")).cast("long").alias("value")).where("value > 0")
    rows, left = n, n - opened
    paths: list[str] = []
    bundles: list[DataFrame] = []
    while left:
        parts = max(1, -(-rows // range_rows))
        keys = [F.desc("value"), "kind", "id"]
        swept = now.select("kind", "id", "value").repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_sweep, STATE)
        state, path = materialize(swept, "sweep")
        paths.append(path)
        counts = sorted((r["part"], r["id"], r["other"], r["value"], r["seq"]) for r in state.where(F.col("kind") == COUNTS).collect())  # one row for each range
        runs = across([c[:3] for c in counts])
        remain = sum(c[2] for c in counts) - sum(r[2] for r in runs)
        gaps = sum(c[1] for c in counts)
        if remain == left:  # nothing was placed
            size, largest = sum(c[3] for c in counts), max(c[4] for c in counts)
            new = max(1, -(-size // capacity))
            g = max(1, min(remain // (BUNDLES * new), capacity // largest))
            before = np.cumsum([0, *(c[2] for c in counts)])
            at = F.element_at(F.create_map(*[F.lit(int(x)) for c, b in zip(counts, before, strict=False) for x in (c[0], b)]), F.col("part")) + F.col("seq")
            loose = state.where(F.col("kind") == ITEM).select("id", "value", at.alias("at")).withColumn("bundle", F.floor(F.col("at") / g))
            heads = loose.groupBy("bundle").agg(F.min(F.struct("at", "id"))["id"].alias("head"), F.sum("value").alias("size")) if g > 1 else loose.select("bundle", F.col("id").alias("head"), F.col("value").alias("size"))
            heads, _ = materialize(heads, "bundles")
            if g > 1:
                bundles.append(loose.join(heads, "bundle").where("id <> head").select(F.col("id").alias("item"), "head"))
            number = -(-remain // g)
            new = min(new, number)
            start = F.col("bundle") < new
            container = F.col("bundle") + opened
            state, path = materialize(state.where(F.col("kind") == GAP).unionByName(heads.where(start).select(*_row(PLACED, "head", F.lit(capacity) - F.col("size"), container))).unionByName(heads.where(~start).select(*_row(ITEM, "head", "size"))), "opened")
            paths.append(path)
            opened += new
            left, rows = number - new, number + gaps
        elif runs:
            met, path = materialize(_meet(state, runs), "met")
            paths.append(path)
            state = state.where(F.col("kind") == PLACED).unionByName(met)
            left, rows = remain, remain + opened
        else:
            left, rows = remain, remain + opened
        now = _live(state)
    placed = items.where(begun).select("item", F.col("item").alias("container_id"))
    if paths:
        rounds = spark.read.schema(STATE).parquet(*paths)
        placed = placed.unionByName(rounds.where(F.col("kind") == PLACED).select(F.col("id").alias("item"), F.col("other").alias("container_id")))
    for members in reversed(bundles):
        placed = placed.unionByName(members.join(placed.withColumnRenamed("item", "head"), "head").select("item", "container_id"))
    return placed


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, range_rows: int = RANGE) -> DataFrame:
    """One row per piece of every row of docs: container_id, id, piece, first_token, tokens, fill (share of the container in use).

    A text of more than `capacity` tokens is split into full pieces and a rest; others stay whole. Texts without tokens
    (null, empty) come out with a null container_id and fill. Rows with the same or a null id are items of their own. No rows give none.
    """
    whole = F.col("tokens") > 0
    n_pieces = F.ceil(F.col("tokens") / F.lit(capacity)).cast("long")
    with scratch(docs.sparkSession) as keep:
        sized, _ = materialize(token_counts(docs, doc_id, text, tokenizer).withColumn("row", F.monotonically_increasing_id()), "sizes")
        pieces = sized.where(whole).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)))
        pieces = pieces.select("id", "row", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * capacity).alias("size"))
        ranked, _ = materialize(numbered(pieces.withColumn("down", -F.col("size")), ["down", "row", "piece"], "item", 0).select("item", "id", "piece", "first_token", "size"), "items")
        placed = best_fit(ranked.select("item", "size"), capacity, range_rows)
        empty = sized.where(~whole).select(F.lit(None).cast("long").alias("container_id"), "id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("first_token"), "tokens", F.lit(None).cast("double").alias("fill"))
        fill = F.sum("tokens").over(Window.partitionBy("container_id")) / F.lit(float(capacity))
        filled = ranked.join(placed, "item").select("container_id", "id", "piece", "first_token", F.col("size").alias("tokens")).withColumn("fill", fill)
        return keep(materialize(filled.unionByName(empty), "packed"))
