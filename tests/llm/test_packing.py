from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trigrid.llm.packing import TOKENIZER, across, best_fit, encoding, matched, pack


def fills(spark, sizes, capacity, range_rows):
    """Every item is in one container, none holds more than the capacity; the sums of the containers."""
    down = sorted(sizes, reverse=True)
    df = spark.createDataFrame(list(enumerate(down)), "item long, size long").repartition(3)
    got = [tuple(r) for r in best_fit(df, capacity, range_rows).collect()]
    assert sorted(i for i, _ in got) == list(range(len(down)))
    fill = np.bincount([c for _, c in got], [down[i] for i, _ in got])
    assert (fill <= capacity).all() and (fill > 0).all()
    return fill


@pytest.mark.parametrize("range_rows", [30, 100_000])
@pytest.mark.parametrize("sizes", [[40], [1] * 200, [21] * 9, [40, 40, 1], [3] * 50 + [37] * 20, [13] * 30 + [2] * 5], ids=lambda x: f"{len(x)}-items")
def test_every_item_is_placed_once(spark, sizes, range_rows):
    fill = fills(spark, sizes, 40, range_rows)
    best = -(-sum(sizes) // 40)
    assert len(fill) <= 1.7 * best + 1
    if len(set(sizes)) == 1:
        assert len(fill) == -(-len(sizes) // (40 // sizes[0]))


def test_ranges_make_no_difference(spark):
    """One range and many: as well filled, and near the least possible number of containers."""
    sizes = np.clip(np.random.default_rng(3).gamma(1.2, 120, 3000).astype(int), 1, 2048).tolist()
    best = -(-sum(sizes) // 2048)
    one, many = (len(fills(spark, sizes, 2048, r)) for r in (100_000, 500))
    assert best <= one <= 1.02 * best and best <= many <= 1.02 * best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.lists(st.integers(0, 60), max_size=6))
def test_ranges_match_as_the_whole(gap, cuts):
    """What ranges match by themselves and across them is what one sweep matches."""
    gap = np.array(gap, bool)
    items, gaps = matched(gap)
    whole = set(zip(items.tolist(), gaps.tolist(), strict=True))
    edges = sorted({0, len(gap), *(c for c in cuts if c < len(gap))})
    got, counts, left = set(), [], {}
    for part, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        i, g = matched(gap[a:b])
        got |= set(zip((i + a).tolist(), (g + a).tolist(), strict=True))
        free = sorted(set(range(a, b)) - set((i + a).tolist()) - set((g + a).tolist()))
        left[part] = ([x for x in free if gap[x]], [x for x in free if not gap[x]])
        counts.append((part, len(left[part][0]), len(left[part][1])))
    for part, at, n, q, last in across(counts):
        got |= {(left[part][1][at + r], left[q][0][last - r]) for r in range(n)}
    assert got == whole


@pytest.fixture
def docs(spark):
    rows = [(i, "word " * (i * 7 % 400 + 1)) for i in range(300)] + [(300 + i, "same text here") for i in range(400)]
    rows += [(700, None), (701, ""), (702, "x y " * 9000), (None, "no id"), (5, "an id again"), (5, "an id again")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("size", F.lit(1)).repartition(4)


@pytest.mark.parametrize("range_rows", [150, 100_000])
def test_pack(spark, docs, range_rows):
    got = pack(docs, capacity=256, range_rows=range_rows).collect()
    e = encoding(TOKENIZER)
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(e.encode_ordinary(r["text"])) if r["text"] else 0) for r in docs.collect())
    whole = sorted([(r["id"] is not None, r["id"] or 0, r["tokens"]) for r in got if r["piece"] == 0])
    assert [x[:2] for x in whole] == [x[:2] for x in want]
    fill = {}
    for r in got:
        if r["container_id"] is None:
            assert r["tokens"] == 0 and r["fill"] is None
        else:
            fill.setdefault(r["container_id"], []).append(r)
    assert sorted(fill) == list(range(len(fill)))
    for rs in fill.values():
        assert sum(r["tokens"] for r in rs) <= 256
        assert all(abs(r["fill"] - sum(x["tokens"] for x in rs) / 256) < 1e-12 for r in rs)
    assert sum(r["tokens"] for r in got) == sum(x[2] for x in want)
    long_ = sorted((r["piece"], r["first_token"], r["tokens"]) for r in got if r["id"] == 702)
    assert all(f == 256 * p for p, f, _ in long_) and all(t == 256 for _, _, t in long_[:-1])
    assert all(t <= 256 for *_, t in [(r["id"], r["tokens"]) for r in got])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty).count() == 0
    assert [r["container_id"] for r in pack(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [None]
