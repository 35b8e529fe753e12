from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigrid.llm.repetition import repeated_windows, repetition
from trigrid.llm.words import words

SCHEMA = "doc_id long, text string"


def brute(text, n=4):
    w = words(text)
    seen, again = set(), 0
    for i in range(len(w) - n + 1):
        x = tuple(w[i : i + n])
        again += x in seen
        seen.add(x)
    return max(0, len(w) - n + 1), again


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    out = []
    for i in range(300):
        t = say(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 4)):
            t += ". " + " ".join(t.split(" ")[: rng.randrange(1, 40)]).title()
        out.append((i, t))
    # exactly at the border: 10 windows, 3 of them repeated; and just below
    out += [(300, "a b c d e f a b c d e f g"), (301, "a b c d e f g a b c d e f"), (302, "a " * 50_000), (303, "one two three"), (304, ""), (305, None), (306, "­​"), (307, "ＡＢ cd ef gh ab cd ef gh ab cd ef gh"), (None, "x y z w x y z w x y z w"), (5, out[5][1])]
    return out


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).repartition(4)
    got = repetition(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((i, *brute(t)) for i, t in rows), key=key)
    assert sorted(((r["id"], r["n_windows"], r["n_repeated"]) for r in got), key=key) == want
    for r in got:
        n, a = r["n_windows"], r["n_repeated"]
        assert r["share"] == (a / n if n else None)
        assert r["repetitive"] == bool(n and 10 * a >= 3 * n)
    assert any(r["repetitive"] for r in got) and any(r["n_windows"] * 3 == r["n_repeated"] * 10 for r in got)


@pytest.mark.parametrize("buckets", [7, 65_536])
def test_ratio_against_brute_force(spark, rows, buckets):
    """The ratio is that of the two multinomials, no document above the share is missed by the threshold, and equal shares may differ in it."""
    from trigrid.llm.repetition import SMOOTH
    from trigrid.llm.words import Vocabulary, window_hashes

    features = []
    raw, target = {}, {}
    for _, t in rows:
        w = words(t)
        at = (window_hashes(Vocabulary().hashes(w), 4) % buckets).tolist()
        seen, own = set(), []
        for i, b in enumerate(at):
            x = tuple(w[i : i + 4])
            own.append((b, x in seen))
            raw[own[-1]] = raw.get(own[-1], 0) + 1
            if x not in seen:
                target[own[-1]] = target.get(own[-1], 0) + 1
            seen.add(x)
        features.append(own)
    all_raw, all_target = (sum(x.values()) + 2 * buckets * SMOOTH for x in (raw, target))
    p = lambda f: math.log((target.get(f, 0) + SMOOTH) / all_target) - math.log((raw.get(f, 0) + SMOOTH) / all_raw)
    want = sorted(round(sum(map(p, f)) / len(f), 9) for f in features if f)
    got = [r for r in repetition(spark.createDataFrame(rows, SCHEMA).repartition(3), buckets=buckets).collect() if r["n_windows"]]
    assert np.allclose(sorted(r["llr"] for r in got), want)
    assert all(r["suspect"] for r in got if 10 * r["n_repeated"] >= 3 * r["n_windows"])
    assert any(not r["suspect"] for r in got)
    if buckets > 7:
        shares = {}
        for r in got:
            shares.setdefault(r["share"], set()).add(round(r["llr"], 9))
        assert any(len(x) > 1 for s, x in shares.items() if s > 0)


def test_repeated_windows_of_a_long_text():
    rng = random.Random(1)
    for v in (3, 70_000):
        w = [str(rng.randrange(v)) for _ in range(90_000)]
        assert repeated_windows(w, 4).sum() == brute(" ".join(w))[1]


def test_a_corpus_without_repetition_or_rows(spark):
    assert repetition(spark.createDataFrame([], SCHEMA)).count() == 0
    got = repetition(spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k")], SCHEMA)).collect()
    assert not any(r["repetitive"] for r in got)
    got = repetition(spark.createDataFrame([(1, "a a a a a a a a a a a a")], SCHEMA)).collect()
    assert got[0]["repetitive"] and got[0]["n_repeated"] == 8
