from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigrid.llm import leakage
from trigrid.llm.leakage import aligned, leaked
from trigrid.llm.words import words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeéß漢ж") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randrange(5, 60))) for i in range(40)] + [(40, "a b c d e f g h i j k l m"), (41, None), (42, ""), (None, say(30)), (43, say(80))]
    items += [(44, items[3][1] + " " + say(20)), (3, items[3][1])]
    shout = lambda t: "".join(c.upper() if c.upper().lower() == c else c for c in t)  # noqa: E731  # the words stay what they are
    docs = []
    for i in range(200):
        t = say(rng.randrange(0, 200))
        if i % 3 == 0:
            w = rng.choice(items[:40])[1].split(" ")
            n = rng.choice([11, 12, 13, 30])
            at = rng.randrange(max(1, len(w) - n))
            t += rng.choice([" ", ". ", "\n- ", " (​"]) + rng.choice(["", "X "]) + shout(" ".join(w[at : at + n])) + " end " + say(5)
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "z a b c d e f g h i j k l y"), (203, say(30_000) + " " + items[43 if items[43][1] else 44][1]), (204, docs[3][1]), (None, items[0][1]), (3, docs[3][1])]
    return docs, items


def brute(docs, items, n=12):
    out = set()
    grams = [(i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) for i, t in items if i is not None and (w := words(t))]
    for d, t in docs:
        w = words(t)
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if d is not None:
            out |= {(d, i) for i, g in grams if own & g}
    return out


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    return leaked(d, spark.createDataFrame(items, "item_id long, text string"), **more)


def test_against_brute_force(spark, texts):
    docs, items = texts
    got = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items).where("shared_runs > 0").collect()}
    assert got == brute(docs, items) and len(got) > 50


@pytest.mark.parametrize("per_edit", [0, 15])
def test_other_budgets_lose_nothing(spark, texts, per_edit):
    docs, items = texts
    got = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items, per_edit=per_edit).where("shared_runs > 0").collect()}
    assert got == brute(docs, items) and len(got) > 50


def test_edited_passages_of_every_length_are_found(spark):
    """Runs of 12 words with as many edits as their length allows, anywhere, in one pack and in several."""
    rng = random.Random(5)
    words_ = ["".join(rng.choice("abcdeghé") for _ in range(rng.choice([2, 3, 5, 8, 12]))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words_) for _ in range(n))
    items = [(i, say(rng.randrange(12, 40))) for i in range(30)]
    docs, planted = [], {}
    for d in range(120):
        i, t = rng.choice(items)
        w = t.split(" ")
        at = rng.randrange(len(w) - 11)
        x = list(" ".join(w[at : at + 12]))
        for _ in range(max(1, len(x) // 30)):
            at = rng.choice([k for k in range(1, len(x) - 1) if x[k] != " " and x[k - 1] != " "])
            x[at : at + 1] = rng.choice([["z"], [], ["z", x[at]]])
        docs.append((d, f"{say(20)} {''.join(x)} {say(20)}"))
        planted[d] = i
    for most in (None, 300):
        with pytest.MonkeyPatch.context() as m:
            if most:
                m.setattr(leakage.pack_items, "__defaults__", (most,))
            got = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items).where("near").collect()}
        assert set(planted.items()) <= got
        assert all(any(leakage.near(" ".join(words(docs[d][1])), " ".join(w[k : k + 12]), max(1, len(" ".join(w[k : k + 12])) // 30)) for w in [items[i][1].split(" ")] for k in range(len(w) - 11)) for d, i in got)


def test_items_in_packs(spark, texts, monkeypatch):
    monkeypatch.setattr(leakage.pack_items, "__defaults__", (400,))
    docs, items = texts
    got = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items).where("shared_runs > 0").collect()}
    assert got == brute(docs, items) and len(got) > 50


def test_an_edit_within_the_passage(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    near = item.replace("foxtrot", "foxtrap")
    far = "quite another sentence about nothing that the item would have said at all here"
    rows = {r["doc_id"]: r for r in found(spark, [(1, f"x {near} y"), (2, far), (3, item)], [(7, item)]).collect()}
    assert set(rows) == {1, 3} and rows[1]["shared_runs"] == 0 and rows[3]["shared_runs"] == 1
    assert rows[3]["score"] == len(item)


def test_near_passages_of_every_length(spark, tmp_path):
    """p7_near gives short and long passages with an edit anywhere in them, and no long part of less than 12 words."""
    from trigrid.llm.queries import p7_near

    short = "to be or not to be it is the old dog so"
    long = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    mixed = "a b c d e f g h i j k l internationalisation telecommunications characteristically responsibilities"
    docs = [(1, f"x {short} y"), (2, f"x {short.replace('dog', 'dig')} y"), (3, "x " + long.replace("bravo", "bravq") + " y"), (4, "x " + long.replace("kilo", "kil") + " y")]
    docs += [(5, "x " + long.replace("golf", "golff") + " y"), (6, "x " + long.replace("bravo", "brrrr") + " y"), (7, "internationalisation telecommunications characteristically"), (8, "x tu be ur not to be it is the old dog so")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, short), (2, long), (3, mixed)], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in p7_near(spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)}


def test_near_against_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        doc, run = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))), "".join(rng.choice("ab") for _ in range(rng.randrange(4, 9)))
        row = [0] * (len(doc) + 1)
        for i, x in enumerate(run):
            new = [i + 1]
            for j, y in enumerate(doc):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        for edits in (0, 1, 2):
            assert leakage.near(doc, run, edits) == (min(row) <= edits)


def test_alignment_against_whole_matrix():
    """The banded score is that of the full local alignment where the band holds it."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        a = rng.integers(0, 3, 20).astype(np.uint64)
        b = a.copy()
        b[rng.integers(20)] = 9
        if rng.random() < 0.5:
            b = np.delete(b, rng.integers(20))
        s = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                if -2 <= i - j <= 2:
                    up = s[i - 1, j] if i - 1 - j >= -2 else -99
                    left = s[i, j - 1] if i - j + 1 <= 2 else -99
                    s[i, j] = max(0, s[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -2), up - 2, left - 2)
        z = np.array([0])
        got = aligned(a, b, z, np.array([len(a)]), np.array([-2]), np.array([len(b)]), z, 5)
        assert got[0] == s.max()


def test_nothing_leaks(spark):
    assert found(spark, [], [(1, "a " * 20)]).count() == 0
    assert found(spark, [(1, "a " * 20)], []).count() == 0
    assert found(spark, [(1, None)], [(1, None)]).count() == 0
