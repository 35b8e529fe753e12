from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trigrid.llm import terms
from trigrid.llm.terms import joined_words, term_frequencies, with_marks

SCHEMA = "list_id long, line_no int, row_line string"


def words(line):
    import re

    w = [x for x in re.split("[ \t]+", line or "") if x]
    return "_".join(w[:2]) if w else None


def brute(rows):
    lines, records = defaultdict(set), defaultdict(set)
    for i, n, t in rows:
        if (w := words(t)) is not None:
            lines[w].add((i, n))
            records[w].add(i)
    return {w: (len(lines[w]), len(records[w])) for w in lines}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(rng.randrange(40), rng.randrange(30), rng.choice(["hot name", "hot  name extra", "\thot\tname ", "Hot name", f"g{rng.randrange(200)}", f"g{rng.randrange(5)} x", " ", "", None, "a b c"])) for _ in range(3000)]
    return [*out, *out[:500], (None, 1, "hot name"), (None, 2, "only null"), (77, 1, None), (78, None, "hot name"), (79, 1, "w " * 100_000)]


@pytest.mark.parametrize(("heavy", "share"), [(4096, 1e-3), (3, 1e-9), (1, 2.0)])
def test_counts(spark, rows, monkeypatch, heavy, share):
    """Whatever is taken as heavy, the counts are exact."""
    monkeypatch.setattr(terms, "HEAVY_TERMS", heavy)
    monkeypatch.setattr(terms, "HEAVY_SHARE", share)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("term", F.lit(1)).withColumn("lines", F.lit("x"))
    got = {r["term"]: (r["n_lines"], r["n_records"]) for r in term_frequencies(df, joined_words(F.col("row_line")), "list_id", ["line_no"]).collect()}
    assert got == brute(rows)


def test_marks(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    lists = df.where("list_id IS NOT NULL").select("list_id").distinct()
    n = lists.count()
    got = with_marks(term_frequencies(df, joined_words(F.col("row_line")), "list_id", ["line_no"]), lists).collect()
    for r in got:
        assert r["rare"] == (r["n_records"] < 3) and r["common"] == (r["n_records"] > n / 2)
    assert any(r["common"] for r in got) and any(r["rare"] for r in got)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = term_frequencies(df, joined_words(F.col("row_line")), "list_id", ["line_no"])
    assert with_marks(out, df.select("list_id")).count() == 0
