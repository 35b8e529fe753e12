from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from trigrid.sources.badrows import split_rows, split_triplets

SCHEMA = "line_id long, hdr string, line_no int, raw_line string"


def reason_of(line: str | None, rows: int, cols: int) -> str | None:
    """Character by character."""
    if line is None:
        return "field_count"
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while i < len(line):
        if line[i] in " \t":
            i += 1
            continue
        if line[i] == '"':
            end = line.find('"', i + 1)
            if end < 0 or (end + 1 < len(line) and line[end + 1] not in " \t"):
                return "broken_quote"
            fields.append(line[i + 1 : end])
            i = end + 1
        else:
            end = i
            while end < len(line) and line[end] not in " \t":
                if line[end] == '"':
                    return "broken_quote"
                end += 1
            fields.append(line[i:end])
            i = end
    if len(fields) != 3:
        return "field_count"
    r, c, v = fields
    if not (re.fullmatch("[0-9]+", r) and re.fullmatch("[0-9]+", c)):
        return "bad_index"
    if not (1 <= int(r) <= rows and 1 <= int(c) <= cols):
        return "index_range"
    if not re.fullmatch(r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", v) or float(v) == float("inf"):
        return "bad_value"
    return None


def test_every_kind_of_line(spark):
    lines = [
        "1 2 3", "  1\t2  3 ", '"1" 2 "3"', "1 2 3\r", "1 2", "1 2 3 4", None, '1 2 "3', '1 "2"x 3', 'a"b" 1 2', "x 1 2", "1 -2 3", "٣ 1 2", "0 1 2",
        "11 1 2", "1 6 2", "99999999999999999999999 1 2", "00001 0002 3", "1 2 -3", "1 2 .5", "1 2 5.", "1 2 1e5", "1 2 1E-5", "1 2 1e999", "1 2 NaN", "1 2 inf",
        "1 2 3", '"1 1" 2 3', '"" 2 3', '"a "b" c', "1 2 3\n", "1 2 3\r\r", " % 1 2", "1 2 1e", '1 "2" 3"',
    ]
    rows = [(0, "f", 0, "%%MatrixMarket"), (1, "f", 1, ""), (2, "f", 2, " \t"), (3, "f", 3, "10 5 7"), *[(10 + i, "f", 10 + i, x) for i, x in enumerate(lines)], (900, "f", 900, "% 1 2 3")]
    random.Random(1).shuffle(rows)
    valid, failed = split_triplets(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r["line_id"]: r["reason"] for r in failed.collect()} | {r["line_id"]: None for r in valid.collect()}
    assert got == {10 + i: reason_of(x, 10, 5) for i, x in enumerate(lines)}
    assert {(r["row"], r["column"], r["value"]) for r in valid.collect()} >= {(1, 2, 3.0), (1, 2, 1e5), (1, 2, 1e-5)}


def test_random_lines_against_scan(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice('12 "\t.e-x\r') for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    lines = [x for x in lines if x.rstrip("\r" if x.endswith("\r") else "").strip(" \t") and not re.fullmatch(r"[ \t]*\r?", x)]
    rows = [(0, "f", 0, "3 3 9"), *[(i + 1, "f", i + 1, x) for i, x in enumerate(lines)]]
    valid, failed = split_triplets(spark.createDataFrame(rows, SCHEMA))
    got = {r["line_id"]: r["reason"] for r in failed.collect()} | {r["line_id"]: None for r in valid.collect()}
    assert got == {i + 1: reason_of(x, 3, 3) for i, x in enumerate(lines)}


def test_files_nulls_repeats_and_no_rows(spark):
    rows = [(1, None, 1, "2 2 1"), (2, None, 2, "1 1 1"), (3, None, 2, "3 1 1"), (4, "a", 1, "5 5 5"), (5, "a", 2, "5 5 1"), (6, "b", 1, "% only a comment"), (7, "a", 3, "x" * 100_000)]
    valid, failed = split_triplets(spark.createDataFrame(rows, SCHEMA).withColumn("fields", F.lit(1)).withColumn("row", F.lit("x")))
    assert {(r["line_id"], r["reason"]) for r in failed.collect()} == {(3, "index_range"), (7, "field_count")}
    assert {r["line_id"] for r in valid.collect()} == {2, 5}
    valid, failed = split_triplets(spark.createDataFrame([], SCHEMA))
    assert valid.count() == failed.count() == 0


def test_any_rules(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    good, bad = split_rows(df, [("missing", F.col("a").isNull()), ("number", F.col("a").try_cast("int").isNull())])
    assert [r["a"] for r in good.collect()] == ["1"]
    assert {(r["a"], r["reason"], tuple(r["errors"])) for r in bad.collect()} == {("x", "number", ("number",)), (None, "missing", ("missing", "number"))}
