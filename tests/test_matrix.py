from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from trigrid import MatrixSet
from trigrid.operators import select, stats
from trigrid.sources import mtx


@pytest.fixture
def small(spark):
    coo = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (2, 1, 1.0), (3, 3, -4.0), (2, 4, 0.5), (None, 1, 1.0), (1, None, 1.0), (1, 2, None), (1, 2, float("nan")), (1, 2, float("inf"))], "r long, c long, v double").withColumn("value", F.lit("clash"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "row_id long, name string")
    cols = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, "z", "q"), (4, "w", "q"), (5, "u", None)], "col_id long, name string, batch string")
    return MatrixSet.from_table(coo, "r", "c", "v", rows, cols)


def cells(coo):
    return {(r["row_id"], r["col_id"]): r["value"] for r in coo.collect()}


def test_triplets_are_cleaned_and_added(small, spark):
    assert cells(small.coo) == {(1, 1): 5.0, (2, 1): 1.0, (3, 3): -4.0, (2, 4): 0.5}
    twice = spark.createDataFrame([(1, 1, 2.0, "t"), (1, 1, 2.0, "t"), (1, 1, 2.0, "u")], "r long, c long, v double, t string")
    assert cells(MatrixSet.from_table(twice, "r", "c", "v", distinct=True).coo) == {(1, 1): 4.0}


def test_file_set_round_trip(small, spark, tmp_path):
    header = f"{tmp_path}/set"
    files = small.to_mtx(header)
    assert mtx.info(spark, files["mtx"]) == {"max_row": 4, "max_col": 5, "max_elem": 4}
    with gzip.open(files["mtx"], "rt") as f:
        lines = f.read().splitlines()
    assert lines[0] == mtx.BANNER and lines[1] == "4 5 4" and lines[2:] == ["1 1 5", "2 1 1", "3 3 -4", "2 4 0.5"]
    back = MatrixSet.from_mtx(spark, header)
    assert cells(back.coo) == cells(small.coo)
    assert [r["name"] for r in back.rows.orderBy("row_id").collect()] == ["a", "b", "c", "NA"]
    assert cells(mtx.read_matrix(spark, header, [4, 1])) == {(2, 1): 0.5, (1, 2): 5.0, (2, 2): 1.0}
    with pytest.raises(ValueError):
        mtx.read_matrix(spark, header, [1, 1])
    small.to_parquet(f"{tmp_path}/pq")
    assert cells(MatrixSet.from_parquet(spark, f"{tmp_path}/pq").coo) == cells(small.coo)


def test_columns_without_positive_values_are_dropped(small, spark, tmp_path):
    mtx.write_fileset(small, f"{tmp_path}/s", drop_empty=True)
    assert cells(mtx.read_matrix(spark, f"{tmp_path}/s")) == {(1, 1): 5.0, (2, 1): 1.0, (2, 2): 0.5}
    assert [r["name"] for r in mtx.column_names(spark, f"{tmp_path}/s.cols.gz").orderBy("pos").collect()] == ["x", "w"]


def test_scanner_skips_what_is_no_entry(spark, tmp_path):
    path = f"{tmp_path}/m.mtx.gz"
    text = "%%MatrixMarket\n%c\n3 3 4\n1 1 1\n% late\n2 2\n4 1 1\n1 4 1\nx 1 1\n1 1 y\n3\t3  2.5\n"
    with open(path, "wb") as f:  # blocked gzip: members that follow each other
        f.write(gzip.compress(text[:30].encode()) + gzip.compress(text[30:].encode()))
    assert cells(mtx.scan_triplets(spark, path)) == {(1, 1): 1.0, (3, 3): 2.5}
    assert cells(mtx.scan_triplets(spark, path, 3)) == {(1, 1): 1.0, (3, 3): 2.5}


def test_names(spark, tmp_path):
    p = tmp_path / "n"
    p.write_text("a b c\n  d\t e  \nf\n")
    assert [r["name"] for r in mtx.row_names(spark, str(p)).orderBy("pos").collect()] == ["a_b", "d_e", "f"]
    assert [r["name"] for r in mtx.column_names(spark, str(p)).orderBy("pos").collect()] == ["a@b@c", "d@e", "f"]
    p.write_text("a\n\nb\n")
    with pytest.raises(ValueError):
        mtx.row_names(spark, str(p))


def test_tables(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("1 a 2.5\n2  b\nx c 3\n")
    assert [tuple(r) for r in mtx.read_table(spark, str(p), "i long, s string, v double").collect()] == [(1, "a", 2.5), (2, "b", None), (None, "c", 3.0)]


def test_requests(small):
    assert cells(select.read_columns(small.coo, [4, 1, 4, 99])) == {(2, 1): 0.5, (1, 2): 5.0, (2, 2): 1.0}
    assert cells(select.read_rows_columns(small.coo, small.rows.where("name = 'b'"), [1, 4])) == {(2, 1): 1.0, (2, 2): 0.5}
    dense = {r["row_id"]: (r["c1"], r["c2"], r["c3"]) for r in select.dense_columns(select.read_columns(small.coo, [1, 2, 3]), 3).collect()}
    assert dense == {1: (5.0, 0.0, 0.0), 2: (1.0, 0.0, 0.0), 3: (0.0, 0.0, -4.0)}


def test_selections(small, spark):
    got = select.select_rows(small, ["c", "b", "unknown"])
    assert cells(got.coo) == {(1, 1): 1.0, (2, 2): -4.0, (1, 3): 0.5}
    assert [r["name"] for r in got.rows.orderBy("row_id").collect()] == ["b", "c"]
    assert [r["name"] for r in got.cols.orderBy("col_id").collect()] == ["x", "z", "w"]
    got = select.select_columns(small, ["w", "y", "x"])
    assert cells(got.coo) == {(1, 1): 5.0, (2, 1): 1.0, (2, 3): 0.5}
    assert [r["name"] for r in got.cols.orderBy("col_id").collect()] == ["x", "y", "w"]
    got = select.filter_columns_by_nnz(small, 2)
    assert cells(got.coo) == {(1, 1): 5.0, (2, 1): 1.0}


def test_catalog(small):
    cat = stats.column_catalog(small.coo)
    assert [tuple(r) for r in cat.orderBy("col_id").collect()] == [(1, 2, 0), (3, 1, 2), (4, 1, 3)]
    full = {r["col_id"]: r["first_offset"] for r in stats.complete_catalog(cat, 5).collect()}
    assert full == {1: 0, 2: 2, 3: 2, 4: 3, 5: None}
    assert stats.check_catalog(small.coo, cat)
    assert not stats.check_catalog(small.coo, cat.withColumn("first_offset", F.col("first_offset") + 1))


def test_catalog_over_many_ranges(spark):
    coo = spark.range(20_000).select(F.lit(1).alias("row_id"), (F.col("id") * 3 % 20_011 + 1).alias("col_id"), F.lit(1.0).alias("value"))
    got = [r["first_offset"] for r in stats.column_catalog(coo).orderBy("col_id").collect()]
    assert got == list(range(20_000))


def test_names_and_concatenation(small, spark):
    other = spark.createDataFrame([(1, "b"), (2, "d"), (3, "b"), (4, None)], "row_id long, name string")
    names = lambda u: [tuple(r) for r in select.common_names([small.rows, other], u).orderBy("pos").collect()]
    assert names(False) == [("b", 1)] and names(True) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert cells(select.relocate(MatrixSet(small.coo, other, small.cols), select.common_names([other]))) == {(1, 1): 5.0, (2, 1): 1.0, (1, 3): -4.0, (2, 4): 0.5}
    low = MatrixSet(small.coo, other.where("name <> 'b'"), spark.createDataFrame([(4, "x"), (1, "nowhere")], "col_id long, name string"))
    got = select.rbind(small, low)
    assert cells(got.coo) == {(1, 1): 5.0, (2, 1): 1.0, (6, 1): 0.5}
    with pytest.raises(ValueError):
        select.rbind(small, MatrixSet(small.coo, other, small.cols))
    assert cells(select.hcat(small.coo, small.coo, 5))[3, 8] == -4.0 and cells(select.vcat(small.coo, small.coo, 4))[7, 3] == -4.0


def test_masks_and_samples(small, spark):
    few = {r["row_id"]: (r["neg"], r["pos"]) for r in select.control_mask(small.rows, spark.createDataFrame([("a",)], "name string")).collect()}
    assert few == {1: (1.0, 0.0), 2: (1.0, 1.0), 3: (1.0, 1.0), 4: (1.0, 1.0)}
    some = {r["row_id"]: (r["neg"], r["pos"]) for r in select.control_mask(small.rows, spark.createDataFrame([("a",)], "name string"), 1).collect()}
    assert some[1] == (1.0, 0.0) and some[2] == (0.0, 1.0)
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = select.down_sample(df, "g", "id", 50, 1)
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {0: 50, 1: 50, 2: 50}
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in select.down_sample(df.repartition(7), "g", "id", 50, 1).collect())
    assert [tuple(r) for r in select.first_appearance(small.cols, "batch", "col_id").orderBy("pos").collect()] == [("p", 1), ("q", 2)]


def test_empty_tables(spark):
    coo = spark.createDataFrame([], "row_id long, col_id long, value double")
    m = MatrixSet.from_table(coo, "row_id", "col_id", "value")
    for df in (stats.row_stat(m.coo), stats.row_col_stat(m.coo), stats.column_catalog(m.coo), select.filter_columns_by_nnz(m).coo, select.select_rows(m, ["a"]).coo, select.read_columns(m.coo, [1])):
        assert df.count() == 0
