"""Projections of matrices: by column or row lists, by names, common names, concatenation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trigrid.matrixset import MatrixSet
from trigrid.operators.stats import TINY
from trigrid.runtime import lookup_join, numbered


def requested(spark, ids: list[int] | DataFrame) -> DataFrame:
    """(col_id, new_col): positions 1.. of a request list; of a repeated id the first."""
    if isinstance(ids, DataFrame):
        return ids
    seen: dict[int, int] = {}
    for i, x in enumerate(ids):
        seen.setdefault(int(x), i + 1)
    return spark.createDataFrame([(k, v) for k, v in seen.items()], "col_id long, new_col long")


def read_columns(coo: DataFrame, ids: list[int] | DataFrame, n_columns: int | None = None) -> DataFrame:
    """(row_id, col_id, value) of the requested columns, renumbered in the requested order; ids without entries or out of range give nothing."""
    req = requested(coo.sparkSession, ids)
    if n_columns is not None:
        req = req.where(F.col("col_id").between(1, n_columns))
    return lookup_join(coo, req, ["col_id"], "inner").select("row_id", F.col("new_col").alias("col_id"), "value")


def read_rows_columns(coo: DataFrame, rows: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """As read_columns, with the entries of the given rows (row_id) only; rows keep their ids."""
    return read_columns(lookup_join(coo, rows.select("row_id").distinct(), ["row_id"], "left_semi"), ids)


def dense_columns(coo: DataFrame, n_columns: int) -> DataFrame:
    """(row_id, c1..cn): one row per row with an entry; missing cells 0. n_columns is the number requested, so the width is given."""
    return coo.groupBy("row_id").agg(*[F.coalesce(F.sum(F.when(F.col("col_id") == i, F.col("value"))), F.lit(0.0)).alias(f"c{i}") for i in range(1, n_columns + 1)])


def column_range(coo: DataFrame, first: int, last: int) -> DataFrame:
    """Columns first..last, renumbered from 1: a range predicate that reaches the scan."""
    return coo.where(F.col("col_id").between(first, last)).withColumn("col_id", F.col("col_id") - F.lit(first - 1))


def filter_columns_by_nnz(m: MatrixSet, threshold: int = 1) -> MatrixSet:
    """Keep columns with at least `threshold` entries above TINY in size and number them 1.. in order."""
    nnz = m.coo.groupBy("col_id").agg(F.count_if(F.abs("value") > TINY).alias("nnz")).where(F.col("nnz") >= threshold)
    new = numbered(nnz.select("col_id"), ["col_id"], "new_id")
    coo = m.coo.join(new, "col_id").select("row_id", F.col("new_id").alias("col_id"), "value")
    cols = m.cols.join(new, "col_id").select(F.col("new_id").alias("col_id"), *[c for c in m.cols.columns if c != "col_id"])
    return MatrixSet(coo, m.rows, cols)


def select_rows(m: MatrixSet, names: list[str] | DataFrame) -> MatrixSet:
    """Rows whose name is in the list, in their order, numbered 1..; columns left without entries are dropped. Unknown names are ignored."""
    spark = m.coo.sparkSession
    want = names if isinstance(names, DataFrame) else spark.createDataFrame([(n,) for n in names], "name string")
    kept = lookup_join(m.rows, want.select("name").distinct(), ["name"], "left_semi")
    new = numbered(kept.select("row_id"), ["row_id"], "new_id")
    coo = lookup_join(m.coo, new, ["row_id"], "inner").select(F.col("new_id").alias("row_id"), "col_id", "value")
    rows = kept.join(new, "row_id").select(F.col("new_id").alias("row_id"), "name")
    return filter_columns_by_nnz(MatrixSet(coo, rows, m.cols), 1)


def select_columns(m: MatrixSet, names: list[str] | DataFrame) -> MatrixSet:
    """Columns whose name is in the list, in their order, numbered 1..; rows stay, empty columns too."""
    spark = m.coo.sparkSession
    want = names if isinstance(names, DataFrame) else spark.createDataFrame([(n,) for n in names], "name string")
    kept = lookup_join(m.cols, want.select("name").distinct(), ["name"], "left_semi")
    new = numbered(kept.select("col_id"), ["col_id"], "new_id")
    coo = lookup_join(m.coo, new, ["col_id"], "inner").select("row_id", F.col("new_id").alias("col_id"), "value")
    cols = kept.join(new, "col_id").select(F.col("new_id").alias("col_id"), *[c for c in m.cols.columns if c != "col_id"])
    return MatrixSet(coo, m.rows, cols)


def first_by_name(rows: DataFrame, id_: str = "row_id") -> DataFrame:
    """(name, id) with the first (smallest) id of each name; null names are left out."""
    return rows.where("name IS NOT NULL").groupBy("name").agg(F.min(id_).alias(id_))


def common_names(files: list[DataFrame], union: bool = False) -> DataFrame:
    """(name, pos): names in all files (or in any), sorted, with their rank from 1. Names are distinct within each file."""
    tagged = reduce(DataFrame.unionByName, [f.select("name").where("name IS NOT NULL").distinct() for f in files])
    n = tagged.groupBy("name").agg(F.count("*").alias("n"))
    return numbered((n if union else n.where(F.col("n") == len(files))).select("name"), ["name"], "pos")


def relocate(m: MatrixSet, target: DataFrame) -> DataFrame:
    """Triplets with the row_id of the target (name, pos): rows are matched by name, unmatched ones dropped; entries that meet add up."""
    local = m.rows.where("name IS NOT NULL").select("row_id", "name")
    to = local.join(target.select("name", "pos"), "name").select("row_id", "pos")
    return lookup_join(m.coo, to, ["row_id"], "inner").groupBy(F.col("pos").alias("row_id"), "col_id").agg(F.sum("value").alias("value"))


def rbind(top: MatrixSet, bottom: MatrixSet) -> MatrixSet:
    """One matrix above the other, on the column names of both in top's order. Row names must not meet."""
    if not top.rows.select("name").join(bottom.rows.select("name"), "name").isEmpty():
        raise ValueError("row names of the two matrices overlap")
    a, b = first_by_name(top.cols, "col_id"), first_by_name(bottom.cols, "col_id")
    both = a.join(b.withColumnRenamed("col_id", "other"), "name")
    new = numbered(both, ["col_id"], "new_id")
    offset = top.rows.agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0]
    up = top.coo.join(new.select("col_id", "new_id"), "col_id").select("row_id", F.col("new_id").alias("col_id"), "value")
    down = bottom.coo.join(new.select(F.col("other").alias("col_id"), "new_id"), "col_id").select((F.col("row_id") + offset).alias("row_id"), F.col("new_id").alias("col_id"), "value")
    rows = top.rows.select("row_id", "name").unionByName(bottom.rows.select((F.col("row_id") + offset).alias("row_id"), "name"))
    cols = new.select(F.col("new_id").alias("col_id"), "name").withColumn("batch", F.lit(None).cast("string"))
    return MatrixSet(up.unionByName(down), rows, cols)


def hcat(left: DataFrame, right: DataFrame, n_left: int) -> DataFrame:
    return left.unionByName(right.withColumn("col_id", F.col("col_id") + n_left))


def vcat(top: DataFrame, bottom: DataFrame, n_top: int) -> DataFrame:
    return top.unionByName(bottom.withColumn("row_id", F.col("row_id") + n_top))


def control_mask(rows: DataFrame, controls: DataFrame, least: int = 10) -> DataFrame:
    """(row_id, neg, pos): neg marks control rows, pos the others. With fewer than `least` controls found, neg is 1 everywhere and pos stays."""
    flagged = lookup_join(rows.select("row_id", "name"), controls.select("name").distinct().withColumn("__c", F.lit(1.0)), ["name"])
    found = flagged.where("__c = 1").count()
    neg = F.coalesce("__c", F.lit(0.0))
    return flagged.select("row_id", (neg if found >= least else F.lit(1.0)).alias("neg"), (1 - neg).alias("pos"))


def delta_rows(log_delta: DataFrame, least: float = 1e-2) -> DataFrame:
    """Rows of (row_id, v) whose mean exp(v) is above the bound."""
    return log_delta.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.exp(x)) / F.size("v") > least)


def first_appearance(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, pos): keys numbered 1.. by the smallest `order` they appear with; ties by key. Null keys are left out."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__o"))
    return numbered(first, ["__o", key], "pos").select(key, "pos")


def down_sample(df: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows of each group, those with the smallest hashes of (key, seed). The cap per partition comes before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
