"""The data model: a sparse matrix as a table of triplets with named rows and columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_triplets(df: DataFrame, row: str = "row_id", col: str = "col_id", value: str = "value", distinct: bool = False) -> DataFrame:
    """(row_id, col_id, value) with one row per cell of the matrix.

    Null keys and values that are null, NaN or infinite are left out; triplets of the same cell add up. With `distinct`,
    exact copies of whole input rows count once. Zero sums are kept (an explicit zero is an entry, as in a triplet file).
    """
    if distinct:
        df = df.distinct()
    v = F.col(value).cast("double")
    ok = F.col(row).isNotNull() & F.col(col).isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    picked = df.where(ok).select(F.col(row).cast("long").alias("row_id"), F.col(col).cast("long").alias("col_id"), v.alias("value"))
    return picked.groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))


@dataclass
class MatrixSet:
    """coo (row_id, col_id, value), rows (row_id, name), cols (col_id, name, batch)."""

    coo: DataFrame
    rows: DataFrame
    cols: DataFrame

    @staticmethod
    def from_table(df: DataFrame, row: str, col: str, value: str, rows: DataFrame | None = None, cols: DataFrame | None = None, distinct: bool = False) -> MatrixSet:
        """From any table with a feature key, a sample key and a value; names default to the ids."""
        coo = clean_triplets(df, row, col, value, distinct)
        rows = rows if rows is not None else coo.select("row_id").distinct().withColumn("name", F.col("row_id").cast("string"))
        cols = cols if cols is not None else coo.select("col_id").distinct().withColumn("name", F.col("col_id").cast("string")).withColumn("batch", F.lit(None).cast("string"))
        return MatrixSet(coo, rows, cols)

    @staticmethod
    def from_mtx(spark: SparkSession, header: str) -> MatrixSet:
        """From a file set <header>.{mtx,rows,cols}.gz."""
        from trigrid.sources.mtx import fileset, read_names, read_triplets

        f = fileset(header)
        rows = read_names(spark, f["row"], 2, "_").withColumnRenamed("pos", "row_id")
        cols = read_names(spark, f["col"], 100, "@").withColumnRenamed("pos", "col_id").withColumn("batch", F.lit(None).cast("string"))
        return MatrixSet(read_triplets(spark, f["mtx"]), rows, cols)

    def to_mtx(self, header: str) -> dict[str, str]:
        """Write the file set <header>.*; returns its paths."""
        from trigrid.sources.mtx import write_fileset

        return write_fileset(self, header)

    def to_parquet(self, path: str) -> None:
        """Write coo range-partitioned by column, so that reads of column ranges skip files and row groups."""
        self.coo.repartitionByRange("col_id").sortWithinPartitions("col_id", "row_id").write.mode("overwrite").parquet(f"{path}/coo")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.cols.write.mode("overwrite").parquet(f"{path}/cols")

    @staticmethod
    def from_parquet(spark: SparkSession, path: str) -> MatrixSet:
        return MatrixSet(*(spark.read.parquet(f"{path}/{t}") for t in ("coo", "rows", "cols")))

    def aggregate(self, by: list[str], **exprs: Column) -> DataFrame:
        """Any aggregate over the triplets: the extension point for user statistics."""
        return self.coo.groupBy(*by).agg(*[e.alias(k) for k, e in exprs.items()])
