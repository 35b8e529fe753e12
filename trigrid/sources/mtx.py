"""Matrix-Market file sets: <hdr>.mtx.gz, .rows.gz, .cols.gz. Plain, gzip and blocked gzip (many members) are read alike; inputs are never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrid.matrixset import MatrixSet
from trigrid.runtime import numbered

#: Fixed value: the first line of a triplet file, float values or not.
BANNER = "%%MatrixMarket matrix coordinate integer general"


def fileset(header: str) -> dict[str, str]:
    return {"mtx": f"{header}.mtx.gz", "row": f"{header}.rows.gz", "col": f"{header}.cols.gz", "idx": f"{header}.mtx.gz.index"}


def words_joined(line: Column, most: int, sep: str) -> Column:
    """The first `most` words of a line joined by sep; words are separated by white space."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), 1, most), sep)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): the lines of one text file with their numbers from 1. One unsplittable file is one task, so its order is that of reading."""
    lines = spark.read.text(path, wholetext=False).withColumn("__at", F.monotonically_increasing_id())
    return numbered(lines, ["__at"], "pos").select("pos", F.col("value").alias("line"))


def read_names(spark: SparkSession, path: str, most: int = 2, sep: str = "_") -> DataFrame:
    """(pos, name) of a name file. An empty line is an error."""
    names = read_lines(spark, path).select("pos", words_joined(F.col("line"), most, sep).alias("name"))
    if not names.where("name = ''").isEmpty():
        raise ValueError(f"empty line in {path}")
    return names


def row_names(spark: SparkSession, path: str, most: int = 2, sep: str = "_") -> DataFrame:
    return read_names(spark, path, most, sep)


def column_names(spark: SparkSession, path: str, most: int = 100, sep: str = "@") -> DataFrame:
    return read_names(spark, path, most, sep)


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    return lines.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"))


def info(spark: SparkSession, path: str) -> dict[str, int]:
    """max_row, max_col, max_elem: from the first line that is no comment; the scan ends there."""
    r = _tokens(spark, path).where(F.size("f") >= 3).limit(1).first()
    if r is None:
        raise ValueError(f"no dimension line in {path}")
    return dict(zip(("max_row", "max_col", "max_elem"), (int(x) for x in r["f"][:3]), strict=True))


def scan_triplets(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(row_id, col_id, value) in file order, ids from 1. Comments, incomplete lines, entries beyond the dimensions and what doesn't parse are skipped.

    A gzip file is one task; `partitions` spreads its rows by column for what follows.
    """
    dims = info(spark, path)
    t = _tokens(spark, path).where(F.size("f") >= 3).withColumn("__at", F.monotonically_increasing_id())
    first = t.select("__at").limit(1).first()[0]  # the dimension line
    row, col, val = (F.get("f", F.lit(i)) for i in range(3))
    out = t.where(F.col("__at") != first).select(row.try_cast("long").alias("row_id"), col.try_cast("long").alias("col_id"), val.try_cast("double").alias("value"))
    out = out.where(F.col("row_id").between(1, dims["max_row"]) & F.col("col_id").between(1, dims["max_col"]) & F.col("value").isNotNull())
    return out.repartition(partitions, "col_id") if partitions else out


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return scan_triplets(spark, path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of a plain or gzip file: (pos, line)."""
    return read_lines(spark, path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of fields separated by white space, gzip by extension; null where a field is missing or doesn't parse."""
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"))
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return lines.select(*[F.get("f", F.lit(i)).try_cast(x.dataType).alias(x.name) for i, x in enumerate(fields)])


def write_table(df: DataFrame, path: str, sep: str = " ") -> None:
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns])).write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").text(path)


def _write_one(lines: DataFrame, path: str) -> None:
    """Write (value) of few sorted partitions as parts in order, then join the parts' bytes into one file: gzip members may follow each other."""
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tmp = f"{path}.parts"
    lines.write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").text(tmp)
    src, dst = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path)
    fs = src.getFileSystem(conf)
    out = fs.create(dst, True)
    for s in sorted((s for s in fs.listStatus(src) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName()):
        part = fs.open(s.getPath())
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
        part.close()
    out.close()
    fs.delete(src, True)


def write_mtx(coo: DataFrame, path: str, n_rows: int | None = None, n_cols: int | None = None) -> str:
    """Write triplets by column, then row, ids from 1. Dimensions default to the largest ids. Sorting is by ranges; no task holds all rows."""
    r = coo.agg(F.max("row_id").alias("r"), F.max("col_id").alias("c"), F.count("*").alias("n")).first()
    head = f"{BANNER}\n{n_rows or r['r'] or 0} {n_cols or r['c'] or 0} {r['n']}"
    spark = coo.sparkSession
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    body = coo.select(F.col("col_id").alias("a"), F.col("row_id").alias("b"), F.concat_ws(" ", F.col("row_id").cast("string"), F.col("col_id").cast("string"), number).alias("value"))
    first = spark.createDataFrame([(-1, -1, head)], "a long, b long, value string")
    _write_one(first.unionByName(body).repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("value"), path)
    return path


def write_names(names: DataFrame, path: str, order: str | list[str]) -> str:
    by = [order] if isinstance(order, str) else order
    _write_one(names.repartitionByRange(*by).sortWithinPartitions(*by).select(F.coalesce("name", F.lit("NA")).alias("value")), path)
    return path


def write_fileset(m: MatrixSet, header: str, drop_empty: bool = False) -> dict[str, str]:
    """The three files of a matrix. drop_empty: columns without a value above 0 are left out and the others renumbered."""
    f = fileset(header)
    if drop_empty:
        from trigrid.operators.select import filter_columns_by_nnz

        kept = filter_columns_by_nnz(MatrixSet(m.coo.where("value > 0"), m.rows, m.cols), 1)
        old = numbered(m.coo.where("value > 0").select("col_id").distinct(), ["col_id"], "new_id")
        m = MatrixSet(m.coo.join(old, "col_id").select("row_id", F.col("new_id").alias("col_id"), "value"), m.rows, kept.cols)
    n_rows, n_cols = (d.agg(F.max(c)).first()[0] for d, c in ((m.rows, "row_id"), (m.cols, "col_id")))
    write_mtx(m.coo, f["mtx"], n_rows, n_cols)
    write_names(m.rows, f["row"], "row_id")
    write_names(m.cols, f["col"], "col_id")
    return {k: f[k] for k in ("mtx", "row", "col")}


def read_matrix(spark: SparkSession, header: str, columns: list[int] | None = None) -> DataFrame:
    """Triplets of a file set: all columns, or the given ones (no repeats), renumbered in their order."""
    coo = scan_triplets(spark, fileset(header)["mtx"])
    if columns is None:
        return coo
    if len(set(columns)) != len(columns):
        raise ValueError("repeated columns")
    from trigrid.operators.select import read_columns

    return read_columns(coo, columns)


def read_dense(spark: SparkSession, header: str, columns: list[int]) -> DataFrame:
    """(row_id, c1..cn): the given columns of a file set (no repeats) as a dense matrix; rows without entries are left out, missing cells are 0."""
    from trigrid.operators.select import dense_columns

    return dense_columns(read_matrix(spark, header, columns), len(columns))


def from_arrays(spark: SparkSession, rows, cols, values, row_names: list[str]) -> MatrixSet:
    """An in-memory matrix: 1-based coordinates, values, row names."""
    import pandas as pd

    coo = spark.createDataFrame(pd.DataFrame({"row_id": rows, "col_id": cols, "value": values}).astype({"row_id": "int64", "col_id": "int64", "value": "float64"}))
    names = spark.createDataFrame([(i + 1, n) for i, n in enumerate(row_names)], "row_id long, name string")
    return MatrixSet.from_table(coo, "row_id", "col_id", "value", names)
