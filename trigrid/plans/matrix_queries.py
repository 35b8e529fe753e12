"""Queries of the matrix toolkit: sources, selections, statistics, normalisers, projections, graphs of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrid.functions import special as sp
from trigrid.functions.vectors import v_argmax, v_log_softmax, v_log_softmax_weighted, v_softmax
from trigrid.matrixset import MatrixSet
from trigrid.operators import graph, linalg, normalize, select, stats, topics
from trigrid.plans import views as v
from trigrid.plans.views import BUCKETS, CELLS, EDGES, K, M, X, X10, Y, rounded, wide, wide_sql
from trigrid.runtime import materialize, release, shared_dir
from trigrid.sources import mtx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- sources and selections ----


@query(f"WITH {M} SELECT max(row_id) AS max_row, max(col_id) AS max_col, count(*) AS max_elem FROM m")
def s1_info(spark: SparkSession, d: str) -> DataFrame:
    """Written as a file, the dimensions read back from its header."""
    path = f"{shared_dir(spark)}/s1.mtx.gz"
    mtx.write_mtx(v.coo(spark, d), path)
    i = mtx.info(spark, path)
    release(spark, path)
    return spark.createDataFrame([tuple(i.values())], "max_row long, max_col long, max_elem long")


_WORDS = r"SELECT {keys}, array_to_string(regexp_split_to_array(trim(regexp_replace({line}, '\s+', ' ', 'g')), ' ')[1:{n}], '{sep}') AS name FROM {table} WHERE {line} IS NOT NULL"


@query(_WORDS.format(keys="list_id, line_no", line="row_line", n=2, sep="_", table="row_lists"))
def s2_rownames(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "row_lists").where("row_line IS NOT NULL").select("list_id", "line_no", mtx.words_joined(F.col("row_line"), 2, "_").alias("name"))


@query(_WORDS.format(keys="col_id", line="name", n=100, sep="@", table="matrix_cols"))
def s3_colnames(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "matrix_cols").where("name IS NOT NULL").select("col_id", mtx.words_joined(F.col("name"), 100, "@").alias("name"))


@query(f"WITH {M} SELECT row_id, col_id, value FROM m WHERE row_id >= 1 AND col_id >= 1")
def s4_write_read_mtx(spark: SparkSession, d: str) -> DataFrame:
    """Triplets written as a Matrix-Market file and scanned again."""
    path = f"{shared_dir(spark)}/s4.mtx.gz"
    mtx.write_mtx(v.coo(spark, d).where("row_id >= 1 AND col_id >= 1"), path)
    out, _ = materialize(mtx.scan_triplets(spark, path), "scanned")
    release(spark, path)
    return out


@query(f"WITH {Y}, r AS (SELECT col_id, row_number() OVER (ORDER BY col_id DESC) AS new_col FROM (SELECT DISTINCT col_id FROM y)) SELECT row_id, new_col AS col_id, value FROM y JOIN r USING (col_id)")
def s5_read_columns(spark: SparkSession, d: str) -> DataFrame:
    """All columns that have entries, requested from the last to the first."""
    y, _ = materialize(v.counts(spark, d), "counts")  # read for the request and again for its columns
    ids = y.select((-F.col("col_id")).alias("neg")).distinct()
    from trigrid.runtime import numbered

    req = numbered(ids, ["neg"], "new_col").select((-F.col("neg")).alias("col_id"), "new_col")
    return select.read_columns(y, req)


_TOP = "t AS (SELECT col_id, row_number() OVER (ORDER BY count(*) DESC, col_id) AS k FROM y GROUP BY col_id QUALIFY k <= 5)"
_DENSE = ", ".join(f"coalesce(sum(CASE WHEN k = {i} THEN value END), 0) AS c{i}" for i in range(1, 6))


def _fullest(y: DataFrame) -> DataFrame:
    ids = [r[0] for r in y.groupBy("col_id").count().orderBy(F.desc("count"), "col_id").limit(5).collect()]
    return select.requested(y.sparkSession, ids)


@query(f"WITH {Y}, {_TOP} SELECT row_id, {_DENSE} FROM y JOIN t USING (col_id) GROUP BY row_id")
def s6_read_columns_dense(spark: SparkSession, d: str) -> DataFrame:
    """The five columns with the most entries, as a dense matrix."""
    y = v.counts(spark, d)
    return select.dense_columns(select.read_columns(y, _fullest(y)), 5)


@query(f"WITH {Y}, {_TOP} SELECT row_id, k AS col_id, value FROM y JOIN t USING (col_id) WHERE row_id IN (SELECT row_id FROM matrix_rows WHERE name IS NOT NULL)")
def s7_read_rows_columns(spark: SparkSession, d: str) -> DataFrame:
    y = v.counts(spark, d)
    return select.read_rows_columns(y, v.table(spark, d, "matrix_rows").where("name IS NOT NULL"), _fullest(y))


_CATALOG = f"{M}, cat AS (SELECT col_id, count(*) AS nnz, CAST(sum(count(*)) OVER (ORDER BY col_id) - count(*) AS BIGINT) AS first_offset FROM m GROUP BY col_id)"


@query(f"WITH {_CATALOG} SELECT * FROM cat")
def s8_build_index(spark: SparkSession, d: str) -> DataFrame:
    return stats.column_catalog(v.coo(spark, d))


@query(f"WITH {_CATALOG} SELECT r.col_id, (SELECT min(first_offset) FROM cat WHERE cat.col_id >= r.col_id) AS first_offset FROM range(1, (SELECT max(col_id) + 1 FROM matrix_cols)) r(col_id)")
def s9_read_index(spark: SparkSession, d: str) -> DataFrame:
    n = v.table(spark, d, "matrix_cols").agg(F.max("col_id")).first()[0]
    return stats.complete_catalog(stats.column_catalog(v.coo(spark, d)), n)


@query("SELECT true AS ok")
def s10_check_index(spark: SparkSession, d: str) -> DataFrame:
    m = v.coo(spark, d)
    return spark.createDataFrame([(stats.check_catalog(m, stats.column_catalog(m)),)], "ok boolean")


_LISTED = r"w AS (SELECT DISTINCT array_to_string(regexp_split_to_array(trim(regexp_replace(row_line, '\s+', ' ', 'g')), ' ')[1:2], '_') AS name FROM row_lists WHERE row_line IS NOT NULL)"
_SQUEEZE = "q AS (SELECT col_id, row_number() OVER (ORDER BY col_id) AS new_col FROM s GROUP BY col_id HAVING count(CASE WHEN abs(value) > 1e-8 THEN 1 END) >= {n})"


@query(f"WITH {Y}, {_LISTED}, r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS new_row FROM matrix_rows WHERE name IN (SELECT name FROM w)), s AS (SELECT new_row, col_id, value FROM y JOIN r USING (row_id)), {_SQUEEZE.format(n=1)}, c2 AS (SELECT DISTINCT col_id FROM matrix_cols) SELECT new_row AS row_id, new_col AS col_id, value FROM s JOIN q USING (col_id)")
def s11_copy_selected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose names stand in row_lists; columns left empty are dropped."""
    return select.select_rows(v.matrix_set(spark, d), s2_rownames(spark, d).select("name")).coo


@query(f"WITH {Y}, {CELLS}, q AS (SELECT col_id, row_number() OVER (ORDER BY col_id) AS new_col FROM cells WHERE name IN (SELECT name FROM cells WHERE batch <> 'none')) SELECT row_id, new_col AS col_id, value FROM y JOIN q USING (col_id)")
def s12_copy_selected_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns by the names of the cells with a known batch."""
    m = v.matrix_set(spark, d)
    return select.select_columns(m, m.cols.where("batch <> 'none'").select("name")).coo


@query(f"WITH {M}, s AS (SELECT * FROM m), {_SQUEEZE.format(n=10)} SELECT row_id, new_col AS col_id, value FROM s JOIN q USING (col_id)")
def s13_filter_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns with ten entries at least."""
    m = v.matrix_set(spark, d)
    return select.filter_columns_by_nnz(MatrixSet(v.coo(spark, d), m.rows, m.cols), 10).coo


def _fileset(spark: SparkSession, d: str, name: str) -> tuple[str, dict[str, str]]:
    """A file set of the counts whose columns keep their ids."""
    m, header = v.matrix_set(spark, d), f"{shared_dir(spark)}/{name}"
    c = v.counts(spark, d).where("row_id >= 1 AND col_id >= 1")
    return header, mtx.write_fileset(MatrixSet(c, m.rows, m.cols), header)


@query(f"WITH {Y}, {_TOP} SELECT row_id, k AS col_id, value FROM y JOIN t USING (col_id) WHERE row_id BETWEEN 1 AND (SELECT max(row_id) FROM matrix_rows)")
def s14_read_mtx_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Five columns of a file set, in the requested order."""
    header, files = _fileset(spark, d, "s14")
    ids = [r["col_id"] for r in _fullest(v.counts(spark, d)).orderBy("new_col").collect()]
    out, _ = materialize(mtx.read_matrix(spark, header, ids), "read")
    release(spark, *files.values())
    return out


@query(f"WITH {Y}, {_TOP} SELECT row_id, {_DENSE} FROM y JOIN t USING (col_id) WHERE row_id BETWEEN 1 AND (SELECT max(row_id) FROM matrix_rows) GROUP BY row_id")
def s15_read_mtx_dense(spark: SparkSession, d: str) -> DataFrame:
    header, files = _fileset(spark, d, "s15")
    ids = [r["col_id"] for r in _fullest(v.counts(spark, d)).orderBy("new_col").collect()]
    out, _ = materialize(mtx.read_dense(spark, header, ids), "read")
    release(spark, *files.values())
    return out


@query("SELECT * FROM (VALUES ('mtx', 'set.mtx.gz'), ('row', 'set.rows.gz'), ('col', 'set.cols.gz'), ('idx', 'set.mtx.gz.index')) t(part, path)")
def s18_fileset(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(mtx.fileset("set").items()), "part string, path string")


_LARGEST = "h AS (SELECT hdr FROM raw_mtx GROUP BY hdr ORDER BY count(*) DESC, hdr LIMIT 1)"


@query(
    rf"""WITH {_LARGEST}, l AS (SELECT line_no, line_id, regexp_split_to_array(trim(regexp_replace(raw_line, '\s+', ' ', 'g')), ' ') AS f FROM raw_mtx JOIN h USING (hdr) WHERE raw_line IS NOT NULL AND NOT starts_with(raw_line, '%')),
n AS (SELECT *, row_number() OVER (ORDER BY line_no, line_id) AS k FROM l WHERE len(f) >= 3), dim AS (SELECT CAST(f[1] AS BIGINT) AS r, CAST(f[2] AS BIGINT) AS c FROM n WHERE k = 1),
t AS (SELECT CASE WHEN regexp_full_match(f[1], '[0-9]+') THEN try_cast(f[1] AS BIGINT) END AS row_id, CASE WHEN regexp_full_match(f[2], '[0-9]+') THEN try_cast(f[2] AS BIGINT) END AS col_id, CASE WHEN regexp_full_match(f[3], '[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN try_cast(f[3] AS DOUBLE) END AS value FROM n WHERE k > 1)
SELECT row_id, col_id, value FROM t, dim WHERE row_id BETWEEN 1 AND r AND col_id BETWEEN 1 AND c AND isfinite(value)"""
)
def s21_scan_malformed(spark: SparkSession, d: str) -> DataFrame:
    """The largest of the raw files, with its comments, broken and incomplete lines: what a scan of the file keeps, with plain non-negative numbers."""
    raw = v.table(spark, d, "raw_mtx")
    hdr = raw.groupBy("hdr").count().orderBy(F.desc("count"), "hdr").first()["hdr"]
    path = f"{shared_dir(spark)}/s21.mtx.gz"
    lines = raw.where(F.col("hdr") == hdr).withColumn("name", F.coalesce("raw_line", F.lit("")))
    mtx.write_names(lines, path, ["line_no", "line_id"])
    out, _ = materialize(mtx.scan_triplets(spark, path), "scanned")
    release(spark, path)
    return out.where((F.col("value") >= 0) & (F.col("value") < float("inf")))


@query("SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 2e0), (3::BIGINT, 1::BIGINT, 1e0), (2::BIGINT, 2::BIGINT, 4e0)) t(row_id, col_id, value)")
def s24_in_memory(spark: SparkSession, d: str) -> DataFrame:
    """A small matrix from arrays: triplets of the same cell add up."""
    return mtx.from_arrays(spark, [1, 3, 2, 1], [1, 1, 2, 1], [1.5, 1.0, 4.0, 0.5], ["a", "b", "c"]).coo


@query("SELECT row_id AS pos, coalesce(name, 'NA') AS line FROM matrix_rows")
def s16_read_vector(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/s16.rows.gz"
    mtx.write_names(v.table(spark, d, "matrix_rows").select("row_id", "name"), path, "row_id")
    out, _ = materialize(mtx.read_vector(spark, path), "lines")
    release(spark, path)
    return out


@query(f"WITH {M}, s AS (SELECT * FROM m WHERE value > 0 AND row_id >= 1 AND col_id >= 1), {_SQUEEZE.format(n=1)} SELECT row_id, new_col AS col_id, value FROM m JOIN q USING (col_id) WHERE row_id >= 1")
def s17_write_sparse(spark: SparkSession, d: str) -> DataFrame:
    """A file set without empty columns, read back."""
    m, header = v.matrix_set(spark, d), f"{shared_dir(spark)}/s17"
    all_ = v.coo(spark, d).where("row_id >= 1 AND col_id >= 1")
    rows = m.rows.unionByName(all_.select("row_id").distinct().join(m.rows, "row_id", "left_anti").withColumn("name", F.col("row_id").cast("string")))
    files = mtx.write_fileset(MatrixSet(all_, rows, m.cols), header, drop_empty=True)
    out, _ = materialize(mtx.read_matrix(spark, header), "read")
    release(spark, *files.values())
    return out


@query(f"WITH {Y}, {CELLS}, a AS (SELECT name, min(col_id) AS col_id FROM cells WHERE name IS NOT NULL GROUP BY name), b AS (SELECT name, min(col_id) AS other FROM cells WHERE name IS NOT NULL AND batch <> 'none' GROUP BY name), n AS (SELECT col_id, other, row_number() OVER (ORDER BY col_id) AS new_col FROM a JOIN b USING (name)) SELECT row_id, new_col AS col_id, value FROM y JOIN n USING (col_id) UNION ALL SELECT row_id + (SELECT max(row_id) FROM matrix_rows), new_col, value FROM y JOIN n ON y.col_id = n.other")
def s19_rbind(spark: SparkSession, d: str) -> DataFrame:
    """The matrix above itself: the lower one has the cells with a known batch and other row names."""
    m = v.matrix_set(spark, d)
    low = MatrixSet(m.coo, m.rows.withColumn("name", F.concat(F.lit("low_"), "name")), m.cols.where("batch <> 'none'"))
    return select.rbind(m, low).coo


@query(f"WITH {Y} SELECT row_id, col_id - (SELECT max(col_id) // 4 - 1 FROM matrix_cols) AS col_id, value FROM y WHERE col_id BETWEEN (SELECT max(col_id) // 4 FROM matrix_cols) AND (SELECT max(col_id) // 2 FROM matrix_cols)")
def s22_column_range(spark: SparkSession, d: str) -> DataFrame:
    """The second quarter of the columns: a range read."""
    n = v.table(spark, d, "matrix_cols").agg(F.max("col_id")).first()[0]
    return select.column_range(v.counts(spark, d), n // 4, n // 2)


@query("SELECT row_id, name FROM matrix_rows WHERE name IS NOT NULL")
def s23_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/s23.txt.gz"
    mtx.write_table(v.table(spark, d, "matrix_rows").where("name IS NOT NULL").select("row_id", "name"), path)
    out, _ = materialize(mtx.read_table(spark, path, "row_id long, name string"), "table")
    release(spark, path)
    return out


# ---- projections and scalar maps ----


@query(f"WITH {Y}, {CELLS}, r AS (SELECT name, row_number() OVER (ORDER BY name) AS pos FROM (SELECT DISTINCT name FROM matrix_rows WHERE name IS NOT NULL)) SELECT pos AS row_id, col_id, sum(value) AS value FROM y JOIN matrix_rows USING (row_id) JOIN r USING (name) GROUP BY pos, col_id")
def proj1_relocate(spark: SparkSession, d: str) -> DataFrame:
    """Rows relocated by name onto the sorted distinct names."""
    m = v.matrix_set(spark, d)
    return select.relocate(m, select.common_names([m.rows]))


@query(f"WITH {_LISTED}, n AS (SELECT DISTINCT name FROM matrix_rows WHERE name IN (SELECT name FROM w)) SELECT name, row_number() OVER (ORDER BY name) AS pos FROM n")
def proj2_common_names(spark: SparkSession, d: str) -> DataFrame:
    return select.common_names([v.table(spark, d, "matrix_rows"), s2_rownames(spark, d)])


@query(f"WITH {_LISTED}, n AS (SELECT name FROM matrix_rows WHERE name IS NOT NULL UNION SELECT name FROM w) SELECT name, row_number() OVER (ORDER BY name) AS pos FROM n")
def proj2_all_names(spark: SparkSession, d: str) -> DataFrame:
    return select.common_names([v.table(spark, d, "matrix_rows"), s2_rownames(spark, d)], union=True)


#: SQL, and the column that is built once there is a session.
_MAPS = {
    "log1p": ("ln(1e0 + greatest(value, 0))", lambda: F.log1p(sp.at_least(F.col("value"), 0.0))),
    "safe_log": ("ln(greatest(value, 1e-8))", lambda: sp.safe_log(F.col("value"))),
    "safe_sqrt": ("sqrt(greatest(value, 0))", lambda: sp.safe_sqrt(F.col("value"))),
    "safe_div": ("(value + 1e0) / (2e0 + 1e0)", lambda: sp.safe_div(F.col("value"), F.lit(2.0), 1.0, 1.0)),
    "clamped": ("least(greatest(value, -2e0), 2e0)", lambda: sp.clamp(F.col("value"), -2.0, 2.0)),
    "at_least_one": ("greatest(value, 1e0)", lambda: sp.at_least(F.col("value"), 1.0)),
    "positive": ("CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END", lambda: sp.is_positive(F.col("value"))),
    "pseudo": ("value + 0.5e0", lambda: sp.add_pseudo(F.col("value"), 0.5)),
    "softplus": ("greatest(value, 0) + ln(1e0 + exp(-abs(value)))", lambda: sp.softplus(F.col("value"))),
    "sigmoid": ("CASE WHEN value >= 0 THEN 1e0 / (1e0 + exp(-abs(value))) ELSE exp(-abs(value)) / (1e0 + exp(-abs(value))) END", lambda: sp.sigmoid(F.col("value"))),
    "lse": ("greatest(value, 1e0) + ln(1e0 + exp(-abs(value - 1e0)))", lambda: sp.log_sum_exp(F.col("value"), F.lit(1.0))),
    "psi": (sp.digamma_sql("abs(value) + 0.5e0"), lambda: sp.digamma(F.abs("value") + 0.5)),
}


@query(f"WITH {M} SELECT row_id, col_id, " + ", ".join(f"round({s}, 4) + 0e0 AS {n}" for n, (s, _) in _MAPS.items()) + " FROM m")
def proj3_scalar_maps(spark: SparkSession, d: str) -> DataFrame:
    return v.coo(spark, d).select("row_id", "col_id", *[rounded(c()).alias(n) for n, (_, c) in _MAPS.items()])


@query(f"WITH {M} SELECT row_id, col_id, round(lgamma(abs(value) + 0.5e0), 4) + 0e0 AS lgamma FROM m")
def proj9_lgamma(spark: SparkSession, d: str) -> DataFrame:
    return v.coo(spark, d).select("row_id", "col_id", rounded(sp.lgamma(F.abs("value") + 0.5)).alias("lgamma"))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN value IS NOT NULL AND isfinite(value) THEN 1 ELSE 0 END) AS BIGINT) AS n_obs, round(sum(CASE WHEN value IS NOT NULL AND isfinite(value) THEN value ELSE 0 END), 3) AS total FROM coo")
def proj7_observed(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("value")
    return v.table(spark, d, "coo").agg(F.count("*").alias("n"), F.sum(sp.is_obs(c)).cast("long").alias("n_obs"), F.round(F.sum(sp.inf_zero(c)), 3).alias("total"))


@query(f"WITH {Y}, n AS (SELECT max(row_id) AS r, max(col_id) AS c FROM y) SELECT row_id, col_id, value FROM y UNION ALL SELECT row_id, col_id + c, value FROM y, n UNION ALL SELECT row_id + r, col_id, value FROM y, n")
def proj11_concatenate(spark: SparkSession, d: str) -> DataFrame:
    """The matrix beside and above itself."""
    y = v.counts(spark, d)
    n = y.agg(F.max("row_id").alias("r"), F.max("col_id").alias("c")).first()
    return select.hcat(y, y, n["c"]).unionByName(y.withColumn("row_id", F.col("row_id") + n["r"]))


@query(f"WITH {_LISTED} SELECT row_id, CASE WHEN name IN (SELECT name FROM w) THEN 1e0 ELSE 0e0 END AS neg, CASE WHEN name IN (SELECT name FROM w) THEN 0e0 ELSE 1e0 END AS pos FROM (SELECT row_id, coalesce(name, chr(0)) AS name FROM matrix_rows)")
def proj12_control_mask(spark: SparkSession, d: str) -> DataFrame:
    return select.control_mask(v.table(spark, d, "matrix_rows"), s2_rownames(spark, d))


@query(f"WITH {X} SELECT row_id FROM x GROUP BY row_id HAVING sum(exp(v - 2)) / {K} > 1e-2")
def proj13_delta_rows(spark: SparkSession, d: str) -> DataFrame:
    return select.delta_rows(v.dictionary(spark, d).withColumn("v", F.transform("v", lambda x: x - 2))).select("row_id")


# ---- statistics ----

_MOM = "round(sum(value), 4) + 0e0 AS s1, round(sum(value * value), 4) AS s2, count(CASE WHEN abs(value) > 1e-8 THEN 1 END) AS nnz"


def _mom(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, rounded(F.col("s1")).alias("s1"), F.round("s2", 4).alias("s2"), "nnz")


@query(f"WITH {M} SELECT row_id, {_MOM} FROM m GROUP BY row_id")
def a1_row_stat(spark: SparkSession, d: str) -> DataFrame:
    return _mom(stats.row_stat(v.coo(spark, d)), "row_id")


@query(f"WITH {M} SELECT col_id, {_MOM} FROM m GROUP BY col_id")
def a2_col_stat(spark: SparkSession, d: str) -> DataFrame:
    return _mom(stats.col_stat(v.coo(spark, d)), "col_id")


@query(f"WITH {M} SELECT row_id, col_id, {_MOM} FROM m GROUP BY GROUPING SETS ((row_id), (col_id))")
def a3_row_col_stat(spark: SparkSession, d: str) -> DataFrame:
    return _mom(stats.row_col_stat(v.coo(spark, d)), "row_id", "col_id")


@query(f"WITH {M} SELECT CAST(round(value) AS BIGINT) AS bin, count(*) AS n FROM m GROUP BY 1")
def a4_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(v.coo(spark, d))


@query(f"WITH {Y}, n AS (SELECT CAST(count(DISTINCT col_id) AS DOUBLE) AS n FROM matrix_cols), r AS (SELECT row_id, sum(value) / n AS mu, sum(value * value) / n AS q FROM y, n GROUP BY row_id, n) SELECT row_id, round(mu, 6) AS mu, round(sqrt(greatest(q - mu * mu, 0)) + 1e-8, 6) AS sigma FROM r")
def a5_row_mean_sd(spark: SparkSession, d: str) -> DataFrame:
    n = v.cells(spark, d).count()
    return stats.row_mean_sd(v.counts(spark, d), n).select("row_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query(f"WITH {M} SELECT row_id, col_id, round(value / greatest(sqrt(sum(value * value) OVER (PARTITION BY col_id)), 1e-8), 6) + 0e0 AS value FROM m")
def a6_l2_columns(spark: SparkSession, d: str) -> DataFrame:
    return normalize.l2_columns(v.coo(spark, d)).withColumn("value", rounded(F.col("value"), 6))


@query(f"WITH {Y} SELECT row_id, col_id, round(value / greatest(sum(value) OVER (PARTITION BY col_id), 1e0), 6) AS value FROM y")
def a7_l1_columns(spark: SparkSession, d: str) -> DataFrame:
    return normalize.l1_columns(v.counts(spark, d)).withColumn("value", F.round("value", 6))


@query(f"WITH {v.long_loadings()}, {v.standard_sql('l', 'z')} {wide_sql('z', 'id', 10, 'z')}")
def a8_standardize(spark: SparkSession, d: str) -> DataFrame:
    return wide(normalize.standardize(v.loadings(spark, d), 10), ["id"], "v", 10)


@query(f"WITH {v.long_loadings()}, mu AS (SELECT k, sum(v) / (count(*) + 1e-8) AS mu FROM l GROUP BY k) {wide_sql('(SELECT id, k, v - mu AS v FROM l JOIN mu USING (k))', 'id', 10)}")
def a9_centre(spark: SparkSession, d: str) -> DataFrame:
    return wide(normalize.standardize(v.loadings(spark, d), 10, scale=False), ["id"], "v", 10)


@query(f"WITH {v.long_loadings()}, {v.clip_sql('l', 'z')} {wide_sql('z', 'id', 10)}")
def a10_quantile_clip(spark: SparkSession, d: str) -> DataFrame:
    return wide(normalize.quantile_clip(materialize(v.loadings(spark, d), "loadings")[0]), ["id"], "v", 10)


@query(f"WITH {v.long_loadings()}, {v.clip_sql('l', 'y')}, {v.standard_sql('y', 'z')} {wide_sql('z', 'id', 10, 'z')}")
def a11_stretch(spark: SparkSession, d: str) -> DataFrame:
    return wide(normalize.stretch(materialize(v.loadings(spark, d), "loadings")[0], 10), ["id"], "v", 10)


@query(f"WITH {v.long_loadings('theta', True)}, g AS (SELECT id, k, ln(greatest(v, 1e0 / (SELECT count(DISTINCT id) FROM l))) AS v FROM l), {v.clip_sql('g', 'y')}, {v.standard_sql('y', 'z')} {wide_sql('z', 'id', 10, 'exp(least(greatest(z, -8), 8))')}")
def a12_stretch_nonnegative(spark: SparkSession, d: str) -> DataFrame:
    return wide(normalize.stretch_nonnegative(materialize(v.loadings(spark, d, "theta", True), "loadings")[0], 10), ["id"], "v", 10)


@query("SELECT row_id, round(sum(CASE WHEN value IS NOT NULL AND isfinite(value) THEN value ELSE 0 END), 4) + 0e0 AS total, CAST(sum(CASE WHEN value IS NOT NULL AND isfinite(value) THEN 1 ELSE 0 END) AS BIGINT) AS n_obs FROM coo GROUP BY row_id")
def a13_safe_sums(spark: SparkSession, d: str) -> DataFrame:
    return stats.safe_sums(v.table(spark, d, "coo"), ["row_id"]).withColumn("total", rounded(F.col("total")))


@query(f"WITH {Y}, {X} SELECT col_id, k, round(sum(value * v), 4) + 0e0 AS total, count(*) + 1e0 AS n_obs FROM y JOIN x USING (row_id) GROUP BY col_id, k")
def a14_observed_products(spark: SparkSession, d: str) -> DataFrame:
    """Y'X by cell and topic, with the number of finite pairs."""
    y = v.counts(spark, d).select(F.col("col_id").alias("row_id"), F.col("row_id").alias("inner_id"), "value")
    x = v.dictionary(spark, d).select(F.col("row_id").alias("inner_id"), F.posexplode("v").alias("p", "value")).select("inner_id", (F.col("p") + 1).cast("long").alias("col_id"), "value")
    return stats.observed_products(y, x).select(F.col("row_id").alias("col_id"), F.col("col_id").alias("k"), rounded(F.col("total")).alias("total"), "n_obs")


@query(f"WITH {M}, n AS (SELECT CAST(count(DISTINCT col_id) AS DOUBLE) AS n FROM matrix_cols) SELECT row_id, round(sum(abs(value)), 4) AS degree, round(sqrt(greatest(sum(value * value) - sum(value) * sum(value) / max(n), 0) / (max(n) - 1)), 6) AS sd FROM m, n GROUP BY row_id")
def a15_row_scores(spark: SparkSession, d: str) -> DataFrame:
    m, n = v.coo(spark, d), v.cells(spark, d).count()
    return stats.row_degree(m).join(stats.row_sd(m, n), "row_id").select("row_id", F.round("degree", 4).alias("degree"), F.round("sd", 6).alias("sd"))


@query("SELECT id, count(*) AS n, round(avg(colsum), 4) AS mean, round(var_samp(colsum), 4) AS var, round(stddev_samp(colsum), 4) AS sd FROM loading WHERE colsum IS NOT NULL GROUP BY id")
def a16_running_stat(spark: SparkSession, d: str) -> DataFrame:
    """colsum over the fits of a cell."""
    s = v.table(spark, d, "loading").where("colsum IS NOT NULL")
    r = stats.running_stat(s, ["id"], "colsum").select("id", *[F.round(c, 4).alias(c) for c in ("mean", "var", "sd")])
    return r.join(s.groupBy("id").agg(F.count("*").alias("n")), "id").select("id", "n", "mean", "var", "sd")


@query(f"WITH {v.long_loadings()}, {v.softmax_sql('l', 'z')} {wide_sql('z', 'id', 10, 'lp')}")
def a17_log_softmax(spark: SparkSession, d: str) -> DataFrame:
    return wide(v.loadings(spark, d).withColumn("v", v_log_softmax(F.col("v"))), ["id"], "v", 10)


@query(f"WITH {v.long_loadings()}, {v.softmax_sql('l', 'z')} {wide_sql('z', 'id', 10, 'exp(lp)')}")
def a17_softmax(spark: SparkSession, d: str) -> DataFrame:
    return wide(v.loadings(spark, d).withColumn("v", v_softmax(F.col("v"))), ["id"], "v", 10)


@query(f"WITH {v.long_loadings()}, g AS (SELECT id, k, v AS u, v + ln(k) AS v FROM l), {v.softmax_sql('g', 'z')} {wide_sql('z', 'id', 10, 'u - v + lp')}")
def a17_weighted_log_softmax(spark: SparkSession, d: str) -> DataFrame:
    """Weights 1..10."""
    w = F.array(*[F.lit(float(i)) for i in range(1, 11)])
    return wide(v.loadings(spark, d).withColumn("v", v_log_softmax_weighted(F.col("v"), w)), ["id"], "v", 10)


@query("SELECT batch, row_number() OVER (ORDER BY min(col_id), batch) AS pos FROM matrix_cols WHERE batch IS NOT NULL GROUP BY batch")
def a21_first_appearance(spark: SparkSession, d: str) -> DataFrame:
    return select.first_appearance(v.table(spark, d, "matrix_cols"), "batch", "col_id")


# ---- linear algebra ----


def signs_sql(k: int, row: str = "row_id") -> str:
    return f"CASE WHEN (({row} * 2654435761 + {40503 * (k + 1)}) % 65537) % 2 = 0 THEN 1e0 ELSE -1e0 END"


PROJECTED = ", ".join(f"round(sum(value * {signs_sql(i)}), 4) + 0e0 AS v{i + 1}" for i in range(K))


@query(f"WITH {Y} SELECT col_id AS id, {PROJECTED} FROM y GROUP BY col_id")
def l2_project(spark: SparkSession, d: str) -> DataFrame:
    return wide(linalg.project(v.counts(spark, d), K, mode="rademacher"), ["id"], "v", K)


@query(f"WITH {Y}, n AS (SELECT CAST(count(DISTINCT col_id) AS DOUBLE) AS n FROM matrix_cols), r AS (SELECT row_id, sqrt(greatest(sum(value * value) / max(n) - (sum(value) / max(n)) * (sum(value) / max(n)), 0)) + 1e-8 AS sigma FROM y, n GROUP BY row_id), s AS (SELECT row_id, col_id, value * sigma AS value FROM y JOIN r USING (row_id)) SELECT col_id AS id, {PROJECTED} FROM s GROUP BY col_id")
def l3_weighted_project(spark: SparkSession, d: str) -> DataFrame:
    y, n = v.counts(spark, d), v.cells(spark, d).count()
    w = stats.row_mean_sd(y, n).select("row_id", F.col("sigma").alias("factor"))
    return wide(linalg.project(y, K, mode="rademacher", weights=w), ["id"], "v", K)


@query()
def l1_gaussian_rows(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian projection of all features: mean, deviation and correlation of the first two directions."""
    p = linalg.projection(v.table(spark, d, "matrix_rows"), K)
    return p.agg(F.count("*").alias("n"), F.avg(F.get("v", F.lit(0))).alias("mean"), F.stddev(F.get("v", F.lit(0))).alias("sd"), F.corr(F.get("v", F.lit(0)), F.get("v", F.lit(1))).alias("corr"))


@query(" UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, {1.0 if i == j else 0.0}e0 AS g" for i in range(1, 11) for j in range(1, 11)))
def l4_singular_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Left singular vectors of the loadings are orthonormal: their Gram matrix is the identity."""
    left, s, _ = linalg.singular(materialize(v.loadings(spark, d), "loadings")[0], 10)
    g = linalg.gram(left, len(s))
    return spark.createDataFrame([(i + 1, j + 1, abs(round(float(g[i, j]), 6))) for i in range(len(s)) for j in range(len(s))], "i long, j long, g double")


@query(f"WITH {v.long_loadings()}, x AS (SELECT id, 1 AS k, v FROM l WHERE k = 1), {v.standard_sql('x', 'z')}, s AS (SELECT l.k, sum(z.z * l.v) / ((SELECT sum(z * z) FROM z) + 1e-8) AS slope FROM l JOIN z USING (id) GROUP BY l.k) {wide_sql('(SELECT l.id, l.k, l.v - slope * z.z AS v FROM l JOIN z USING (id) JOIN s ON s.k = l.k WHERE l.k > 1)', 'id', 10).replace('max(CASE WHEN k = 1 THEN v END)', '0')}")
def l5_residual(spark: SparkSession, d: str) -> DataFrame:
    """The loadings on topics 2..10 without what topic 1 explains."""
    a = materialize(v.loadings(spark, d), "loadings")[0]
    y = a.select("id", F.slice("v", 2, 9).alias("v"))
    r = linalg.residual(y, a.select("id", F.slice("v", 1, 1).alias("v")), 9, 1)
    return wide(r.select("id", F.concat(F.array(F.lit(0.0)), "v").alias("v")), ["id"], "v", 10)


@query(f"WITH {Y}, {X} SELECT k, round(sum(value * v), 3) + 0e0 AS total FROM y JOIN x USING (row_id) GROUP BY k")
def l6_products(spark: SparkSession, d: str) -> DataFrame:
    from trigrid.operators.recal import pmf_stat

    s = pmf_stat(v.counts(spark, d), v.dictionary(spark, d), K, False, softmax=False)
    each = s.select(F.posexplode(F.transform("v", lambda x: x * F.greatest("ysum", F.lit(1.0)))).alias("p", "x"))
    return each.groupBy((F.col("p") + 1).cast("long").alias("k")).agg(rounded(F.sum("x"), 3).alias("total"))


# ---- topics, networks, graphs ----

_TOPIC = f"{v.long_loadings('theta', True)}, {X10}, bb AS (SELECT row_id, k, exp(v) AS v FROM x), u AS (SELECT k, greatest(sum(v), 1e-8) AS u FROM bb GROUP BY k), p AS (SELECT id, k, v * u AS v FROM l JOIN u USING (k)), dd AS (SELECT id, greatest(sum(v), 1e-8) AS depth FROM p GROUP BY id)"


def _topic(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    beta = v.dictionary(spark, d, 10).withColumn("v", F.transform("v", lambda x: F.exp(x)))
    return topics.pmf_to_topic(beta, v.loadings(spark, d, "theta", True), 10)


@query(f"WITH {_TOPIC}, q AS (SELECT id, k, v / depth AS v, depth FROM p JOIN dd USING (id)) {wide_sql('q', 'id, round(depth, 4)', 10).replace('SELECT id, round(depth, 4)', 'SELECT id, round(depth, 4) AS depth')}")
def t1_topics(spark: SparkSession, d: str) -> DataFrame:
    """Proportions of the topics of theta under the fixed dictionary."""
    return wide(_topic(spark, d)[1].withColumn("depth", F.round("depth", 4)), ["id", "depth"], "v", 10)


@query(f"WITH {X10}, bb AS (SELECT row_id, k, exp(v) AS v FROM x), u AS (SELECT k, greatest(sum(v), 1e-8) AS u FROM bb GROUP BY k) {wide_sql('(SELECT row_id, k, v / u AS v FROM bb JOIN u USING (k))', 'row_id', 10, digits=8)}")
def t1_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return wide(_topic(spark, d)[0], ["row_id"], "v", 10, digits=8)


@query(f"WITH {_TOPIC}, q AS (SELECT id, k, v / depth AS v FROM p JOIN dd USING (id)) SELECT id, round(sum(v * sin(k / 10e0 * 2 * pi())), 4) + 0e0 AS xx, round(sum(v * cos(k / 10e0 * 2 * pi())), 4) + 0e0 AS yy FROM q GROUP BY id")
def t2_project(spark: SparkSession, d: str) -> DataFrame:
    return topics.project_proportions(_topic(spark, d)[1], 10).select("id", rounded(F.col("xx")).alias("xx"), rounded(F.col("yy")).alias("yy"))


@query("WITH RECURSIVE t(node, leaf) AS (SELECT CAST(8 + k AS BIGINT), CAST(k + 1 AS BIGINT) FROM range(0, 8) r(k) UNION ALL SELECT node // 2, leaf FROM t WHERE node > 1) SELECT node, leaf FROM t")
def f6_tree(spark: SparkSession, d: str) -> DataFrame:
    return topics.tree_matrix(spark, 3)


_KNN = f"{v.long_loadings()}, w AS (SELECT id, list(v ORDER BY k) AS v FROM l GROUP BY id), nn AS (SELECT a.id, b.id AS match, sqrt(list_sum(list_transform(range(1, 11), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS distance FROM w a, w b), kn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, match) AS r FROM nn QUALIFY r <= 4)"


@query(f"WITH {_KNN} SELECT id, match, round(distance, 4) AS distance FROM kn WHERE id <> match")
def g1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Exact: itself and three neighbours of every cell by log theta; itself is left out."""
    a = materialize(v.loadings(spark, d), "loadings")[0]
    return graph.k_nearest(a, a, 10, 4, drop_self=True, probe_share=1.0).select("id", "match", F.round("distance", 4).alias("distance"))


def weights_sql(source: str, out: str) -> str:
    """CTE out(id, match, distance, weight): weights of (id, match, distance), the line search as a recursion that ends where the gap grows."""
    total = lambda lam: f"list_sum(list_transform(d, lambda x: exp(-x * {lam})))"
    gap = lambda lam: f"log2(len(d)) - {total(lam)}"
    return f"""{out}_d AS (SELECT id, list(distance - least_) AS d FROM (SELECT *, min(distance) OVER (PARTITION BY id) AS least_ FROM {source}) GROUP BY id),
{out}_r AS (SELECT id, d, 10e0 AS lam, {gap('10e0')} AS f, 0 AS t FROM {out}_d UNION ALL
SELECT id, d, step, g, t + 1 FROM (SELECT *, {gap('step')} AS g FROM (SELECT *, CASE WHEN f < 0 THEN lam * 1.1e0 ELSE lam * 0.9e0 END AS step FROM {out}_r)) WHERE len(d) > 1 AND t < 100 AND NOT abs(g) > abs(f)),
{out}_l AS (SELECT id, arg_max(lam, t) AS lam, max(len(d)) AS n FROM {out}_r GROUP BY id),
{out} AS (SELECT s.id, s.match, s.distance, exp(-(s.distance - min(s.distance) OVER (PARTITION BY s.id)) * lam) AS weight FROM {source} s JOIN {out}_l USING (id))"""


@query(f"WITH RECURSIVE {_KNN}, ks AS (SELECT id, match, distance FROM kn WHERE id <> match), {weights_sql('ks', 'kw')} SELECT id, match, round(distance, 4) AS distance, round(weight, 4) AS weight FROM kw")
def g2_weights(spark: SparkSession, d: str) -> DataFrame:
    a = materialize(v.loadings(spark, d), "loadings")[0]
    return graph.match_weights(graph.k_nearest(a, a, 10, 4, drop_self=True)).select("id", "match", F.round("distance", 4).alias("distance"), F.round("weight", 4).alias("weight"))


_SIDES = f"{v.long_loadings()}, w AS (SELECT id, list(v ORDER BY k) AS v FROM l GROUP BY id), nn AS (SELECT a.id, b.id AS match, sqrt(list_sum(list_transform(range(1, 11), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS distance FROM w a, w b WHERE a.id % 2 <> b.id % 2), kn AS (SELECT id, match, distance FROM nn QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, match) <= 3)"


@query(f"WITH RECURSIVE {_SIDES}, {weights_sql('kn', 'kw')} SELECT CASE WHEN id % 2 = 1 THEN id ELSE match END AS src, CASE WHEN id % 2 = 1 THEN match ELSE id END AS dst, round(sum(weight), 4) AS weight FROM kw GROUP BY 1, 2")
def g3_two_way(spark: SparkSession, d: str) -> DataFrame:
    """Cells with odd ids matched with those of even ids, from both sides."""
    a = materialize(v.loadings(spark, d), "loadings")[0]
    return graph.two_way_match(a.where("id % 2 = 1"), a.where("id % 2 = 0"), 10, 3).withColumn("weight", F.round("weight", 4))


@query(f"WITH {EDGES}, b2 AS (SELECT least(src, dst) AS s, greatest(src, dst) AS t, count(*) AS n, sum(weight) AS w FROM e GROUP BY 1, 2) SELECT s AS src, t AS dst, round(w, 6) AS weight FROM b2 WHERE n > 1")
def g4_reciprocal(spark: SparkSession, d: str) -> DataFrame:
    return graph.keep_reciprocal(v.edges(spark, d), undirected=True).withColumn("weight", F.round("weight", 6))


@query(f"WITH {EDGES}, b2 AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) SELECT src, dst, round(sum(weight) / 2, 6) AS weight FROM b2 GROUP BY src, dst")
def g3_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetric(v.edges(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {EDGES}, {BUCKETS}, n AS (SELECT max(positions) AS n FROM b) SELECT x.positions AS s, y2.positions AS t, round(sum(weight), 6) AS weight FROM e JOIN b x ON x.id = e.src JOIN b y2 ON y2.id = e.dst, n WHERE x.positions BETWEEN 1 AND n AND y2.positions BETWEEN 1 AND n GROUP BY 1, 2 HAVING abs(sum(weight)) > 1e-4")
def g9_collapse(spark: SparkSession, d: str) -> DataFrame:
    b = v.buckets(spark, d)
    n = b.agg(F.max("positions")).first()[0]
    return graph.collapse_network(v.edges(spark, d), b, n).withColumn("weight", F.round("weight", 6))


@query(f"WITH {EDGES}, {v.long_loadings('theta', True)}, z AS (SELECT src, dst, weight, a.k, a.v * b.v AS z FROM e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst AND b.k = a.k WHERE weight > 1e-8) SELECT src, dst, round(weight, 6) AS weight, arg_max(k, struct_pack(z := z, o := -k)) AS topic FROM z GROUP BY src, dst, weight")
def g10_decompose(spark: SparkSession, d: str) -> DataFrame:
    b = v.loadings(spark, d, "theta", True).withColumnRenamed("id", "row_id")
    return graph.decompose_network(v.edges(spark, d), b).withColumn("weight", F.round("weight", 6)).withColumn("topic", F.col("topic").cast("long"))


@query(f"WITH {v.long_loadings()} SELECT id, arg_max(k, struct_pack(v := v, o := -k)) AS topic FROM l GROUP BY id")
def c5_argmax(spark: SparkSession, d: str) -> DataFrame:
    return v.loadings(spark, d).select("id", v_argmax(F.col("v")).cast("long").alias("topic"))
