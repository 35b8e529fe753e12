"""Queries p1_ and p5_ over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrid.operators.dense import dense_totals
from trigrid.runtime import current_rows
from trigrid.sources.badrows import split_triplets


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_triplets(spark.read.parquet(f"{d}/raw_mtx.parquet"))[1].select("line_id", "reason")


def p1_valid(spark: SparkSession, d: str) -> DataFrame:
    return split_triplets(spark.read.parquet(f"{d}/raw_mtx.parquet"))[0].select("hdr", "row", "column", "value")


def _current_buckets(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(spark.read.parquet(f"{d}/bulk_cells.parquet").select("col_id", "computed_at", "positions"), ["col_id"], "computed_at", ["positions"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Buckets with more than 3 percent of the current cells that have a bucket."""
    totals = dense_totals(_current_buckets(spark, d), "positions", [])
    whole = totals.agg(F.sum("n").alias("whole"))
    return totals.join(F.broadcast(whole)).where("100 * n > 3 * whole").select("positions")


def p5_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Per bucket: current cells, recorded size, number and sum of usable coo values of its cells."""
    coo = spark.read.parquet(f"{d}/coo.parquet").where("col_id IS NOT NULL").distinct()
    v = F.col("value")
    usable = coo.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    per_cell = usable.groupBy("col_id").agg(F.count("*").cast("double").alias("n_values"), F.sum("value").alias("value_sum"))
    cells = dense_totals(_current_buckets(spark, d).join(per_cell, "col_id", "left"), "positions", ["n_values", "value_sum"], "n_cells")
    sizes = current_rows(spark.read.parquet(f"{d}/bulk_sizes.parquet"), ["block_id", "positions"], "computed_at", ["size"])
    recorded = dense_totals(sizes, "positions", ["size"], "n_blocks")
    return cells.join(recorded, "positions", "full").select("positions", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("size", F.lit(0)).cast("long").alias("recorded_size"), F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"), F.round(F.coalesce("value_sum", F.lit(0.0)), 4).alias("value_sum"))


QUERIES = {"p1_found": p1_found, "p1_valid": p1_valid, "p5_found": p5_found, "p5_buckets": p5_buckets}

_LINES = r"""
WITH t AS (SELECT line_id, hdr, line_no, raw_line, regexp_replace(raw_line, '\r\z', '') AS x FROM raw_mtx),
l AS (SELECT * FROM t WHERE raw_line IS NULL OR NOT (x LIKE '\%%' ESCAPE '\' OR regexp_full_match(x, '[ \t]*'))),
n AS (SELECT *, row_number() OVER (PARTITION BY hdr ORDER BY (x IS NULL), line_no, line_id) AS k FROM l),
dims AS (SELECT hdr, regexp_extract_all(x, '[0-9]+') AS f FROM n WHERE k = 1),
j AS (SELECT n.line_id, n.hdr, n.x, try_cast(dims.f[1] AS BIGINT) AS nr, try_cast(dims.f[2] AS BIGINT) AS nc,
  list_transform(regexp_extract_all(n.x, '"[^"]*"|[^ \t"]+'), lambda f: replace(f, '"', '')) AS f
  FROM n JOIN dims ON n.hdr IS NOT DISTINCT FROM dims.hdr WHERE k > 1),
r AS (SELECT *, CASE
  WHEN x IS NOT NULL AND NOT regexp_full_match(x, '[ \t]*(("[^"]*"|[^ \t"]+)([ \t]+("[^"]*"|[^ \t"]+))*)?[ \t]*') THEN 'broken_quote'
  WHEN x IS NULL OR len(f) <> 3 THEN 'field_count'
  WHEN NOT (regexp_full_match(f[1], '[0-9]+') AND regexp_full_match(f[2], '[0-9]+')) THEN 'bad_index'
  WHEN NOT coalesce(try_cast(f[1] AS HUGEINT) BETWEEN 1 AND nr, false) OR NOT coalesce(try_cast(f[2] AS HUGEINT) BETWEEN 1 AND nc, false) THEN 'index_range'
  WHEN NOT regexp_full_match(f[3], '[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') OR NOT coalesce(isfinite(try_cast(f[3] AS DOUBLE)), false) THEN 'bad_value' END AS reason FROM j)
"""
_CELLS = "WITH c AS (SELECT col_id, max(struct_pack(a := computed_at, b := positions)).b AS positions FROM bulk_cells WHERE col_id IS NOT NULL GROUP BY col_id)"

SQL = {
    "p1_found": _LINES + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p1_valid": _LINES + 'SELECT hdr, CAST(f[1] AS BIGINT) AS "row", CAST(f[2] AS BIGINT) AS "column", CAST(f[3] AS DOUBLE) AS value FROM r WHERE reason IS NULL',
    "p5_found": _CELLS + ", n AS (SELECT positions, count(*) AS n FROM c WHERE positions IS NOT NULL GROUP BY positions) SELECT positions FROM n WHERE 100 * n > 3 * (SELECT sum(n) FROM n)",
    "p5_buckets": _CELLS
    + """, v AS (SELECT col_id, count(*) AS n_values, sum(value) AS value_sum FROM (SELECT DISTINCT * FROM coo) WHERE col_id IS NOT NULL AND value IS NOT NULL AND isfinite(value) GROUP BY col_id),
a AS (SELECT positions, count(*) AS n_cells, coalesce(sum(n_values), 0) AS n_values, coalesce(sum(value_sum), 0) AS value_sum FROM c LEFT JOIN v USING (col_id) WHERE positions IS NOT NULL GROUP BY positions),
s AS (SELECT positions, coalesce(sum(size), 0) AS recorded_size FROM (SELECT block_id, positions, max(struct_pack(a := computed_at, b := size)).b AS size FROM bulk_sizes WHERE block_id IS NOT NULL AND positions IS NOT NULL GROUP BY ALL) GROUP BY positions)
SELECT positions, CAST(coalesce(n_cells, 0) AS BIGINT) AS n_cells, CAST(coalesce(recorded_size, 0) AS BIGINT) AS recorded_size, CAST(coalesce(n_values, 0) AS BIGINT) AS n_values, round(coalesce(value_sum, 0), 4) AS value_sum FROM a FULL JOIN s USING (positions)""",
}
