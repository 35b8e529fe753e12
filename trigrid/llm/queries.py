"""Queries p2_, p3_, p4_, p6_, p7_ and p8_ over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrid.llm.clusters import clusters, described
from trigrid.llm.leakage import leaked
from trigrid.functions.leaves import sample_of, usable
from trigrid.llm.neighbours import mutual_pairs, search
from trigrid.llm.packing import pack
from trigrid.llm.repetition import repetition
from trigrid.llm.terms import joined_words, term_frequencies, with_marks
from trigrid.runtime import current_rows


def _term_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/row_lists.parquet")
    counts = term_frequencies(lines, joined_words(F.col("row_line")), "list_id", ["line_no"])
    return with_marks(counts, lines.where("list_id IS NOT NULL").select("list_id").distinct()).withColumnRenamed("term", "name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    marks = F.filter(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))), lambda x: x.isNotNull())
    return _term_counts(spark, d).select("name", F.explode(marks).alias("mark"))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return _term_counts(spark, d)


#: Fixed values of problem 3: table, id, vector, order of versions, length; then what p3_found asks for.
KINDS = {"theta": ("loading", "id", "theta", "fitted_at", 10), "rand_proj": ("bulk_cells", "col_id", "rand_proj", "computed_at", 24)}


def _vectors(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, int, object]:
    """(id, vec) of the current usable vectors, as they are compared; an upper bound of their number; a sample."""
    table, key, vec, latest, size = KINDS[kind]
    raw = spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).alias("id"), F.col(latest).alias("at"), F.col(vec).alias("vec"))

    def clean(df: DataFrame) -> DataFrame:
        if kind == "theta":
            return df.where(usable("vec", size, True)).withColumn("vec", F.transform("vec", lambda x: F.log(x)))
        return df.where(usable("vec", size) & F.exists("vec", lambda x: x != 0))

    total = raw.count()
    return clean(current_rows(raw, ["id"], "at", ["vec"])), total, sample_of(clean(raw), "vec", ["id", "at"], size, total)


def _log_theta(spark: SparkSession, d: str) -> tuple[DataFrame, int, object]:
    raw = spark.read.parquet(f"{d}/loading.parquet").select("id", F.col("fitted_at").alias("at"), F.col("log_theta").alias("vec"))
    clean = lambda df: df.where(usable("vec", 10))
    total = raw.count()
    return clean(current_rows(raw, ["id"], "at", ["vec"])), total, sample_of(clean(raw), "vec", ["id", "at"], 10, total)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows, total, sample = _log_theta(spark, d)
    return clusters(rows, 10, 0.25, total, sample).select("cluster_id", "id")


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every member with its tight group, the size of its cluster, the three most typical members, and the coarse bucket it was in."""
    rows, total, sample = _log_theta(spark, d)
    out = described(clusters(rows, 10, 0.25, total, sample), rows, 10)
    cells = spark.read.parquet(f"{d}/bulk_cells.parquet").select(F.col("col_id").alias("id"), "computed_at", "positions")
    return out.join(current_rows(cells, ["id"], "computed_at", ["positions"]), "id", "left")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs among each other's three nearest: theta by the distance of logarithms, rand_proj by cosine (|x - y|^2 = 2 - 2 cos)."""
    out = []
    for kind, radius in (("theta", 0.25), ("rand_proj", (2 - 2 * 0.98) ** 0.5)):
        rows, total, sample = _vectors(spark, d, kind)
        out.append(mutual_pairs(rows, KINDS[kind][4], 3, radius, total, sample, kind == "rand_proj").select(F.lit(kind).alias("vec_kind"), "id_a", "id_b"))
    return out[0].unionByName(out[1])


def p3_knn(spark: SparkSession, d: str) -> DataFrame:
    """The three most similar cells of every cell whose id is divisible by 100, against all cells."""
    out = []
    for kind in KINDS:
        rows, total, sample = _vectors(spark, d, kind)
        out.append(search(rows.where("id % 100 = 0"), rows, KINDS[kind][4], 3, total, sample, unit=kind == "rand_proj").select(F.lit(kind).alias("vec_kind"), "id_a", "id_b", F.round(F.sqrt("d2"), 9).alias("distance"), "rank"))
    return out[0].unionByName(out[1])


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(spark.read.parquet(f"{d}/documents.parquet")).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, pieces and tokens by how full the containers are (in percent, downwards)."""
    each = p6_containers(spark, d).where("container_id IS NOT NULL").groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("fill").alias("fill"))
    return each.groupBy(F.floor(F.col("fill") * 100).alias("percent")).agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")).where("shared_runs > 0").select("doc_id", "item_id").distinct()


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the items it holds: a run of 12 words, exact or with one edit for each 30 of its characters, or an aligned part that scores 72."""
    return leaked(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")).where("near OR score >= 72").groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("shared_runs").alias("shared_runs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{d}/documents.parquet")).where("repetitive").select(F.col("id").alias("doc_id"))


def p8_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{d}/documents.parquet")).withColumnRenamed("id", "doc_id")


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters, "p3_found": p3_found, "p3_knn": p3_knn, "p4_found": p4_found, "p4_terms": p4_terms, "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_found": p7_found, "p7_near": p7_near, "p8_found": p8_found, "p8_repetition": p8_repetition}

_TERMS = r"""
WITH w AS (SELECT list_id, line_no, regexp_split_to_array(trim(row_line, chr(32) || chr(9)), '[ \t]+') AS w FROM row_lists WHERE trim(row_line, chr(32) || chr(9)) <> ''),
n AS (SELECT DISTINCT list_id, line_no, array_to_string(w[1:2], '_') AS name FROM w),
c AS (SELECT name, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(DISTINCT list_id) AS BIGINT) AS n_records FROM n GROUP BY name),
m AS (SELECT *, n_records < 3 AS rare, n_records > 0.5 * (SELECT count(DISTINCT list_id) FROM row_lists) AS common FROM c)
"""


def _current(table: str, key: str, latest: str, vec: str, size: int, more: str = "") -> str:
    """(id, v): the current usable vectors."""
    good = " AND ".join(f"v[{i}] IS NOT NULL AND isfinite(v[{i}])" for i in range(1, size + 1))
    return f"SELECT id, v FROM (SELECT {key} AS id, max(struct_pack(a := {latest}, b := {vec})).b AS v FROM {table} WHERE {key} IS NOT NULL GROUP BY {key}) WHERE len(v) = {size} AND {good}{more}"


def _distance(size: int) -> str:
    return " + ".join(f"(x.v[{i}] - y.v[{i}]) * (x.v[{i}] - y.v[{i}])" for i in range(1, size + 1))


def _nearest(vectors: str, size: int) -> str:
    """(id_a, id_b, d2): the three nearest of all pairs."""
    pairs = f"SELECT x.id AS id_a, y.id AS id_b, {_distance(size)} AS d2 FROM {vectors} x JOIN {vectors} y ON x.id <> y.id"
    return f"SELECT id_a, unnest(near).b AS id_b, unnest(near).d AS d2 FROM (SELECT id_a, min(struct_pack(d := d2, b := id_b), 3) AS near FROM ({pairs}) GROUP BY id_a)"


def _mutual(kind: str, nearest: str, most: str) -> str:
    return f"SELECT '{kind}' AS vec_kind, f.id_a, f.id_b FROM {nearest} f JOIN {nearest} g ON f.id_a = g.id_b AND f.id_b = g.id_a WHERE f.id_a < f.id_b AND f.d2 <= {most}"


_THETA = _current("loading", "id", "fitted_at", "theta", 10, "".join(f" AND v[{i}] > 0" for i in range(1, 11)))
_PROJ = _current("bulk_cells", "col_id", "computed_at", "rand_proj", 24, " AND (" + " OR ".join(f"v[{i}] <> 0" for i in range(1, 25)) + ")")
_LENGTH = "sqrt(" + " + ".join(f"v[{i}] * v[{i}]" for i in range(1, 25)) + ")"
SQL = {
    # connected sets by handing on smaller ids
    "p2_found": f"""WITH RECURSIVE w AS MATERIALIZED ({_current('loading', 'id', 'fitted_at', 'log_theta', 10)}),
e AS MATERIALIZED (SELECT x.id AS s, y.id AS t FROM w x JOIN w y ON x.id <> y.id WHERE {_distance(10)} <= 0.0625e0),
r(id, root) AS (SELECT id, id FROM w UNION SELECT e.t, r.root FROM r JOIN e ON e.s = r.id WHERE r.root < e.t),
c AS (SELECT id, min(root) AS cluster_id FROM r GROUP BY id)
SELECT cluster_id, id FROM c QUALIFY count(*) OVER (PARTITION BY cluster_id) >= 3""",
    "p3_found": f"""WITH t AS MATERIALIZED (SELECT id, list_transform(v, lambda z: ln(z)) AS v FROM ({_THETA})),
p AS MATERIALIZED (SELECT id, list_transform(v, lambda z: z / n) AS v FROM (SELECT id, v, {_LENGTH} AS n FROM ({_PROJ}))),
tn AS MATERIALIZED ({_nearest('t', 10)}), pn AS MATERIALIZED ({_nearest('p', 24)})
{_mutual('theta', 'tn', '0.0625e0')} UNION ALL {_mutual('rand_proj', 'pn', '2e0 - 2e0 * 0.98e0')}""",
    "p4_found": _TERMS + "SELECT name, 'rare' AS mark FROM m WHERE rare UNION ALL SELECT name, 'common' AS mark FROM m WHERE common",
    "p4_terms": _TERMS + "SELECT name, n_lines, n_records, rare, common FROM m",
}
