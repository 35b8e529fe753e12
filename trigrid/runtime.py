"""Shared plumbing: tables in the cluster's shared folder, size-checked broadcasts, salted joins, current rows."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 50_000
#: Copies of the smaller side in a salted join.
SALTS = 16

_OWN_DIR: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_SHIPPED: set[str] = set()
_SCRATCH = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="trigrid-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], ignore_errors=True)
    return "file://" + _OWN_DIR[app]


def _written(spark: SparkSession) -> list[str]:
    """Where a path is noted that was written: with the innermost scratch of this thread, else with the application."""
    stack = getattr(_SCRATCH, "stack", None)
    return stack[-1] if stack else _WRITTEN.setdefault(spark.sparkContext.applicationId, [])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[tuple[DataFrame, str]], DataFrame]]:
    """All tables that materialize() writes within are deleted at its end, but for those given to the function it yields."""
    if not hasattr(_SCRATCH, "stack"):
        _SCRATCH.stack = []
    _SCRATCH.stack.append(inner := [])
    kept: list[str] = []

    def keep(table: tuple[DataFrame, str]) -> DataFrame:
        kept.append(table[1])
        return table[0]

    try:
        yield keep
    finally:
        _SCRATCH.stack.pop()
        release(spark, *(p for p in inner if p not in kept))
        _written(spark).extend(kept)


def materialize(df: DataFrame, name: str = "table", by: str | None = None) -> tuple[DataFrame, str]:
    """Write df to the shared folder and return it read back, with its path. Cuts the lineage and survives lost executors.

    by: a column of few values, each written by itself, so that a filter on it reads nothing else.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trigrid-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str | None) -> None:
    """Delete tables written by materialize() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in filter(None, paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that materialize() has written in this application: when no result is read any more."""
    release(spark, *_WRITTEN.pop(spark.sparkContext.applicationId, []))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def _scanned(plan) -> bool:
    """Whether a logical plan only reads, filters and projects."""
    if plan.nodeName() not in ("Project", "Filter", "LocalRelation", "LogicalRDD") and not plan.nodeName().startswith(("LogicalRelation", "Relation")):
        return False
    children = plan.children()
    return all(_scanned(children.apply(i)) for i in range(children.size()))


def held(df: DataFrame) -> DataFrame:
    """df, written and read back if it is more than a scan, so that counting it doesn't compute it twice."""
    return df if _scanned(df._jdf.queryExecution().optimizedPlan()) else materialize(df, "lookup")[0]


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", spread: Column | None = None, salts: int = SALTS) -> DataFrame:
    """Equi-join for skewed keys: rows of `big` go to one of `salts` copies of `small`, by `spread` (a hash of the whole row if not given).

    Null keys match nothing. `how` is inner, left, left_semi or left_anti, so every row of `big` meets all of its partners once.
    Always a merge join: Spark takes the size of the copies for that of one copy's file, and would send all of them through the driver.
    """
    spread = spread if spread is not None else F.xxhash64(*[F.col(f"`{c}`") for c in big.columns if not dict(big.dtypes)[c].startswith("map")])
    left = big.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "__salt"], how).drop("__salt")


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a lookup table: broadcast if it was counted to have at most `rows` rows, else salted. Same rows either way.

    The count runs when the join is defined, as the plan depends on it; a lookup that is more than a scan is written first and read by both.
    """
    small = held(small)
    return big.join(F.broadcast(small), on, how) if fits(small, rows) else salted_join(big, small, on, how)


def counted_join(big: DataFrame, small: DataFrame, on: list[str], n: int, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """lookup_join of a table that is known to have n rows: nothing runs."""
    return big.join(F.broadcast(small), on, how) if n <= rows else salted_join(big, small, on, how)


def current_rows(df: DataFrame, keys: list[str], latest: str, columns: list[str]) -> DataFrame:
    """The row with the largest `latest` of every key; exact copies count once.

    Of different rows with the same `latest`, the one with the largest columns (in the given order) is taken, a null
    `latest` comes last, rows with a null key are left out. Partial maxima are taken before the shuffle.
    """
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    best = known.groupBy(*keys).agg(F.max(F.struct(latest, *columns)).alias("__cur"))
    return best.select(*keys, *[F.col(f"__cur.{c}").alias(c) for c in columns])


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in the order of `order` (which has to be unique), without one task that sorts all rows.

    Range-partition, count each partition, add the counts before it. Only one count per partition is summed.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged, _ = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    from pyspark.sql import Window as W

    counts = ranged.groupBy("__part").count()
    base = counts.select("__part", (F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + (start - 1)).alias("__base"))  # one row a partition
    w = W.partitionBy("__part").orderBy(*order)
    return ranged.join(F.broadcast(base), "__part").withColumn(name, F.row_number().over(w) + F.col("__base")).drop("__part", "__base")


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application: a session may have been started where they can't import it.

    The archive is written to the shared folder and handed out by Spark, so that executors that join later get it, too.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    at = f"{shared_dir(spark)}/trigrid-package-{uuid.uuid4().hex}/trigrid.zip"
    package = Path(__file__).resolve().parent
    held_ = io.BytesIO()
    with zipfile.ZipFile(held_, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(held_.getvalue()))
    out.close()
    sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)
