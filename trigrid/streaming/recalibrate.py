"""Streams of triplets: running statistics, and recalibration of every column as its triplets arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trigrid.operators.recal import pmf_stat, pmf_theta
from trigrid.operators.stats import TINY


def windowed_row_stat(stream: DataFrame, time: str = "loaded_at", every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, row_id, s1, s2, nnz) by event-time window; rows later than the watermark are left out, state older than it is dropped. Unusable values count nothing."""
    v = F.col("value")
    usable = stream.where(F.col("row_id").isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    timed = usable.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", every).alias("w"), "row_id").agg(F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.sum((F.abs(v) > TINY).cast("long")).alias("nnz"))
    return out.select(F.col("w.start").alias("start"), "row_id", "s1", "s2", "nnz")


def recalibrate_batches(stream: DataFrame, log_beta: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, iterations: int = 10) -> StreamingQuery:
    """Start a query that hands the loadings of each micro-batch's columns to sink(loadings, batch id).

    A column has to arrive whole within a batch (files hold whole columns). The dictionary is fixed, and nothing is stretched, as this would
    need the moments of columns yet to come: so each column's result is that of the batch operator with stretch_r = False.
    """

    def each(batch: DataFrame, number: int) -> None:
        stat = pmf_stat(batch.where("value > 0").groupBy("row_id", "col_id").agg(F.sum("value").alias("value")), log_beta, k, False)
        sink(pmf_theta(log_beta, stat, k, iterations=iterations, stretch_r=False), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
