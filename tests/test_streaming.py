from __future__ import annotations

from pyspark.sql import functions as F

from trigrid.operators import recal
from trigrid.streaming.recalibrate import recalibrate_batches, windowed_row_stat


def source(spark, tmp_path):
    df = spark.range(600).select((F.col("id") % 20 + 1).alias("row_id"), (F.floor(F.col("id") / 20) + 1).alias("col_id"), ((F.col("id") * 7) % 5).cast("double").alias("value"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 30).alias("loaded_at"))
    df.where("col_id <= 15").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.where("col_id > 15").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_each_batch_is_recalibrated(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    x = spark.range(1, 21).select(F.col("id").alias("row_id"), F.array(F.log(F.col("id") * 1.0), F.log(21.0 - F.col("id"))).alias("v"))
    got = []
    q = recalibrate_batches(stream, x, 2, lambda out, n: got.extend(out.collect()), f"{tmp_path}/cp", 3)
    q.awaitTermination()
    want = recal.pmf_theta(x, recal.pmf_stat(df.where("value > 0"), x, 2, False), 2, iterations=3, stretch_r=False)
    key = lambda r: (r["id"], [round(t, 9) for t in r["theta"]])
    assert sorted(map(key, got)) == sorted(map(key, want.collect()))


def test_windows(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    q = windowed_row_stat(stream, every="1 hour").writeStream.format("memory").queryName("stat").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(s1) FROM stat").first()[0] == df.agg(F.sum("value")).first()[0]
    assert spark.table("stat").count() == df.groupBy(F.window("loaded_at", "1 hour"), "row_id").count().count()
