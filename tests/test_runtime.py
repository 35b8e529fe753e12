from __future__ import annotations

import glob

from pyspark.sql import functions as F

from trigrid import runtime


def test_scratch_deletes_all_but_what_is_kept(spark):
    at = runtime.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{at}/*"))
    with runtime.scratch(spark) as keep:
        a, _ = runtime.materialize(spark.range(5), "a")
        with runtime.scratch(spark) as inner:
            runtime.materialize(a, "b")
            c = inner(runtime.materialize(a.where("id > 1"), "c"))
        d = keep(runtime.materialize(c, "d"))
        assert c.count() == 3
    left = set(glob.glob(f"{at}/*")) - before
    assert d.count() == 3 and len(left) == 1 and "trigrid-d-" in left.pop()


def test_lookups_agree(spark):
    """Broadcast, salted and with a known count: the same rows, null keys match nothing."""
    big = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(100)], "k long, x long")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "k long, y string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        results = [sorted(map(str, r.collect())) for r in (runtime.lookup_join(big, small, ["k"], how), runtime.lookup_join(big, small.distinct(), ["k"], how, rows=1), runtime.counted_join(big, small, ["k"], 3, how), runtime.counted_join(big, small, ["k"], 3, how, rows=2))]
        assert all(r == results[0] for r in results) and results[0]


def test_salted_copies_are_never_broadcast(spark):
    """However small Spark takes the file of a lookup to be: its copies would pass through the driver."""
    big = spark.range(2000).withColumn("k", F.col("id") % 700)
    small, _ = runtime.materialize(spark.range(600).select(F.col("id").alias("k"), (-F.col("id")).alias("y")), "small")
    for how, n in (("left", 2000), ("inner", 1800), ("left_semi", 1800), ("left_anti", 200)):
        joined = runtime.lookup_join(big, small, ["k"], how, rows=100)
        assert joined.count() == n
        joined.collect()
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in runtime.lookup_join(big, small, ["k"])._jdf.queryExecution().executedPlan().toString()  # counted to be small
