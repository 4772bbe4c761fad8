"""Running values in blocks against plain windows, with keys that spread over many blocks."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from quern.operators.scan import BLOCK, KEY, Scan


def rows(n):
    rng = random.Random(n)
    key = lambda: rng.choice(["hot"] * 6 + [None, "a", "b"])
    return [(key(), i, rng.choice([None, -3, 1, 2, 5]), rng.random() < 0.2) for i in range(n)]


def test_as_windows(spark):
    df = spark.createDataFrame(rows(3000), "k string, i int, v int, stop boolean").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scan = Scan(df, ["k"], ["i"])
        scan = scan.sum(F.col("v"), "s").sum(F.col("v"), "b", before=True, total="t").max(F.col("s"), "m").lag(F.col("v"), "l", -1)
        got = scan.rows().select("k", "i", "v", "s", "b", "t", "m", "l").collect()
        assert scan.df.where("k = 'hot'").select(BLOCK).distinct().count() > 2 and KEY in scan.df.columns
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    w = Window.partitionBy("k").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("s", F.sum("v").over(upto)).withColumn("b", F.coalesce("s", F.lit(0)) - F.coalesce("v", F.lit(0))).withColumn("t", F.sum("v").over(Window.partitionBy("k")))
    want = want.withColumn("m", F.max("s").over(upto)).withColumn("l", F.lag("v", 1, -1).over(w)).select("k", "i", "v", "s", "b", "t", "m", "l").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_descending_order_no_key_and_empty(spark):
    df = spark.createDataFrame(rows(500), "k string, i int, v int, stop boolean")
    got = Scan(df, [], [F.col("i").desc()]).sum(F.lit(1), "n").rows()
    assert got.where("n + i <> 500").count() == 0
    assert Scan(df.limit(0), ["k"], ["i"]).sum(F.lit(1), "n").rows().collect() == []


def test_a_group_is_in_no_task_whole(spark):
    """The plan has no window over the keys alone but the one over one row for each key and block."""
    df = spark.createDataFrame(rows(100), "k string, i int, v int, stop boolean")
    plan = Scan(df, ["k"], ["i"]).sum(F.col("v"), "s").rows()._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 2 and sum(BLOCK in line.split("], [")[1] for line in windows) >= 1
