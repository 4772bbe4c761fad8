import random

import pytest

from quern.llm.common import connected_components


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_components_against_union_find(spark, chunk):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 420)] + [(500, 500 + i) for i in range(60)] + [(7, 7), (None, 3)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    want = {n: top(n) for n in list(parent) if top(n) != n}
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), chunk=chunk)
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_staged_table_leaves_no_shuffle_files(spark):
    """They are gone when the write ends, whenever the JVM collects garbage; the session's settings are as before."""
    import glob
    import time

    from pyspark.sql import functions as F
    from quern.llm import common
    from quern.operators import staging

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}
    was, rows = {k: spark.conf.get(k, None) for k in common.STAGING}, spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    for write in (lambda: common.staged(rows, "few"), lambda: staging.staged(rows)):
        before = files()
        assert len(write().collect()) == 7
        until = time.time() + 10
        while files() - before and time.time() < until:
            time.sleep(0.2)
        assert not files() - before
        assert {k: spark.conf.get(k, None) for k in common.STAGING} == was
