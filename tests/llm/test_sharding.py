import zlib

from quern.llm import sharding as S


def test_sizes_places_and_balance(awkward, awkward_rows):
    rows = S.shard(awkward, 4).collect()
    want = sorted(((d is not None, d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in awkward_rows)
    assert sorted(((r["doc_id"] is not None, r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    for s in range(4):
        places = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert places == list(range(len(places)))
    assert {r["shard"] for r in rows} <= set(range(4))


def test_bytes_are_near_equal(spark):
    docs = spark.createDataFrame([(i, "w" * (1 + i * 37 % 900)) for i in range(4000)], "doc_id long, text string")
    load = {r["shard"]: r["b"] for r in S.shard(docs, 16).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()}
    assert len(load) == 16 and max(load.values()) - min(load.values()) < 2000


def test_rebalancing_moves_little(spark):
    docs = spark.createDataFrame([(i, "w" * (1 + i * 37 % 900)) for i in range(4000)], "doc_id long, text string")
    first = S.build_map(S.slot_loads(S.records(docs)), 4)
    more, less = S.rebalance(first, 5), S.rebalance(first, 3)
    was = {r["vslot"]: r["shard"] for r in first.collect()}
    total = first.agg({"bytes": "sum"}).first()[0]
    for after, shards in ((more, 5), (less, 3)):
        now = after.collect()
        assert {r["version"] for r in now} == {2} and {r["vslot"] for r in now} == set(was)
        moved = sum(r["bytes"] for r in now if r["shard"] != was[r["vslot"]])
        assert moved < 1.1 * total * (1 / 5 if shards == 5 else 1 / 4)
        load = [sum(r["bytes"] for r in now if r["shard"] == s) for s in range(shards)]
        assert max(load) - min(load) < 0.05 * total / shards
        if shards == 5:
            assert all(r["shard"] in (was[r["vslot"]], 4) or r["bytes"] < 4000 for r in now)
        places = S.shard(docs, shards, slot_map=after).where("shard = 1").select("slot").toPandas().slot
        assert sorted(places) == list(range(len(places)))


def test_empty_table_and_no_python(empty, awkward):
    assert S.shard(empty, 4).collect() == []
    plan = S.shard(awkward, 4)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_stored_versions(spark, tmp_path, empty):
    docs = spark.createDataFrame([(i, "w" * (1 + i * 37 % 900)) for i in range(500)], "doc_id long, text string")
    first = S.build_map(S.slot_loads(S.records(docs)), 4)
    assert S.store_map(first, str(tmp_path)) == 1 and S.store_map(S.rebalance(S.load_map(spark, str(tmp_path)), 5), str(tmp_path)) == 2
    one, two = (S.load_map(spark, str(tmp_path), v) for v in (1, None))
    assert {r["shard"] for r in one.collect()} == set(range(4)) and {r["shard"] for r in two.collect()} == set(range(5))
    assert {tuple(r) for r in S.shard(docs, 4, slot_map=one).collect()} == {tuple(r) for r in S.shard(docs, 4).collect()}
    S.store_map(S.build_map(S.slot_loads(S.records(empty)), 4), str(tmp_path / "none"))
    assert S.shard(empty, 4, slot_map=S.load_map(spark, str(tmp_path / "none"), 0)).collect() == []
