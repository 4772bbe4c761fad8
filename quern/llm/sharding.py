"""Sharding over fixed virtual slots, in DataFrame operations only.

A record's virtual slot is a hash of its id (of its id and text where the id is null, so that rows
without an id do not meet in one slot) modulo a fixed number of slots. Bytes and rows are added up per
slot; a slot map, one row per slot, says which shard holds it. The map is versioned: rebalancing makes a
new version that moves few slots, and records never need to be hashed anew.

All that is gathered in one place is the slot table: `slots` rows, whatever the input.

Defined cases: null text has 0 bytes (size 1) and the crc32 of nothing, 0; an empty table gives an empty
result; repeated rows each get their own place; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(doc_id.isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(text)), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each row; the texts go no further than this projection."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        docs["doc_id"].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(docs["doc_id"], docs["text"], slots).alias("vslot"),
    )


def slot_loads(recs: DataFrame) -> DataFrame:
    return recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def build_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Slot map (version, vslot, shard, bytes, n, first): slots in order of falling bytes, each to the shard
    that is lightest so far (ties: lowest number), as one fold over the slot table. `first` is the place of
    the slot's first row within its shard."""
    slots = loads.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("key"), "vslot", "bytes", "n"))).alias("slots"))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("out"))

    def place(acc: Column, slot: Column) -> Column:
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda x, i: F.when(i == at - 1, x + slot["bytes"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(acc["out"], F.array(at - 1)).alias("out"))

    dealt = slots.select("slots", F.aggregate("slots", zero, place)["out"].alias("out"))
    rows = dealt.select(F.inline(F.zip_with("slots", "out", lambda s, shard: F.struct(s["vslot"].alias("vslot"), s["bytes"].alias("bytes"), s["n"].alias("n"), shard.alias("shard")))))
    return _with_first(rows, version)


def _with_first(rows: DataFrame, version: int) -> DataFrame:
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(F.lit(version).alias("version"), "vslot", "shard", "bytes", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def rebalance(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for another number of shards, moving few slots.

    Slots of shards that are gone move. Of every other shard the largest slots stay, as long as their bytes
    fit the new equal share; the rest moves to the shards in turn of their free space, so a new shard only
    takes slots in and a slot that fits stays where it is."""
    share = slot_map.agg(F.ceil(F.sum("bytes") / shards).alias("share"))
    held = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    marked = slot_map.withColumn("held", F.sum("bytes").over(held)).crossJoin(F.broadcast(share))
    marked = marked.withColumn("stays", (F.col("shard") < shards) & (F.col("held") <= F.col("share")))
    kept = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("kept"))
    free = slot_map.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(kept, "shard", "left").crossJoin(F.broadcast(share))
    free = free.select("shard", F.greatest(F.col("share") - F.coalesce("kept", F.lit(0)), F.lit(0)).alias("room")).agg(F.array_sort(F.collect_list(F.struct("shard", "room"))).alias("rooms"))
    moving = marked.where("not stays").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("key"), "vslot", "bytes", "n"))).alias("slots"))

    def place(acc: Column, slot: Column) -> Column:
        at = F.array_position(acc["room"], F.array_max(acc["room"])).cast("int")
        room = F.transform(acc["room"], lambda x, i: F.when(i == at - 1, x - slot["bytes"]).otherwise(x))
        return F.struct(room.alias("room"), F.concat(acc["out"], F.array(at - 1)).alias("out"))

    start = F.struct(F.transform("rooms", lambda r: r["room"]).alias("room"), F.array().cast("array<int>").alias("out"))
    moved = moving.crossJoin(F.broadcast(free)).select("slots", F.aggregate("slots", start, place)["out"].alias("out"))
    moved = moved.select(F.inline(F.zip_with("slots", "out", lambda s, shard: F.struct(s["vslot"].alias("vslot"), s["bytes"].alias("bytes"), s["n"].alias("n"), shard.alias("shard")))))
    version = slot_map.agg((F.max("version") + 1).alias("version"))
    rows = moved.unionByName(marked.where("stays").select("vslot", "bytes", "n", "shard"))
    return _with_first(rows, 0).drop("version").crossJoin(F.broadcast(version)).select("version", "vslot", "shard", "bytes", "n", "first")


def store_map(slot_map: DataFrame, folder: str) -> int:
    """Writes a map as its version's table in the folder; a version is never overwritten. Its number."""
    version = slot_map.agg(F.max("version")).first()[0] or 0
    slot_map.drop("version").coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")
    return version


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest where none is named."""
    maps = spark.read.schema("vslot int, shard int, bytes long, n long, first long, version int").parquet(folder)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, slot_map: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot (place in the shard, without gaps, from 0) of each row.

    Places need no sort over a shard: rows are numbered within their virtual slot and the map has where
    each slot begins, so one task sorts about a 1/slots share of the rows."""
    recs = records(docs, slots)
    slot_map = slot_map if slot_map is not None else build_map(slot_loads(recs), shards)
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = recs.withColumn("at", F.row_number().over(within).cast("long") - 1)
    placed = numbered.join(F.broadcast(slot_map.select("vslot", "shard", "first", "version")), "vslot")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot"), "vslot", F.col("version").alias("map_version"))
