"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots, thousands of them, once and for all. What
decides where a record lives is the slot-to-shard map, a small versioned table: version 1 deals the
slots out in turn, and rebalancing edits the latest version. An edit leaves a slot where it is as
long as its shard stays within its equal share of the bytes; only slots beyond the share (the
smallest ones, as large slots are kept first) and slots of closed shards move, each to the shard
with the least bytes. The bytes per slot are summed before the shuffle, and the edit works on one
array with an element per slot, so neither grows with the corpus.

A record's place in its shard is the place of its slot (slots of a shard one after the other) plus
its rank among the slot's records. Ranks are taken per slot and sub-slot, so that records with
equal keys, whose slot is the same, are no hot group.

Only DataFrame functions are used. The size of a record is the UTF-8 bytes of its text plus 1; null
texts have no bytes; records with null keys are hashed by their text like the others; repeated rows
are kept, each with a place of its own; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.llm.common import text_of
from trendloom.session import settle, work_dir

SLOTS = 8192
SHARDS = 16
SUB_SLOTS = 16


def slot_of(*key: str, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: the key decides, and the number of slots never changes."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Key, ``size``, ``text_crc32`` and ``virtual_slot`` of every document."""
    sized = docs.select(
        F.col(key),
        (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_of(text)).alias("_text"),
    )
    return sized.withColumn("virtual_slot", slot_of(key, "_text", slots=slots)).drop("_text")


def slot_bytes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("records")
    )


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: the slots dealt out in turn."""
    return spark.range(slots).select(
        F.lit(1).alias("version"),
        F.col("id").cast("int").alias("virtual_slot"),
        (F.col("id") % shards).cast("int").alias("shard"),
    )


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the stored maps; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def stored_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest one by default."""
    maps = spark.read.schema("virtual_slot int, shard int, version int").parquet(folder)
    chosen = F.lit(version) if version else maps.agg(F.max("version").alias("v")).first()["v"]
    return maps.filter(F.col("version") == chosen)


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map, for ``shards`` shards and the given bytes per slot."""
    known = slot_map.join(sizes, "virtual_slot", "left").select(
        F.struct(
            F.coalesce("bytes", F.lit(0)).alias("bytes"), "virtual_slot", "shard", "version"
        ).alias("slot")
    )
    # one element per slot, the largest first
    slots = known.agg(F.sort_array(F.collect_list("slot"), asc=False).alias("slots"))
    loads = F.array_repeat(F.lit(0).cast("long"), shards)

    def total(slots: Column) -> Column:
        return F.aggregate(slots, F.lit(0).cast("long"), lambda a, s: a + s["bytes"])

    # a slot beyond the mean fills a shard alone, and the others share the rest
    every = F.col("slots")
    huge = F.filter(every, lambda s: s["bytes"] > total(every) / shards)
    share = (total(every) - total(huge)) / F.greatest(F.lit(1), shards - F.size(huge))

    def add(load: Column, at: Column, size: Column) -> Column:
        return F.transform(load, lambda x, i: F.when(i == at, x + size).otherwise(x))

    def keep(state: Column, s: Column) -> Column:
        """A slot stays if its shard exists and is empty or has room within the share."""
        load = F.coalesce(F.get(state["load"], s["shard"]), F.lit(0))
        there = (s["shard"] < shards) & ((load == 0) | (load + s["bytes"] <= F.col("share")))
        at = F.when(there, s["shard"]).otherwise(F.lit(-1))
        return F.struct(
            add(state["load"], at, s["bytes"]).alias("load"),
            F.concat(state["at"], F.array(at)).alias("at"),
        )

    def move(state: Column, i: Column) -> Column:
        """A slot without a shard goes to the one with the least bytes."""
        lightest = (F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int")
        was = F.get(F.col("kept.at"), i)
        at = F.when(was >= 0, was).otherwise(lightest)
        size = F.when(was >= 0, F.lit(0).cast("long")).otherwise(F.get(F.col("slots"), i)["bytes"])
        return F.struct(
            add(state["load"], at, size).alias("load"),
            F.concat(state["at"], F.array(at)).alias("at"),
        )

    none = F.array().cast("array<int>")
    kept = slots.withColumn("share", share).withColumn(
        "kept", F.aggregate("slots", F.struct(loads.alias("load"), none.alias("at")), keep)
    )
    moved = kept.withColumn(
        "moved",
        F.aggregate(
            F.sequence(F.lit(0), F.size("slots") - 1),
            F.struct(F.col("kept.load").alias("load"), none.alias("at")),
            move,
        ),
    )
    return moved.select(F.explode(F.arrays_zip("slots", F.col("moved.at").alias("at"))).alias("x")).select(
        (F.col("x.slots.version") + 1).alias("version"),
        F.col("x.slots.virtual_slot").alias("virtual_slot"),
        F.col("x.at").alias("shard"),
    )


def place_records(placed: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``place`` (long, gapless from 0 in each shard)."""
    split = placed.withColumn("_sub", F.pmod(F.xxhash64("text_crc32", "size", "_row"), F.lit(SUB_SLOTS)))
    groups = ["virtual_slot", "_sub"]
    counts = split.groupBy(*groups).agg(F.count("*").alias("_count"))
    # a row per slot and sub-slot: the windows below run over at most slots x sub-slots rows
    before = Window.partitionBy("shard").orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(slot_map.select("virtual_slot", "shard"), "virtual_slot").select(
        *groups, "shard", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before")
    )
    rank = Window.partitionBy(*groups).orderBy(F.col(key).asc_nulls_first(), "text_crc32", "_row")
    return (
        split.withColumn("_rank", F.row_number().over(rank) - 1)
        .join(starts, groups)
        .select(*placed.columns, "shard", (F.col("_before") + F.col("_rank")).alias("place"))
        .drop("_row")
    )


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    slots: int = SLOTS,
    key: str = "doc_id",
    text: str = "text",
    maps: str | None = None,
) -> DataFrame:
    """Every document's shard and place under the latest map, after an edit for these documents.

    ``maps`` is the folder of the stored versions; without it a new one is begun in the shared
    folder. Columns: the key, ``size``, ``text_crc32``, ``virtual_slot``, ``shard``, ``place``.
    """
    spark = docs.sparkSession
    sized = records(docs, key, text, slots)
    # the number of a row is written down with it, so that later steps see the same one
    placed = settle(sized.withColumn("_row", F.monotonically_increasing_id()))
    if maps is None:
        maps = work_dir(spark, "slot-maps")
        store_map(first_map(spark, shards, slots), maps)
    store_map(settle(rebalance(stored_map(spark, maps), slot_bytes(placed), shards)), maps)
    return place_records(placed, stored_map(spark, maps), key)
