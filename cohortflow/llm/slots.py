"""Sharding by fixed virtual slots: records hash into thousands of slots, slots are dealt to shards by their bytes.

The number of slots never changes, so a record's slot never does. ``slot_sizes`` sums bytes per slot, ``first_map`` deals
slots to shards (largest slot first, each to the lightest shard), ``rebalanced`` edits a map with few moves, and maps are
stored as versions. Only the table of slots (a fixed few thousand rows) is ever in one row; records are joined with it by
slot. DataFrame functions only.

A null text counts 0 bytes and has the checksum of no bytes; a null id hashes by its text alone. Rows repeated in full
share a slot. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLOTS = 4096
OVERHEAD = 8


def slot_of(id_col: Column, crc: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record; texts count too, so that rows of one id do not share a slot."""
    return F.pmod(F.xxhash64(id_col, crc), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return rows.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows): map-side sums, one row a slot at most."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(sizes: Column, loads: Column) -> Column:
    """Deals (bytes, virtual_slot) in their order, each to the lightest shard; the shards of the slots in that order."""
    def step(acc, x):
        to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(F.transform(acc["loads"], lambda v, i: F.when(i == to, v + x["bytes"]).otherwise(v)).alias("loads"),
                        F.concat(acc["shards"], F.array(to)).alias("shards"))
    zero = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))
    return F.aggregate(sizes, zero, step, lambda acc: acc["shards"])


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """(virtual_slot, shard): version 1 of a map. Slots sorted by bytes (then number), each to the lightest shard."""
    gathered = sizes.agg(F.reverse(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")))).alias("s"))  # at most SLOTS entries
    dealt = gathered.select("s", _dealt(F.col("s"), F.array_repeat(F.lit(0).cast("long"), shards)).alias("to"))
    return dealt.select(F.inline(F.arrays_zip(F.col("s.virtual_slot").alias("virtual_slot"), F.col("to").alias("shard"))))


def rebalanced(sizes: DataFrame, slot_map: DataFrame, shards: int, tolerance: float = 0.01) -> DataFrame:
    """The map edited for new sizes or another shard count: a slot stays unless its shard is gone or above the mean by more
    than ``tolerance``; the slots that leave (largest first while the excess lasts) go to the lightest shards."""
    both = sizes.join(slot_map, "virtual_slot", "left")
    total = both.agg(F.sum("bytes").alias("total"))
    w = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    kept = both.withColumn("run", F.sum("bytes").over(w)).join(F.broadcast(total)).withColumn(
        "stays", F.col("shard").isNotNull() & (F.col("shard") < shards) & (F.col("run") <= F.col("total") / shards * (1 + tolerance)))
    stay = kept.where("stays").select("virtual_slot", "shard")
    loads = kept.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    start = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("m"))
    gone = kept.where("NOT stays").agg(F.reverse(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")))).alias("s"))
    base = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0).cast("long")))
    dealt = gone.join(F.broadcast(start)).select("s", _dealt(F.col("s"), base).alias("to"))
    return stay.unionByName(dealt.select(F.inline(F.arrays_zip(F.col("s.virtual_slot").alias("virtual_slot"), F.col("to").alias("shard")))))


def save_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Store a map as a new version; an existing version is never overwritten. Returns the stored map."""
    place = f"{path}/version={version}"
    slot_map.coalesce(1).write.mode("errorifexists").parquet(place)
    return slot_map.sparkSession.read.parquet(place)


def place(rows: DataFrame, slot_map: DataFrame, per_slot: DataFrame) -> DataFrame:
    """Rows with their shard and their position there: positions run through the shard's slots in order."""
    w = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)  # over slots, not records
    starts = per_slot.join(slot_map, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("at", at).join(starts, "virtual_slot").withColumn("slot", F.col("start") + F.col("at") - 1).drop("at", "start")
