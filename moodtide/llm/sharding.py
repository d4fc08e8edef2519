"""Sharding by fixed virtual slots.

A record's id decides its virtual slot, one of some thousands, for ever.  Bytes
are summed per slot, and a stored, versioned map says which shard holds each
slot.  Placing, rebalancing and growing only edit that map, never the hash.

Defined results: a null text has size 1 and checksum 0; a null id has a slot
like any other; rows with the same id share a slot and so a shard.  An empty
table still has a map, and gives no rows.  Only the id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodtide.llm.registry import query
from moodtide.session import scratch_path
from moodtide.sources.files import table

VIRTUAL_SLOTS = 4096
# Rows of a slot are numbered in this many parts, so that one id with many texts is spread.
PARTS = 8


def virtual_slot(key: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Id, virtual slot, size and checksum of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        virtual_slot(F.col(id_col), slots).alias("virtual_slot"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def slot_loads(rows: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Bytes and rows of every virtual slot, empty ones included: at most `slots` rows."""
    summed = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(summed, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def assigned(loads: DataFrame, shards: int) -> DataFrame:
    """A first map: the largest slot left goes to the shard with the fewest bytes so far.

    One fold over the sorted list of slots, whose length is fixed by the map
    and not by the data.
    """
    listed = loads.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False).alias("listed"))
    empty = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("held"),
        F.array().cast("array<int>").alias("shards"),
    )

    def place(state: Column, slot: Column) -> Column:
        held = state.getField("held")
        least = F.array_position(held, F.array_min(held)).cast("int") - 1
        grown = F.transform(held, lambda now, at: now + F.when(at == least, slot.getField("bytes")).otherwise(F.lit(0).cast("bigint")))
        return F.struct(grown.alias("held"), F.concat(state.getField("shards"), F.array(least)).alias("shards"))

    placed = listed.select("listed", F.aggregate("listed", empty, place).getField("shards").alias("shards"))
    zipped = placed.select(F.explode(F.arrays_zip("listed", "shards")).alias("z"))
    return zipped.select(
        F.col("z.listed.virtual_slot").alias("virtual_slot"), F.col("z.shards").cast("int").alias("shard"), F.col("z.listed.bytes").alias("bytes")
    )


def _filled_up(loads: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """Each slot with its shard and its place in a walk over that shard's slots."""
    held = current.select("virtual_slot", "shard").join(loads.select("virtual_slot", "bytes"), "virtual_slot")
    inside = Window.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    total = held.agg(F.sum("bytes").alias("total"))
    sums = held.withColumn("_upto", F.sum("bytes").over(inside)).withColumn("_held", F.sum("bytes").over(Window.partitionBy("shard")))
    return sums.join(F.broadcast(total)).withColumn("_fair", F.col("total") / F.lit(shards))


def grown(loads: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The map edited for one more shard, number `shards`, which alone receives slots.

    Every old shard hands over its smallest slots as long as they fit into
    what it holds beyond the fair share.
    """
    walk = _filled_up(loads, current, shards + 1)
    moves = F.col("_upto") <= F.col("_held") - F.col("_fair")
    return walk.select("virtual_slot", F.when(moves, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes")


def rebalanced(loads: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The map edited after sizes changed: slots beyond the fair share of an overfull shard move to underfull ones.

    Surplus slots and free room are laid side by side as ranges of bytes, and
    a slot goes to the shard whose room holds its middle.
    """
    walk = _filled_up(loads, current, shards)
    surplus = walk.where((F.col("_upto") <= F.col("_held") - F.col("_fair")) & (F.col("bytes") > 0))
    order = Window.orderBy("shard", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    moving = surplus.withColumn("_middle", F.sum("bytes").over(order) - F.col("bytes") / 2)
    every = loads.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    held = every.join(walk.groupBy("shard").agg(F.max("_held").alias("held"), F.max("_fair").alias("_fair")), "shard", "left")
    fair = F.coalesce(F.col("_fair"), F.max("_fair").over(Window.partitionBy()))
    room = held.select("shard", F.greatest(fair - F.coalesce("held", F.lit(0)), F.lit(0.0)).alias("room")).where("room > 0")
    upto = F.sum("room").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ranges = room.select(F.col("shard").alias("_to"), (upto - F.col("room")).alias("_from_byte"), upto.alias("_to_byte"))
    # Both sides are bounded by the number of slots and shards.
    found = moving.join(F.broadcast(ranges), (F.col("_middle") >= F.col("_from_byte")) & (F.col("_middle") < F.col("_to_byte")), "left")
    targets = found.select("virtual_slot", "_to")
    return walk.join(targets, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("_to", "shard").cast("int").alias("shard"), "bytes"
    )


def store_map(slot_map: DataFrame, folder: str, version: int) -> None:
    """Write a map as one version; an existing version is never changed."""
    slot_map.coalesce(1).write.mode("error").parquet(f"{folder}/version={version:06d}")


def stored_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version:06d}")


def placed(rows: DataFrame, slot_map: DataFrame, parts: int = PARTS) -> DataFrame:
    """Every record with its shard, and its gapless place `slot` in the shard.

    Places are counted inside (virtual slot, part) groups and shifted by what
    the groups before hold, so no task ever sees a whole shard.
    """
    split = rows.withColumn("_part", F.pmod(F.col("text_crc32"), F.lit(parts)).cast("int"))
    counts = split.groupBy("virtual_slot", "_part").agg(F.count(F.lit(1)).alias("_count"))
    known = counts.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = known.select("virtual_slot", "_part", "shard", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("virtual_slot", "_part").orderBy("doc_id", "text_crc32", "size")
    ranked = split.withColumn("_rank", F.row_number().over(inside).cast("bigint"))
    # At most slots x parts rows, whatever the data.
    joined = ranked.join(F.broadcast(shifts), ["virtual_slot", "_part"])
    return joined.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_shift") + F.col("_rank") - 1).alias("slot"), "virtual_slot"
    )


def write_shards(docs: DataFrame, slot_map: DataFrame, folder: str, id_col: str = "doc_id", slots: int = VIRTUAL_SLOTS) -> None:
    """Write the documents as one folder per shard; AQE splits large shards into several files."""
    key = "_shard"
    while key in docs.columns:
        key = f"_{key}"
    slot = f"{key}_slot"
    keyed = docs.withColumn(slot, virtual_slot(F.col(id_col), slots))
    lookup = slot_map.select(F.col("virtual_slot").alias(slot), F.col("shard").alias(key))
    keyed.join(F.broadcast(lookup), slot).drop(slot).hint("rebalance", key).write.partitionBy(key).parquet(folder)


def shard(
    docs: DataFrame, shards: int, folder: str, version: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Place all documents by a new map, stored below `folder` as the given version."""
    rows = records(docs, id_col, text_col)
    store_map(assigned(slot_loads(rows), shards), folder, version)
    return placed(rows, stored_map(docs.sparkSession, folder, version))


SHARDS = 16


@query("op5_virtual_slots")
def op5_virtual_slots(spark: SparkSession, sf: str) -> DataFrame:
    out = shard(table(spark, sf, "documents"), SHARDS, scratch_path(spark, "slot-map"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
