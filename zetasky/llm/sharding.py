"""Sharding through fixed virtual slots.

A record's slot is a hash of its id; thousands of slots exist whatever the number of shards. Bytes are summed per
slot, and a small versioned map says which shard holds a slot. Growing or rebalancing edits the map, so only the
records of the slots that it moves change place.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import free_name

#: Three hex digits of a hash: 4096 slots. The map is as long, so broadcasting it is bounded.
SLOT_DIGITS = 3
N_SLOTS = 16**SLOT_DIGITS
#: Parts of a slot by text, so that the rows of one id, or of none, need not all be put in order by one task.
PARTS = 16


def virtual_slot(key):
    """Slot of an id column; null ids share the slot of the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, SLOT_DIGITS), 16, 10).cast("int")


def initial_map(n_shards: int) -> list[int]:
    """Shard of every slot, by turns."""
    return [v % n_shards for v in range(N_SLOTS)]


def grow(slot_map: list[int]) -> list[int]:
    """The map with one more shard, which takes an even share of slots from the fullest; no other slot moves."""
    new, held, out = max(slot_map) + 1, Counter(slot_map), list(slot_map)
    for _ in range(len(slot_map) // (new + 1)):
        donor = min(held, key=lambda s: (-held[s], s))
        out[max(v for v, s in enumerate(out) if s == donor)] = new
        held[donor] -= 1
    return out


def rebalance(slot_map: list[int], slot_bytes: dict[int, int], tolerance: float = 0.02) -> list[int]:
    """Move slots from the shard with most bytes to the one with fewest while that narrows the gap."""
    out, load = list(slot_map), {s: 0 for s in slot_map}
    for v, s in enumerate(out):
        load[s] += slot_bytes.get(v, 0)
    mean = sum(load.values()) / len(load)
    while True:
        high, low = max(load, key=load.get), min(load, key=load.get)
        gap = load[high] - load[low]
        movable = [(slot_bytes.get(v, 0), v) for v, s in enumerate(out) if s == high and 0 < slot_bytes.get(v, 0) < gap]
        if gap <= tolerance * mean or not movable:
            return out
        size, v = min(movable, key=lambda x: (abs(x[0] - gap / 2), x[1]))
        out[v], load[high], load[low] = low, load[high] - size, load[low] + size


def write_map(spark: SparkSession, slot_map: list[int], path: str, version: int) -> None:
    """Append a version of the map as Parquet; versions are kept."""
    spark.createDataFrame([(version, v, s) for v, s in enumerate(slot_map)], "version int, vslot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A stored version of the map, the latest by default."""
    stored = spark.read.parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    return [r.shard for r in stored.filter(F.col("version") == version).orderBy("vslot").select("shard").collect()]


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot(F.col("doc_id")).alias("vslot"))
    return rows.withColumn("part", (F.col("text_crc32") % PARTS).cast("int"))


def slot_bytes(docs: DataFrame) -> DataFrame:
    """Bytes and rows of every slot that has any: at most N_SLOTS rows, summed on the map side first."""
    return sized(docs).groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def assign_shards(docs: DataFrame, slot_map: list[int], grown_map: list[int], version: int = 1) -> DataFrame:
    """Place every document by law ``key``: its id and the map's shard count decide, whatever other rows there are.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, size (UTF-8 bytes plus 1),
    text_crc32, law, shard, slot (position in the shard, gapless from 0, by virtual slot, its part and id), grown_shard (under
    ``grown_map``), vslot, slot_bytes and map_version. A null text has size 1 and CRC 0; null ids share one virtual
    slot; repeated rows get positions of their own; an empty table gives no rows. Rows are dealt by virtual slot
    and part without their texts; positions need the rows before a part in its shard, at most N_SLOTS * PARTS counts.
    """
    spark = docs.sparkSession
    lookup = spark.createDataFrame([(v, s, g) for v, (s, g) in enumerate(zip(slot_map, grown_map, strict=True))], "vslot int, shard int, grown_shard int")
    before = F.sum("part_rows").over(Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("part_rows")
    parts = sized(docs).groupBy("vslot", "part").agg(F.count("*").alias("part_rows"), F.sum("size").alias("part_bytes"))
    slots = parts.join(F.broadcast(lookup), "vslot").withColumn("before", before).withColumn("slot_bytes", F.sum("part_bytes").over(Window.partitionBy("vslot")))
    within = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        sized(docs)
        .withColumn("within", within)
        .join(F.broadcast(slots.select("vslot", "part", "shard", "grown_shard", "slot_bytes", "before")), ["vslot", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), "grown_shard", "vslot", "slot_bytes", F.lit(version).alias("map_version"))
    )


def write_shards(docs: DataFrame, slot_map: list[int], path: str) -> None:
    """Write the documents, with all their columns, under ``shard=N`` folders; each slot's rows go to one task of their shard.

    Where ``docs`` has a column ``shard`` itself, in any case, the folders' name has underscores behind it until it is free.
    """
    spark, slot, shard = docs.sparkSession, free_name(docs, "vslot"), free_name(docs, "shard")
    lookup = spark.createDataFrame(list(enumerate(slot_map)), f"`{slot}` int, `{shard}` int")
    placed = docs.withColumn(slot, virtual_slot(F.col("doc_id"))).join(F.broadcast(lookup), slot).repartition(slot)
    placed.drop(slot).write.mode("overwrite").partitionBy(shard).parquet(path)
