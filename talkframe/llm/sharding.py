"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Records hash into a fixed number of slots. Bytes are summed per slot, and only the map from slots
to shards is edited when shards are added or have become uneven; a record never changes its slot.

Cases: a null text has size 1; a null id is hashed with the text's checksum, so rows without an id
spread as well; repeated rows share a slot and get positions of their own; an empty table gives an
empty result; columns of the input that are named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
SHARDS = 16


def size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def checksum(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds size, text_crc32 and virtual_slot."""
    docs = docs.withColumns({"size": size(F.col("text")), "text_crc32": checksum(F.col("text"))})
    return docs.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(slotted: DataFrame) -> DataFrame:
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 0: slots dealt to shards in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).alias("version"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map: slots leave a shard only where it would pass its even part.

    Slots are taken from the largest to the smallest. One stays where it is while its shard has
    room below the mean, else it goes to the shard with the fewest bytes so far. The fold runs
    over one row that holds the slots, whose number is fixed.
    """
    known = slot_map.join(F.broadcast(sizes), "virtual_slot", "left")
    listed = known.agg(
        F.array_sort(F.collect_list(F.struct((-F.coalesce("bytes", F.lit(0))).alias("less"), "virtual_slot", "shard"))).alias("s"),
        F.max("version").alias("version"),
        F.expr(f"CAST(ceil(coalesce(sum(bytes), 0) / {shards}) AS BIGINT)").alias("even"),
    )
    placed = F.expr(f"""
        aggregate(s,
          named_struct('loads', array_repeat(0L, {shards}), 'placed', CAST(array() AS ARRAY<STRUCT<virtual_slot: INT, shard: INT>>)),
          (a, x) -> transform(
            array(CASE WHEN x.shard < {shards} AND a.loads[least(x.shard, {shards - 1})] - x.less <= even THEN x.shard
                       ELSE CAST(array_position(a.loads, array_min(a.loads)) - 1 AS INT) END),
            t -> named_struct(
              'loads', transform(a.loads, (v, i) -> IF(i = t, v - x.less, v)),
              'placed', concat(a.placed, array(named_struct('virtual_slot', x.virtual_slot, 'shard', t)))))[0]).placed""")
    rows = listed.select(F.explode(placed).alias("p"), "version")
    return rows.select("p.virtual_slot", "p.shard", (F.col("version") + 1).alias("version"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the stored map."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest unless one is named."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("virtual_slot", "shard", F.col("version").cast("int"))


def place(slotted: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and version. The map has one row per slot, so it is broadcast."""
    return slotted.drop("shard", "version").join(F.broadcast(slot_map), "virtual_slot")


def positions(slotted: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds shard, version and each row's place within its shard, gapless from 0.

    Rows are numbered within a slot; a slot starts where the slots before it in its shard end.
    """
    before = F.sum(F.coalesce("rows", F.lit(0))).over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slot_map.join(F.broadcast(sizes), "virtual_slot", "left").select("virtual_slot", "shard", "version", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    numbered = slotted.drop("shard", "version", "slot").withColumn("_own", own)
    return numbered.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("_start") + F.col("_own") - 1).drop("_start", "_own")


def balanced_map(slotted: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Sizes per slot and the first map edited to fit them."""
    sizes = slot_sizes(slotted)
    return sizes, rebalance(first_map(slotted.sparkSession, slots, shards), sizes, shards)


def shard_table(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One narrow row per record with its shard and its place there."""
    slotted = with_slots(docs.select("doc_id", "text"), slots).drop("text")
    sizes, slot_map = balanced_map(slotted, shards, slots)
    placed = positions(slotted, slot_map, sizes)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


def shard_rows(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The records themselves with their slot and shard; no text is shuffled."""
    slotted = with_slots(docs, slots)
    _, slot_map = balanced_map(slotted, shards, slots)
    return place(slotted, slot_map).withColumnRenamed("version", "map_version")
