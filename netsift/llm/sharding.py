"""Sharding over a fixed number of virtual slots, with a versioned map from slots to shards.

A row belongs to a slot by the hash of its doc_id and text, for ever. Which shard a slot is in says the map, a small table
with one row per slot and version. Version 1 deals the slots round. `edit_map` makes the next version from the
bytes counted per slot: slots stay where they are as long as their shard isn't over its share; the smallest slots
of the shards that are go, largest first, to the shard that is least full. Shards may be added in the same way.

DataFrame operations only. The map and the sums per slot have SLOTS rows whatever the size of the data.

Edge cases: a null text has no bytes and counts as size 1; a null doc_id is hashed by the text alone; rows of one
doc_id with different texts are dealt like any others; rows that repeat doc_id and text are placed together, each in a
position of its own; an empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsift.llm.common import materialize, text_or_empty

SLOTS = 4096


def slot_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, slot, spread): `spread` is a second hash, to divide large slots."""
    text = text_or_empty()
    key = F.xxhash64(F.col("doc_id").cast("long"), text)  # a null leaves the hash to the text
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(key, F.lit(SLOTS)).cast("int").alias("slot"),
        F.shiftrightunsigned(key, 32).alias("spread"),
    )


def slot_totals(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each of the SLOTS slots, empty ones included."""
    counted = rows.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return (rows.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
            .join(counted, "slot", "left").na.fill(0, ["bytes", "rows"]))


def first_map(totals: DataFrame, shards: int) -> DataFrame:
    """Version 1: the slots dealt round."""
    return totals.select(F.lit(1).alias("version"), "slot", F.pmod("slot", F.lit(shards)).cast("int").alias("shard"), "bytes", "rows")


def edit_map(current: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of a map (version, slot, shard, bytes, rows) for `shards` shards of near equal bytes.

    A shard keeps its largest slots up to (1 - slack) of the mean; the others, and the slots of shards that are
    no more, are dealt to the least full shard, largest first.
    """
    mean = F.sum("bytes").over(Window.partitionBy("version")) / F.lit(shards)
    filled = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0))
    marked = (current.withColumn("_mean", mean).withColumn("_filled", filled)
              .withColumn("_stays", (F.col("shard") < shards) & (F.col("_filled") <= F.col("_mean") * (1 - slack))))
    start = F.struct(
        F.array(*[F.sum(F.when(F.col("_stays") & (F.col("shard") == s), F.col("bytes")).otherwise(0)).cast("long") for s in range(shards)]).alias("loads"),
        F.array().cast("array<struct<slot:int,shard:int>>").alias("moves"))
    state = marked.agg(start.alias("start"), F.sort_array(F.collect_list(F.when(~F.col("_stays"), F.struct(F.col("bytes"), F.col("slot")))), asc=False).alias("gone"))

    def deal(acc, item):
        # array_position counts from 1; the least full shard, the first of several
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == least, x + item["bytes"]).otherwise(x)).alias("loads"),
            F.concat(acc["moves"], F.array(F.struct(item["slot"].alias("slot"), least.alias("shard")))).alias("moves"))

    moves = state.select(F.explode(F.aggregate("gone", F.col("start"), deal)["moves"]).alias("m")).select("m.slot", F.col("m.shard").alias("_to"))
    return (current.join(F.broadcast(moves), "slot", "left")  # at most SLOTS rows
            .select((F.col("version") + 1).alias("version"), "slot", F.coalesce("_to", "shard").alias("shard"), "bytes", "rows"))


def place(rows: DataFrame, slot_map: DataFrame, per_bucket: int = 4096) -> DataFrame:
    """`rows` (of `slot_rows`) with shard and position, the positions of a shard being gapless from 0.

    A slot is divided by a second hash into buckets of about `per_bucket` rows, as many as its rows need. A window numbers the rows of a
    bucket, and the rows of the buckets before it in the shard are added.
    """
    parts = slot_map.select("slot", F.greatest(F.lit(1), F.ceil(F.col("rows") / per_bucket)).cast("int").alias("_parts"))  # SLOTS rows
    dealt = rows.join(F.broadcast(parts), "slot").withColumn("_part", F.pmod("spread", F.col("_parts")).cast("int")).drop("_parts")
    sizes = dealt.groupBy("slot", "_part").agg(F.count("*").alias("_n")).join(F.broadcast(slot_map.select("slot", "shard")), "slot")
    before = Window.partitionBy("shard").orderBy("slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("slot", "_part", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("slot", "_part").orderBy("doc_id", "text_crc32", "size")
    return (dealt.withColumn("_in", F.row_number().over(within) - 1).join(sizes, ["slot", "_part"])
            .withColumn("position", F.col("_base") + F.col("_in")).drop("_part", "_in", "_base", "spread"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every document with its shard, the shards being of near equal bytes (map version 2)."""
    rows = materialize(slot_rows(docs), "slot-rows")
    dealt_round = first_map(slot_totals(rows), shards)
    slot_map = materialize(edit_map(materialize(dealt_round, "slot-map-1"), shards), "slot-map-2")
    return place(rows, slot_map)
