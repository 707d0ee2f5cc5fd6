"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.llm.common import documents

SHARDS = 24
#: Each shard's slots are numbered in so many independent groups, for bounded tasks; 1000 million rows: 40,000 a group.
GROUPS = 1024
#: Digits of an MD5 value that make a draw in (0, 1].
DRAW = 13


def _digits(key: Column, salt: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(salt, F.lit(":"), key)), 1, DRAW), 16, 10).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a string key in [0, shards): bucket b jumps to floor((b + 1) / draw), the draw made from key and b
    alone, until that is beyond the last shard. So a key's shard under n + 1 is its shard under n, or n."""
    bucket = lambda b: F.floor((b + 1) / ((_digits(key, b.cast("string")) + 1) / F.lit(float(16**DRAW)))).cast("long")
    step = lambda s, _: F.when(s["next"] < shards, F.struct(s["next"].alias("at"), bucket(s["next"]).alias("next"))).otherwise(s)
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, groups: int = GROUPS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    The law is `key`: doc_id and the number of shards decide, and one more shard takes rows only into itself. Within a
    shard, slots follow a hash group of the key, then doc_id, checksum and size, so repeated rows get slots in any order
    among themselves. A null doc_id is a key of its own; a null text has size 8 and checksum 0. Other columns are ignored;
    an empty table gives an empty one.

    Counting reads the doc_id column alone and combines before the shuffle; the text is read once and only its length and
    checksum are shuffled, once, by (shard, group).
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = lambda df: df.withColumn("shard", jump_shard(key, shards)).withColumn("group", (_digits(key, F.lit("slot")) % groups).cast("int"))
    before = W.partitionBy("shard").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    counts = placed(docs.select("doc_id")).groupBy("shard", "group").count().select("shard", "group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = placed(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    order = W.partitionBy("shard", "group").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("row", F.row_number().over(order))
        .join(counts, ["shard", "group"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("row") - 1).cast("long").alias("slot"), jump_shard(key, shards + 1).alias("grown_shard"))
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
