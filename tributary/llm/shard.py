"""Sharding by jump consistent hashing, in DataFrame functions only.

A document's shard follows from its id and the number of shards alone. There is no ring table, and with one
more shard a row either stays or moves into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER = 2862933555777941757
SLICES = 256


def jump(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of Lamping and Veach's jump consistent hash for a non-negative long key.

    The generator s = s * MULTIPLIER + 1 mod 2**64 is kept as two halves, and products are taken in parts of 48
    bits, so that no long overflows. A key makes `shards` jumps at most; steps after the last do nothing.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    low, high, half = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32, 0xFFFFFFFF
    lit = lambda x: F.lit(x).cast("long")
    start = F.struct(lit(-1).alias("b"), lit(0).alias("j"), F.shiftright(key, 32).alias("hi"), key.bitwiseAND(lit(half)).alias("lo"))

    def step(a: Column, _: Column) -> Column:
        hi, lo = a["hi"], a["lo"]
        p = lo.bitwiseAND(lit(0xFFFF)) * lit(low) + lit(1)
        t = F.shiftright(lo, 16) * lit(low) + F.shiftright(p, 16)
        lo2 = F.shiftleft(t.bitwiseAND(lit(0xFFFF)), 16).bitwiseOR(p.bitwiseAND(lit(0xFFFF)))
        cross = (lo * lit(high)).bitwiseAND(lit(half)) + hi.bitwiseAND(lit(0xFFFF)) * lit(low) + F.shiftleft((F.shiftright(hi, 16) * lit(low)).bitwiseAND(lit(0xFFFF)), 16)
        hi2 = (F.shiftright(t, 16) + cross).bitwiseAND(lit(half))
        next_ = F.floor((a["j"] + lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi2, 1) + lit(1)).cast("double")))
        return F.when(a["j"] >= shards, a).otherwise(F.struct(a["j"].alias("b"), next_.cast("long").alias("j"), hi2.alias("hi"), lo2.alias("lo")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda a: a["b"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard, its place there, and the shard it would have with one more.

    Returns id, size (UTF-8 bytes of the text and 16 more), text_crc32, law ('key'), shard, slot, grown_shard.
    A null id has the key of the word null, a null text no bytes; rows with one id share a shard and are told
    apart by the checksum of their text (equal rows by chance). Other columns are ignored; an empty table gives
    no rows. Slots count from 0 in each shard, in the order of the id's MD5.

    A shard may be far larger than a task: slots are numbered in `SLICES` parts of each shard by the leading
    digits of that MD5, and each part starts where the counts of the parts before it end. The table of counts
    has shards * SLICES rows at most, so it is broadcast.
    """
    id_, text = docs[id_col], docs[text_col]
    md5 = F.md5(F.coalesce(id_.cast("string"), F.lit("null")))
    body = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    slim = docs.select(id_.alias(id_col), (F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 16).alias("size"), F.crc32(body).alias("text_crc32"), md5.alias("_md5"))
    key = F.conv(F.substring("_md5", 1, 15), 16, 10).cast("long")
    placed = slim.withColumn("shard", jump(key, shards)).withColumn("grown_shard", jump(key, shards + 1)).withColumn("_part", F.conv(F.substring("_md5", 1, 2), 16, 10).cast("int"))
    ids = docs.select(F.md5(F.coalesce(id_.cast("string"), F.lit("null"))).alias("_md5"))
    counts = ids.select(jump(F.conv(F.substring("_md5", 1, 15), 16, 10).cast("long"), shards).alias("shard"), F.conv(F.substring("_md5", 1, 2), 16, 10).cast("int").alias("_part")).groupBy("shard", "_part").count()
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    there = Window.partitionBy("shard", "_part").orderBy("_md5", "text_crc32", "size")
    return placed.join(F.broadcast(starts), ["shard", "_part"]).select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.row_number().over(there) - 1).cast("long").alias("slot"), "grown_shard")
