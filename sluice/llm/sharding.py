"""Sharding by jump consistent hashing (Lamping and Veach, 2014), native.

A shard is a function of a stable key and the number of shards alone: no ring
table is kept, and when one shard is appended only the rows that go into the
new shard move. Everything here is a Column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The algorithm's linear congruential multiplier, in limbs of 22, 22 and 20 bits.
MULTIPLIER = 2862933555777941757
_M22 = (1 << 22) - 1
_M0, _M1, _M2 = MULTIPLIER & _M22, MULTIPLIER >> 22 & _M22, MULTIPLIER >> 44


def jump(key: Column, shards: int) -> Column:
    """struct<shard, grown>: the buckets of key among shards and among shards + 1.

    The 64-bit product is formed from limbs, since a long product that wraps is
    an error under ANSI mode. A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda v: F.lit(v).cast("long")
    start = F.struct(
        key.bitwiseAND(long(_M22)).alias("k0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(long(_M22)).alias("k1"),
        F.shiftrightunsigned(key, 44).alias("k2"),
        long(0).alias("j"),
        long(-1).alias("shard"),
        long(-1).alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        c0 = s["k0"] * _M0 + 1
        c1 = s["k1"] * _M0 + s["k0"] * _M1 + F.shiftrightunsigned(c0, 22)
        c2 = s["k2"] * _M0 + s["k1"] * _M1 + s["k0"] * _M2 + F.shiftrightunsigned(c1, 22)
        n1, n2 = c1.bitwiseAND(long(_M22)), c2.bitwiseAND(long((1 << 20) - 1))
        top = F.shiftleft(n2, 11) + F.shiftrightunsigned(n1, 11) + 1
        moved = F.struct(
            c0.bitwiseAND(long(_M22)).alias("k0"),
            n1.alias("k1"),
            n2.alias("k2"),
            F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / top.cast("double"))).cast("long").alias("j"),
            F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"),
            s["j"].alias("grown"),
        )
        return F.when(s["j"] > shards, s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_group: int = 2000) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the text's UTF-8 bytes plus 16; a null text has no bytes. The law is
    'key': key and shard count alone decide, and grown_shard is the shard among
    one more, equal to shard or the new one. slot numbers the rows of a shard
    from 0 without gaps.

    A shard may be far larger than a task should be, so rows are numbered within
    groups of about rows_per_group (by a hash of key and text, so that the texts of a
    repeated key are in many groups), and a group's offset is the sum of the counts of
    the shard's groups before it.

    Keys are cast to bigint, which is an error under ANSI for one that is no number.
    Null keys count as 0. Repeated rows get slots of their own. An empty table gives
    no rows. Other columns are not read.
    """
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("body"))
    groups = max(1, math.ceil(source.count() / (shards * rows_per_group)))
    part = F.pmod(F.xxhash64("id", "body"), F.lit(groups)).cast("int")
    keys = source.select(jump(F.col("id"), shards)["shard"].alias("g_shard"), part.alias("g_part"))
    before = Window.partitionBy("g_shard").orderBy("g_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keys.groupBy("g_shard", "g_part").count().select("g_shard", "g_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = source.select(
        "id",
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump(F.col("id"), shards).alias("j"),
        part.alias("part"),
    ).select("id", "size", "text_crc32", F.col("j.shard").alias("shard"), F.col("j.grown").alias("grown_shard"), "part")
    order = Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(order))
    joined = numbered.join(offsets, (F.col("shard") == F.col("g_shard")) & (F.col("part") == F.col("g_part")))
    return joined.select(F.col("id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).alias("slot"), "grown_shard")
