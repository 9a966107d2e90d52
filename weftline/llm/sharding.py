"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's shard depends on the key and the number of shards and on nothing else.
When one shard is appended, a key either stays or moves into the new shard, and
one key in n + 1 moves. No ring table exists, so nothing has to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.runtime import checked_broadcast, kept

#: The linear congruential step of the published algorithm (fixed values).
MULTIPLIER = 2862933555777941757
MODULUS = 1 << 64


def _decimal(value: int, digits: int = 20) -> Column:
    return F.lit(str(value)).cast(f"decimal({digits},0)")

#: Parts of a shard that are numbered side by side, in the order of their keys; a shard is never sorted in one task.
SUB_BUCKETS = 64

#: Rows that one part has about, at most: parts are cut again by ranges of the key, as many as the rows ask for.
PART_ROWS = 50_000


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): where key goes among ``shards`` shards and among one more.

    Each turn of the loop moves to a higher shard, so shards + 1 turns always
    suffice; turns after the last jump change nothing. Products need more than
    64 bits and are taken in decimals. A null key goes where 0 goes.
    """
    key = F.coalesce(key.cast("long"), F.lit(0))
    start = key.cast("decimal(20,0)") + F.when(key < 0, _decimal(MODULUS)).otherwise(_decimal(0))
    state = F.struct(start.cast("decimal(20,0)").alias("k"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"))

    def turn(s: Column, _: Column) -> Column:
        k = ((s.k * _decimal(MULTIPLIER, 19) + _decimal(1, 1)) % _decimal(MODULUS)).cast("decimal(20,0)")
        high = F.call_function("div", k, _decimal(1 << 33))
        j = F.floor((s.j + 1) * (F.lit(float(1 << 31)) / (high + 1).cast("double"))).cast("long")
        moved = F.struct(k.alias("k"), j.alias("j"), F.when(s.j < shards, s.j).otherwise(s.shard).alias("shard"), s.j.alias("grown"))
        return F.when(s.j <= shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), state, turn)


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", sub_buckets: int = SUB_BUCKETS) -> DataFrame:
    """Every row of docs with size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus one (a null text has none) and slot
    numbers the rows of a shard from 0 without a gap. Rows of equal key, text and
    size are alike, so reruns agree. A null key counts as 0; texts of any length
    only give their size and checksum. An empty table gives an empty result; other
    columns of docs are dropped.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hop = jump(F.col(key), shards)
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        hop.alias("hop"),
    ).select("doc_id", "size", "text_crc32", F.col("hop.shard").cast("int").alias("shard"), F.col("hop.grown").cast("int").alias("grown_shard"))
    part = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(sub_buckets)) + F.pmod("text_crc32", F.lit(sub_buckets)), F.lit(sub_buckets))
    placed = kept(placed.withColumn("sub", part.cast("int")), "shards")
    # ranges of the key cut a part again without changing the order of its rows
    ranges = max(1, -(-placed.count() // (shards * sub_buckets * PART_ROWS)))
    cuts = placed.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    cut = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    placed = placed.withColumn("cut", F.when(F.col("doc_id").isNull(), 0).otherwise(cut))
    counts = placed.groupBy("shard", "sub", "cut").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("sub", "cut").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "sub", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "sub", "cut").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(checked_broadcast(starts), ["shard", "sub", "cut"]).select(  # a row per part
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).alias("slot"), "grown_shard"
    )
