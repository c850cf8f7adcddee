"""Rendezvous sharding by record key; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Each shard is numbered in this many hash slices, so that one shard isn't sorted by one task.
SLICES = 256


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard that wins the key: the largest of -w / ln(u), with u in (0, 1) hashed from key and shard.

    A shard's score depends on no other shard: one more shard takes rows only into itself, and a changed
    weight moves rows only from or to that shard. Shards of weight 0 get nothing. A null key is a key of its own.
    """
    if not any(w > 0 for w in weights) or any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights must be finite, not negative, and one at least positive")
    scores = []
    for shard, w in enumerate(weights):
        if w > 0:
            top = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
            u = (top + 0.5) / float(1 << 53)
            scores.append(F.struct((F.lit(-float(w)) / F.log(u)).alias("score"), F.lit(shard).alias("shard")))
    return (scores[0] if len(scores) == 1 else F.array_max(F.array(*scores)))["shard"]


def assign(docs: DataFrame, shards: int = 16, weights: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard): every row of docs by the law `key`.

    grown_shard is the shard after one more of weight 1 is added. slot counts the rows of a shard from 0 without gaps:
    rows are numbered in SLICES hash slices a shard, and each slice starts where the ones before it end; only the
    shards x SLICES counts (a fixed bound) are broadcast. Equal keys go to one shard and get different slots;
    a null text has no bytes (size 1). Other columns of docs, whatever their names, are ignored.
    """
    weights = weights or [1.0] * shards
    if len(weights) != shards:
        raise ValueError("one weight for each shard")
    k = F.col(key)
    placed = docs.select(
        k.alias("__key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(k, weights).alias("shard"),
        rendezvous(k, [*weights, 1.0]).alias("grown_shard"),
        F.pmod(F.xxhash64(k, F.octet_length(text), F.lit("slot")), F.lit(SLICES)).alias("__slice"),
    )
    counts = placed.groupBy("shard", "__slice").count()
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    order = Window.partitionBy("shard", "__slice").orderBy("__key", "size", "text_crc32")
    return (
        placed.withColumn("__rank", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), ["shard", "__slice"])
        .select(
            F.col("__key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__start") + F.col("__rank")).alias("slot"), "grown_shard"
        )
    )
