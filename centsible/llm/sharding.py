"""Sharding by weighted rendezvous hashing.

Every row draws one number per shard from its key and the shard's number; the best draw, stretched by
the shard's weight, wins. A new shard only ever wins rows for itself, so growing from n to n+1 shards
moves about 1/(n+1) of the rows and nothing between old shards.

Edge cases: a null key is a key like any other; equal keys always share a shard; null text counts as
no bytes; an empty table gives no rows; further columns of the input are kept or dropped by the caller
and never read, names included (all working columns are made in one narrow projection).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centsible.llm.frames import written


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins the key. Draws are exponential with the weight as rate; the least wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    draws = []
    for shard, weight in enumerate(weights):
        uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard {shard}")), 11) + F.lit(0.5)) / F.lit(2.0**53)
        draws.append(F.struct((-F.log(uniform) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*draws)).getField("shard") if len(draws) > 1 else F.lit(0)


def assign_shards(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, for the larger set of weights, grown_shard.

    ``slot`` numbers the rows of a shard from 0 without gaps. It is made of two small steps instead of
    one sort per shard: rows are numbered inside (shard, part), where part is the piece of the table
    that held them, and each part begins where the counts of the parts before it end. No key, however
    often it repeats, collects in one task. Both steps read one written table, so a task that runs
    again counts the same rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(key, weights).cast("int").alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("part"),
    )
    rows = written(rows, "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        "grown_shard",
    )
