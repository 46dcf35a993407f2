"""Weighted rendezvous hashing of stable record keys over shards (law ``key``).

Every record scores each shard by ``-ln(u) / weight`` with ``u`` in (0, 1)
drawn from the record key and the shard's number alone, and goes to the least
score (Thaler and Ravishankar 1998; weighted form by Schindelhauer and
Schomaker 2005). A further shard only adds one score per record, so a record
either stays or moves into the new shard. The key is the id as text; it does
not depend on the text, on other rows or on their order.

Slots number the rows of a shard from 0 without gaps. Rows are dealt over
``buckets`` hash buckets per shard; the numbers of rows in the
``shards * buckets`` cells give each cell's first slot, so no task ever sees a
whole shard.

Defined cases: null ids share the key ``null``; a null text has size 1 and the
CRC-32 of the empty text; rows that are alike in every way get slots of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import field, row_keyed, stage

#: Cells per shard for numbering: bounds the broadcast of first slots and the rows that one window partition sorts.
BUCKETS = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of least score; the lower number on a tie."""
    def score(shard: int, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")
        return -F.ln((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))
    best = F.array_min(F.array(*[F.struct(score(i, w).alias("score"), F.lit(i).alias("shard"))
                                 for i, w in enumerate(weights)]))
    return best.getField("shard")


def shard_records(docs: DataFrame, shards: int = 8, weights: Sequence[float] | None = None,
                  next_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
                  buckets: int = BUCKETS) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of ``next_weight``)."""
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards or min([*weights, next_weight]) <= 0:
        raise ValueError("one positive weight per shard")
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = (row_keyed(docs).select(field(id_col).alias("id"), field(text_col).cast("string").alias("text"), "_rx")
              .select("id", "_rx", (F.octet_length(text) + 1).cast("long").alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"),
                      rendezvous(key, weights).alias("shard"),
                      rendezvous(key, [*weights, next_weight]).alias("grown_shard"))
              .withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32", "size", "_rx"), F.lit(buckets)).cast("int")))
    placed = stage(placed)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("shard", "bucket").count().select(
        "shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_slot"))
    cell = Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_last(), "text_crc32", "size", "_rx")
    # one row per cell: shards * buckets at most
    return (placed.withColumn("n", F.row_number().over(cell)).join(F.broadcast(firsts), ["shard", "bucket"])
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("first_slot") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard"))
