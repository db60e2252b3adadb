"""Sharding by weighted rendezvous hashing: DataFrame functions only.

Each (record key, shard) pair has a pseudo-random score; the best score wins the record. A shard's score depends
on nothing but the key, the shard and its weight, so adding a shard moves rows only into it, and removing one moves
only its own rows. Scores are -ln(u) / weight with u uniform in (0, 1): the smallest wins with a probability in
proportion to the weight.

Placing is a projection, without a shuffle. Slots (a gapless number within each shard) need counts: rows are dealt
to many small buckets per shard, the buckets' counts are prefix-summed, and rows are numbered within their bucket,
so no shard is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common

#: Buckets per shard for slots. At 10 billion rows a shard, a bucket has about 150,000.
BUCKETS = 1 << 16


def score(key: Column, shard: int, weight: float) -> Column:
    """The cost of putting `key` on `shard`: exponential with rate `weight`."""
    top53 = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.log((top53 + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 .. len(weights) - 1) of `key`. Shards of weight 0 get nothing; a null key is a key as any other."""
    if not any(w > 0 for w in weights) or min(weights) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scored = [F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.least(*scored) if len(scored) > 1 else scored[0]).getField("shard")


def shard(rows: DataFrame, key: str, weights: list[float], slot_order: list[str]) -> DataFrame:
    """Adds `shard` (int) and `slot` (long, gapless from 0 within each shard) to rows, which must be a stored table.

    Equal keys share a shard. Slots follow a hash of `slot_order`, then these columns; rows that are equal in all of
    them get any order. No row is dropped; an empty table gives an empty one.
    """
    spot = F.pmod(F.xxhash64(*slot_order, F.lit("slot")), F.lit(BUCKETS)).cast("int")
    placed = rows.withColumn("shard", rendezvous(F.col(key), weights)).withColumn("__spot", spot)
    placed = placed.withColumn("__one", F.lit(1).cast("long"))
    return common.prefix_sum(placed, "__one", "slot", ["shard"], F.col("__spot"), [F.col(c) for c in slot_order]).drop("__one", "__spot")


def sharded_documents(docs: DataFrame, shards: int = 8, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; only doc_id and text are read.

    size is the UTF-8 bytes of the text plus 1; a null text counts as empty. grown_shard is the shard with one more
    shard of the mean weight. Rows with a null doc_id share one shard; repeated rows are all kept.
    """
    weights = weights or [1.0] * shards
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard(common.stored(rows, "shard-rows"), "doc_id", weights, ["doc_id", "text_crc32"])
    grown = rendezvous(F.col("doc_id"), [*weights, sum(weights) / len(weights)])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sharded_documents of all documents."""
    return sharded_documents(common.documents(spark, sf_dir))
