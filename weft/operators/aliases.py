"""Names that stand for other names: chains followed to their end, with conflicts and cycles told."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft import storage


def closure(pairs: DataFrame, alias: str = "alias", host: str = "host") -> DataFrame:
    """alias, root, hops, status of every alias: where the chain alias -> host -> ... ends, and after how many steps.

    status: merged; conflict for an alias with several hosts, which is its own root (hops 0) and ends the chains that come
    to it; cycle for one whose chain never ends, whose root is the smallest name of that cycle (hops null). Pairs of a name
    with itself, repeated ones and nulls are left out.

    In each round an alias takes the place that its host has come to, so the part that it has behind it doubles: a chain
    of n names takes log2(n) rounds, and so does a cycle. An alias whose smallest place so far is itself has gone round
    its cycle and names it; whatever has passed that name leads there. A round stores only what was still open before it.
    Hosts with very many aliases are for adaptive execution, which splits the large side of a skewed join.
    """
    known = pairs.select(F.col(alias).alias("alias"), F.col(host).alias("host")).where("alias is not null and host is not null and alias <> host")
    by = known.groupBy("alias").agg(F.min("host").alias("host"), (F.min("host") != F.max("host")).alias("several"))
    # to: where the alias has come to; low: the smallest place on the way, without the alias itself
    first = by.select("alias", F.when(F.col("several"), F.col("alias")).otherwise(F.col("host")).alias("to"), F.when(F.col("several"), 0).otherwise(1).cast("long").alias("hops"), F.col("host").alias("low"), F.when(F.col("several"), "conflict").otherwise("open").alias("status"))
    rounds = [storage.stored(first, "alias-steps")]
    while (left := _left(rounds[-1]))[0]:
        now = rounds[-1].where("status = 'open'")
        if left[1]:
            named = now.where("low = alias").select(F.col("alias").alias("low"), F.lit("cycle").alias("__status"))
            now = now.join(named, "low", "left").select("alias", F.when(F.col("__status").isNull(), F.col("to")).otherwise(F.col("low")).alias("to"), "hops", "low", F.coalesce("__status", "status").alias("status"))
        ahead = reduce(DataFrame.unionByName, [*(r.where("status <> 'open'") for r in rounds), now])
        ahead = ahead.select(F.col("alias").alias("to"), F.col("to").alias("__to"), F.col("hops").alias("__hops"), F.col("low").alias("__low"), F.col("status").alias("__status"))
        # a place that is no alias is an end, and so is one with several hosts
        status = F.when(F.col("__status").isin("open", "cycle"), F.col("__status")).otherwise("merged")
        moved = now.where("status = 'open'").join(ahead, "to", "left").select("alias", F.coalesce("__to", "to").alias("to"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), F.least("low", F.coalesce("__low", "low")).alias("low"), status.alias("status"))
        rounds.append(storage.stored(moved.unionByName(now.where("status <> 'open'")) if left[1] else moved, "alias-steps"))
    settled = reduce(DataFrame.unionByName, (r.where("status <> 'open'") for r in rounds))
    return settled.select("alias", F.col("to").alias("root"), F.when(F.col("status") != "cycle", F.col("hops")).alias("hops"), "status")


def _left(steps: DataFrame) -> tuple[int, int]:
    """Aliases that are still open, and how many of these have come to themselves."""
    return tuple(steps.where("status = 'open'").agg(F.count("*"), F.count(F.when(F.col("low") == F.col("alias"), 1))).first())
