"""Context assembly: which pieces of a corpus go into a budget for a query, by relevance and recency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import budget, retrieval, windows


def context(docs: DataFrame, queries: DataFrame, group: str, recent: int = 3, relevant: int = 5, characters: int = 32_000) -> DataFrame:
    """For each query (query_id, group, query): the group's latest documents and its most relevant ones, within a budget.

    docs: group, name (ascending in time), text. Documents of other groups are never scored. Result: query_id, name,
    size, required (the latest ones), priority (relevance in thousandths), taken, decision.
    """
    rows = docs.join(queries, group)
    rows = rows.select("query_id", "name", F.length("text").cast("long").alias("size"), T.gram_relevance(F.col("text"), F.col("query")).alias("relevance"))
    last = windows.top(rows, ["query_id"], [F.col("name").desc()], recent).select("query_id", "name", F.lit(True).alias("required"))
    best = retrieval.ranked(rows, ["query_id"], [F.col("relevance").desc(), F.col("name")]).where(F.col("rank") <= relevant).select("query_id", "name", F.lit(False).alias("required"))
    chosen = last.unionByName(best).groupBy("query_id", "name").agg(F.max("required").alias("required"))
    blocks = rows.join(chosen, ["query_id", "name"]).select("query_id", "name", "size", "required", F.floor(F.col("relevance") * 1000).cast("long").alias("priority"))
    return budget.plan(blocks, "query_id", characters)
