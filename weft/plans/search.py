"""Hybrid search: filters, a vector and a keyword channel, fusion, top-up and re-ranking in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import dictionary, retrieval


def hybrid(queries: DataFrame, rows: DataFrame, tenant: str, channel: int = 20, share: float = 0.3, most: int = 10, exact: Column | None = None) -> DataFrame:
    """query_id, row_id, score, tier, rank of the best `most` rows of a query's tenant.

    queries: query_id, tenant, vector, word; rows: row_id, tenant, vector, text, made (the larger, the newer). The vector
    channel has the `channel` nearest rows by cosine whose score is at least `share` of the best one's. The keyword
    channel has those with the most occurrences of the query's word. Both are fused by reciprocal ranks. `exact` (over
    the columns of both; texts of queries are q_*) puts a row in tier 0 and before the others. Queries with fewer
    results are topped up with the newest rows of their tenant (score 0, tier 2).
    """
    near = retrieval.nearest(queries, rows, channel, "cosine", tenant)
    near = retrieval.above_share(near, ["query_id"], "score", share).select("query_id", "row_id", "rank")
    asked = queries.select("query_id", tenant, *(F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("query_id", tenant, "vector")))
    # a query's rows depend on its tenant and word only: each text is read once for all words, and the best rows of a word
    # are found before queries come in
    wanted = asked.select(tenant, F.lower("q_word").alias("__word")).where("__word <> ''").distinct()
    hits = dictionary.counted(rows.select("row_id", tenant, F.lower("text").alias("__text")), "__text", wanted, "__word").drop("__text", "first")
    hits = hits.join(wanted, [tenant, "__word"], "left_semi")
    best = retrieval.ranked(hits, [tenant, "__word"], [F.col("n").desc(), F.col("row_id")]).where(F.col("rank") <= channel)
    words = asked.select("query_id", tenant, F.lower("q_word").alias("__word")).join(best, [tenant, "__word"]).select("query_id", "row_id", "rank")
    both = retrieval.fused([near, words], ["query_id", "row_id"])
    known = both.join(rows.drop("vector"), "row_id").join(asked.drop(tenant), "query_id")
    found = known.select("query_id", "row_id", "score", F.when(exact if exact is not None else F.lit(False), 0).otherwise(1).alias("tier"))
    newest = retrieval.ranked(rows.select("row_id", tenant, "made"), [tenant], [F.col("made").desc(), F.col("row_id")]).where(F.col("rank") <= 2 * most)
    more = asked.select("query_id", tenant).join(newest, tenant).join(found.select("query_id", "row_id"), ["query_id", "row_id"], "left_anti")
    more = more.select("query_id", "row_id", F.lit(0.0).alias("score"), F.lit(2).alias("tier"), F.col("rank").alias("__new"))
    every = found.withColumn("__new", F.lit(0)).unionByName(more)
    order = [F.col("tier"), F.col("score").desc(), F.col("__new"), F.col("row_id")]
    return retrieval.ranked(every, ["query_id"], order).where(F.col("rank") <= most).drop("__new")
