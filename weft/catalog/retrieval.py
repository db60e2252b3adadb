"""Vector search, fusion, re-ranking and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog.tables import read
from weft.functions import vector
from weft.operators import graph, retrieval, vectors
from weft.registry import query

_PAIRS = "SELECT q.vec_id AS query_id, r.vec_id AS row_id, {score} AS score FROM embeddings q JOIN embeddings r ON q.label = r.label WHERE q.vec_id % 50 = 0"
_RANKED = "SELECT query_id, row_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, row_id) AS r FROM ({pairs})) WHERE r <= {k}"
_COSINE = _PAIRS.format(score="list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[])")
_L2 = _PAIRS.format(score="1 / (1 + list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]))")


def _knn(spark: SparkSession, sf_dir: str, k: int, metric: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.nearest(queries, rows.withColumnRenamed("vec_id", "row_id"), k, metric, "label")


@query("knn_cosine", _RANKED.format(pairs=_COSINE, k=5))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 5, "cosine").select("query_id", "row_id", "score")


@query("knn_l2", _RANKED.format(pairs=_L2, k=5))
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 5, "l2").select("query_id", "row_id", "score")


@query("gap_filter", f"SELECT query_id, row_id FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS t FROM (SELECT query_id, row_id, round(score, 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, row_id) AS r FROM ({_COSINE}) WHERE query_id <> row_id) WHERE r <= 10) WHERE s >= t - 0.04")
def gap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _knn(spark, sf_dir, 11, "cosine").where("query_id <> row_id")
    best = retrieval.ranked(found.drop("rank"), ["query_id"], [F.col("score").desc(), F.col("row_id")]).where("rank <= 10")
    return retrieval.near_top(best, ["query_id"], "score", 0.04).select("query_id", "row_id")


def _rank_sql(pairs: str) -> str:
    return f"SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, row_id) AS rank FROM ({pairs})"


@query("rrf_fusion", f"SELECT query_id, row_id, round(sum(1 / (60 + rank)), 12) AS score FROM (SELECT * FROM ({_rank_sql(_COSINE)}) WHERE rank <= 20 UNION ALL SELECT * FROM ({_rank_sql(_L2)}) WHERE rank <= 20) GROUP BY 1, 2")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fused([_knn(spark, sf_dir, 20, m) for m in ("cosine", "l2")], ["query_id", "row_id"]).withColumn("score", F.round("score", 12))


@query("unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS square, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.dot(e, e), 6).alias("square"), F.round(F.aggregate(vector.normalized(e), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("key_tier_rerank", "SELECT p_partkey, tier::INT AS tier, row_number() OVER (PARTITION BY p_size ORDER BY tier, p_retailprice, p_partkey) AS new_rank FROM (SELECT *, CASE WHEN p_type = 'STANDARD' AND p_brand LIKE 'Brand#1%' THEN 0 WHEN p_type = 'STANDARD' THEN 1 ELSE 2 END AS tier FROM part)")
def key_tier_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = retrieval.ranked(read(spark, sf_dir, "part"), ["p_size"], [F.col("p_retailprice"), F.col("p_partkey")], "position")
    return retrieval.tiers(part, ["p_size"], "position", (F.col("p_type") == "STANDARD") & F.col("p_brand").like("Brand#1%"), F.col("p_type") == "STANDARD").select("p_partkey", "tier", "new_rank")


@query("keyword_rank", "SELECT p_partkey, s AS score FROM (SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 5 ELSE 0 END + len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'ring'))) AS s FROM part) WHERE s > 0")
def keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = retrieval.keyword_score(F.col("p_name"), F.split("p_name", " "), "ring")
    return read(spark, sf_dir, "part").select("p_partkey", score.alias("score")).where("score > 0")


_EDGES = "(SELECT 'c' || o_custkey AS a, 's' || l_suppkey AS b, 'buys' AS kind, count(*) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    counts = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("weight"))
    return counts.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), F.lit("buys").alias("kind"), "weight")


@query("one_hop", f"SELECT node, other, weight, rank FROM (SELECT a AS node, b AS other, weight, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS rank FROM {_EDGES} WHERE CAST(a[2:] AS BIGINT) % 50 = 0) WHERE rank <= 10")
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    seeds = read(spark, sf_dir, "orders").where("o_custkey % 50 = 0").select(F.concat(F.lit("c"), "o_custkey").alias("node")).distinct()
    return graph.expand(seeds, edges, {"buys": 10}).select("node", "other", "weight", "rank")


@query("graph_edges_top80", f"SELECT a, b, weight FROM {_EDGES} WHERE CAST(a[2:] AS BIGINT) % 50 = 0 ORDER BY weight DESC, a, b LIMIT 80")
def graph_edges_top80(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return graph.touching(_edges(spark, sf_dir), seeds, 80).select("a", "b", "weight")


@query("graph_degrees", f"SELECT node, kind, count(*) AS degree, max(weight) AS strongest FROM (SELECT a AS node, kind, weight FROM {_EDGES} UNION ALL SELECT b, kind, weight FROM {_EDGES}) GROUP BY 1, 2")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


@query("graph_without", f"SELECT a, b, weight FROM {_EDGES} WHERE b NOT IN ('s1', 's2', 's3') AND a NOT LIKE 'c1%'")
def graph_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    gone = edges.select(F.col("a").alias("node")).where("node like 'c1%'").union(edges.select("b").where("b in ('s1', 's2', 's3')"))
    return graph.without(edges, gone).select("a", "b", "weight")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))


_FIRST_FIT = """(WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
near AS MATERIALIZED (SELECT a.i, list(b.i) FILTER (WHERE b.i < a.i AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.3) AS js FROM e a, e b GROUP BY 1),
fold AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS labels UNION ALL SELECT near.i, list_append(labels, coalesce(list_min(list_transform(js, lambda j: labels[j])), near.i)) FROM fold JOIN near ON near.i = fold.i + 1),
named AS (SELECT unnest(labels) AS label, generate_subscripts(labels, 1) AS i FROM fold WHERE i = (SELECT max(i) FROM e))
SELECT e.vec_id, f.vec_id AS cluster, e.v FROM named JOIN e USING (i) JOIN e f ON f.i = named.label)"""


@query("first_fit_clusters", f"SELECT vec_id, cluster FROM {_FIRST_FIT}")
def first_fit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the vectors of this table are nearly random: at 0.80 each would be alone
    return vectors.first_fit(_vectors(spark, sf_dir), 0.3).select(F.col("row_id").alias("vec_id"), "cluster")


@query("cluster_cohesion", f"WITH c AS MATERIALIZED {_FIRST_FIT} SELECT n.cluster, n.n, round(s, 6) AS avg_sim FROM (SELECT cluster, count(*) AS n FROM c GROUP BY 1) n LEFT JOIN (SELECT a.cluster, avg(list_cosine_similarity(a.v, b.v)) AS s FROM c a JOIN c b ON a.cluster = b.cluster AND a.vec_id < b.vec_id GROUP BY 1) USING (cluster)")
def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return vectors.cohesion(vectors.first_fit(rows, 0.3), rows).withColumn("avg_sim", F.round("avg_sim", 6))


def _indexed_knn(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    queries = rows.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    return vectors.searched(queries, vectors.indexed(rows, buckets=16), 10, probes=12, exact=exact).select("query_id", "row_id", "score")


@query("indexed_knn_exact", _RANKED.format(pairs=_COSINE.replace("q.label = r.label", "TRUE"), k=10))
def indexed_knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed_knn(spark, sf_dir, True)


@query("indexed_knn")
def indexed_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: its recall against the exact search is measured in tests/test_vectors.py."""
    return _indexed_knn(spark, sf_dir, False)


_DAMAGE = "CASE WHEN vec_id % 17 = 4 THEN 'null' WHEN vec_id % 11 = 3 THEN 'ragged' WHEN vec_id % 13 = 5 THEN 'dimension' WHEN vec_id % 19 = 6 THEN 'zero' WHEN vec_id % 23 = 7 THEN 'not finite' END"


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings packed, some of them damaged in each of the ways that decoded() tells apart, and read back."""
    rows, v = read(spark, sf_dir, "embeddings"), F.col("embedding")
    zero, far = F.transform(v, lambda x: F.lit(0.0).cast("float")), F.transform(v, lambda x, i: F.when(i == 1, F.lit(float("inf"))).otherwise(x).cast("float"))
    blob = vectors.packed(F.when(F.expr(f"{_DAMAGE} = 'zero'"), zero).when(F.expr(f"{_DAMAGE} = 'not finite'"), far).otherwise(v))
    damage = F.expr(_DAMAGE)
    cut = F.when(damage == "null", None).when(damage == "ragged", F.expr("substring(blob, 1, octet_length(blob) - 1)")).when(damage == "dimension", F.expr("substring(blob, 5)")).otherwise(F.col("blob"))
    return vectors.decoded(rows.select("vec_id", blob.alias("blob")).withColumn("blob", cut), "blob", 64)


@query("packed_vectors", f"SELECT vec_id, p AS problem, CASE WHEN p IS NULL THEN round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) END AS norm, CASE WHEN p IS NULL THEN round(list_sum(embedding::DOUBLE[]), 6) END AS total FROM (SELECT *, {_DAMAGE} AS p FROM embeddings)")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.when(F.col("problem").isNull(), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 6))
    return _decoded(spark, sf_dir).select("vec_id", "problem", F.round("norm", 6).alias("norm"), total.alias("total"))


@query("vector_quarantine", f"SELECT coalesce({_DAMAGE}, 'ok') AS problem, count(*) AS n FROM embeddings GROUP BY 1")
def vector_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.quarantine_counts(_decoded(spark, sf_dir))
