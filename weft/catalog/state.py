"""Upsert, cascade, lifecycle and budget queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog.tables import read
from weft.operators import aggregates, budget, upsert
from weft.registry import query

_LAST = "(SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS c_mktsegment FROM orders GROUP BY 1)"


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders


@query("upsert_latest", f"SELECT c_custkey, coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM (SELECT c_custkey, c_mktsegment FROM customer) c FULL JOIN {_LAST} n USING (c_custkey)")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = _segments(spark, sf_dir)
    return upsert.upsert(customers, orders, ["c_custkey"], ["o_orderdate", "o_orderkey"])


@query("insert_if_absent", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) GROUP BY 1")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = _segments(spark, sf_dir)
    return upsert.insert_absent(read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(*customers.columns), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"])


@query("cascade_delete", "SELECT (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (3, 7)) AS customers, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7))) AS orders, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)))) AS lines")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"nation": read(spark, sf_dir, "nation"), "customer": read(spark, sf_dir, "customer"), "orders": read(spark, sf_dir, "orders"), "lineitem": read(spark, sf_dir, "lineitem")}
    links = [("nation", "n_nationkey", "customer", "c_nationkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]
    left = upsert.cascade(tables, tables["nation"].where("n_nationkey in (3, 7)"), "n_nationkey", links)
    n = lambda t, name: left[t].agg(F.count("*").alias(name))  # noqa: E731  one row each
    return n("customer", "customers").join(n("orders", "orders")).join(n("lineitem", "lines"))


@query("pending_decisions", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND c_mktsegment <> '' THEN c_mktsegment ELSE o_orderpriority END AS value FROM orders JOIN customer ON c_custkey = o_custkey")
def pending_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", upsert.applied(F.col("o_orderpriority"), F.col("c_mktsegment"), F.col("o_totalprice") > 100_000).alias("value"))


@query("budget_prefix", "SELECT source, doc_id, used::BIGINT AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS used FROM documents) WHERE used <= 32000")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.within(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", (-F.col("doc_id")).alias("o")), ["source"], "o", "n_chars", 32_000).select("source", "doc_id", "used")


@query("budget_plan")
def budget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a conversation's turns as the blocks of its context
    blocks = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("name"), F.length("text").cast("long").alias("size"), (F.col("turn") == 0).alias("required"), F.pmod(F.col("turn") * 7, F.lit(11)).alias("priority"))
    return budget.plan(blocks, "conv_id", 600)


@query("lifecycle_threads")
def lifecycle_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "resolve").when(F.col("event_type") == "click", "bury").otherwise("hint")
    actions = read(spark, sf_dir, "events").select("user_id", "event_id", action.alias("action"), F.concat(F.lit("Item "), F.coalesce(F.get_json_object("props", "$.k"), F.lit("?"))).alias("what"))
    return upsert.lifecycle(actions, "user_id", ["event_id"])


@query("stage_rollup", "SELECT user_id, d // 10 AS stage, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events) GROUP BY 1, 2")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return read(spark, sf_dir, "events").groupBy("user_id", F.floor(day / 10).alias("stage")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("latest_scores", "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM orders GROUP BY 1")
def latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return aggregates.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_totalprice").alias("last_price"))
