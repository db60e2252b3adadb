"""Windowed, sessionised and guarded event queries; the same functions run on streams (see tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog.tables import read
from weft.operators import windows
from weft.registry import query
from weft.streaming import arcs, guard
from weft.streaming import events as E


@query("windowed_usage", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2, 3")
def windowed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.windowed(read(spark, sf_dir, "events"), "1 hour", ["event_type"], [F.count("*").alias("n"), F.count_distinct("user_id").alias("users")])


@query("user_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(read(spark, sf_dir, "events"), "6 hours", "user_id")


@query("repetition_guard")
def repetition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.posexplode(F.split("text", "\n")).alias("seq", "chunk"))
    return guard.guarded_batch(lines.withColumn("seq", F.col("seq").cast("long"))).groupBy("stream_id").agg(F.count("*").alias("chunks"), F.max("stopped").alias("stopped"))


@query("live_arcs")
def live_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language's documents as the chapters of a book, those with a licence line or a link as cuts: the fold of the stream."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("book"), F.col("text").rlike("(?i)licen[sc]ed under|https?://").alias("cut"))
    return arcs.arcs_of(windows.numbered(docs, ["book"], "doc_id", "place").select("book", "place", "cut"), 2, 5)
