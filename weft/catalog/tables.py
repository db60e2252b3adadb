"""The tables of a folder, and views of them in the shape that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a usage log: whole tokens from value, hits from props, every seventh event an estimate, errors failed."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    tokens = F.floor(F.abs(F.coalesce("value", F.lit(0.0))) * 10).cast("long")
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("scene"), F.to_date("ts").cast("string").alias("day"),
        tokens.alias("prompt"), k.alias("completion"), (tokens + k).alias("total"), F.least(k, tokens).alias("hit"), F.greatest(tokens - k, F.lit(0)).alias("miss"),
        (F.col("event_id") % 7 == 0).alias("estimated"), (F.col("event_type") != "error").alias("ok"),
    )


USAGE_LOG = """(SELECT event_id, ts, user_id, event_type AS scene, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, t AS prompt, k AS completion, t + k AS total, least(k, t) AS hit, greatest(t - k, 0) AS miss, event_id % 7 = 0 AS estimated, event_type <> 'error' AS ok
FROM (SELECT *, CAST(floor(abs(coalesce(value, 0)) * 10) AS BIGINT) AS t, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events))"""

BUCKET = """count(*) AS calls, sum(prompt)::BIGINT AS prompt_tokens, sum(completion)::BIGINT AS completion_tokens, sum(total)::BIGINT AS total_tokens, sum(hit)::BIGINT AS hit_tokens, sum(miss)::BIGINT AS miss_tokens,
sum(hit)::BIGINT / nullif(sum(hit)::BIGINT + sum(miss)::BIGINT, 0) AS hit_rate, count(*) FILTER (WHERE estimated) AS estimated_calls, count(*) FILTER (WHERE NOT ok) AS failed_calls"""
