"""Event-time windows, sessions and micro-batch upserts of event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators import upsert


def windowed(events: DataFrame, width: str, keys: list[str], measures: list[Column], late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Measures for each window of event time and keys; a stream forgets windows that are `late` behind."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.window(at, width), *keys).agg(*measures)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Sessions of a key's events with at most `gap` between them: key, start, end (last event plus gap), n."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def settled(cuts: DataFrame, horizon: Column, margin: int) -> DataFrame:
    """Intervals (lo, hi) that can't change any more once all places up to the horizon are known."""
    return cuts.where(F.col("hi") <= horizon - margin)


def upserted(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps the last row for each key under `path`: each micro-batch writes a new version, the newest number is current.

    A batch that is run again writes the same version again, so restarts neither lose nor double rows. A version is
    deleted when the second after it is written. Each batch rewrites the table: meant for tables of current states, not
    for logs.
    """

    def write(batch: DataFrame, number: int) -> None:
        if number:
            batch = upsert.upsert(batch.sparkSession.read.parquet(f"{path}/v{number - 1}"), batch, keys, order)
        else:
            batch = upsert.upsert(batch.limit(0), batch, keys, order)
        batch.write.mode("overwrite").parquet(f"{path}/v{number}")
        old = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
        old.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def frames(lines: DataFrame, key: str, line: str) -> DataFrame:
    """Parsed server-sent data lines: key, kind (thinking, content, done), text. Other lines and bad JSON are left out."""
    data = F.trim(F.regexp_extract(line, r"^data:(.*)$", 1))
    delta = F.coalesce(F.get_json_object(data, "$.choices[0].delta"), F.lit("{}"))
    thinking, content = F.get_json_object(delta, "$.reasoning_content"), F.get_json_object(delta, "$.content")
    kind = F.when(data == "[DONE]", "done").when(F.coalesce(thinking, F.lit("")) != "", "thinking").when(F.coalesce(content, F.lit("")) != "", "content")
    return lines.select(key, kind.alias("kind"), F.coalesce(F.nullif(thinking, F.lit("")), content, F.lit("")).alias("text")).where("kind is not null")
