"""Incremental indexing and sessions on Structured Streaming."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from confab.operators import index


def index_stream(chunks: DataFrame, folder: str, checkpoint: str, analyzer: str = "simple") -> StreamingQuery:
    """Adds each micro-batch's postings and counts under its number; running a batch again replaces its own files, so counts
    stay exact. Readers merge the deltas with `stream_counts`."""

    def add(batch: DataFrame, number: int) -> None:
        posted = index.postings(batch.dropDuplicates(["id"]), analyzer).persist()
        posted.write.mode("overwrite").parquet(os.path.join(folder, "postings", f"batch={number}"))
        index.delta(posted, 1).write.mode("overwrite").parquet(os.path.join(folder, "deltas", f"batch={number}"))
        posted.unpersist()

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(lexeme, df) after all batches."""
    return index.merge_counts(spark.read.parquet(os.path.join(folder, "deltas")))


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, from_ts, to_ts, n, value) of sessions; on a stream a session is emitted once the watermark has passed it.
    Partial sessions are merged before they are shuffled where the session setting for that is on."""
    timed = with_event_time(events)
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select("user_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n", "value")


def sliding_counts(events: DataFrame, size: str = "1 hour", hop: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(from_ts, event_type, n) in sliding windows."""
    timed = with_event_time(events)
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size, hop).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("from_ts"), "event_type", "n")
