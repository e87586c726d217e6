"""Structured Streaming: event-time windows, sessions and incremental baselines; all work on batches too."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodeflow.operators.baselines import upsert


def tumbling(events: DataFrame, ts: str, by: str, width: str, late: str | None = None) -> DataFrame:
    """window_start, by, n, total per tumbling window; with ``late`` a watermark drops later rows of a stream."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str | None = None) -> DataFrame:
    """by, session_start, last_event, n: rows of a key that follow each other within the gap."""
    e = events.withWatermark(ts, late) if late else events
    grouped = e.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"), F.max(ts).alias("last_event"))
    return grouped.select(by, F.col("w.start").alias("session_start"), "last_event", "n")


def keep_baseline(findings: DataFrame, path: str, checkpoint: str):
    """Start a stream that takes findings (fingerprint, seen) into a baseline kept under ``path``.

    Each batch writes a new version of the table, so a repeated batch gives the same result:
    ``path/v<batch>`` is derived from the version before it only.
    """

    def take_in(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "fingerprint string, first_seen timestamp, last_seen timestamp, status string"
        old = spark.read.schema(schema).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], schema)
        upsert(old, batch).write.mode("overwrite").parquet(f"{path}/v{number}")

    return findings.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
