"""Streams of chunks to files and to several consumers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .markers import CONTROL


def logged(chunks: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends chunks but control tokens to Parquet; a micro-batch is the buffer, committed whole or not at all."""
    out = chunks.where(~F.col("chunk").isin(*CONTROL)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def fanned_out(chunks: DataFrame, consumers: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Each micro-batch to every consumer; a slow one holds the stream back and loses nothing."""

    def deliver(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for consumer in consumers:
            consumer(held, number)
        held.unpersist()

    return chunks.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush_windows(events: DataFrame, interval: str, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """(window_start, n): how many rows fall into each flush interval of event time."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, interval)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")
