"""Streams: rate limits with a watermark, and files taken up as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithograph.operators.reports import rate_breaches


def rate_limit_stream(events: DataFrame, limit: int, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Breaches of a stream of (user_id, ts); the state of a window is dropped once the watermark has passed it."""
    return rate_breaches(events.withWatermark("ts", late), limit, window)


def ingest_new(spark: SparkSession, source: str, schema, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Runs handle once on each batch of Parquet files that no earlier call has taken up, then ends."""
    rows = spark.readStream.schema(schema).parquet(source)
    query = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
