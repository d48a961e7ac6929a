"""The periodic refresh as a stream of ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def start_refresh(spark: SparkSession, tick: Callable[[], None], seconds: int = 2, checkpoint: str | None = None) -> StreamingQuery:
    """Run a batch refresh every few seconds, one at a time; a slow one delays the next. tick selects stale rows, fetches and writes."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(lambda _, __: tick())
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
