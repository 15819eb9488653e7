"""Documents and events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scored_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch operator on each micro-batch; ``sink(df, batch_id)`` must be idempotent by batch id."""
    return stream.writeStream.foreachBatch(lambda df, i: sink(score(df), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """Count and sum of ``value`` by window and keys; with a watermark on a stream."""
    if late is not None:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")
