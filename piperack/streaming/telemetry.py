"""Decisions as a stream: windowed counts with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, by, n, total of tumbling windows; works on a stream and on a table."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a zoned timestamp
    if timed.isStreaming:
        timed = timed.withWatermark(time, late)
    sums = timed.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), by, "n", "total")


def run(events: DataFrame, sink: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends finished windows of all rows there are to Parquet at ``sink``, then stops; it goes on where it ended."""
    return windowed(events, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink)
