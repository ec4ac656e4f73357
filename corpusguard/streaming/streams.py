"""Streams of documents and events.

These go beyond batch use: new files are scanned as they arrive, findings are
merged per batch before the source's progress is recorded, and events are counted
by window with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``(start, end, event_type, n, total)`` by event time; later events than the
    watermark allows are dropped by design of the window."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def scan_stream(docs: DataFrame, detect: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Findings of each batch are written before the batch counts as done, so a batch
    that is lost is scanned again. ``write`` gets the findings and the batch number,
    and must replace what an earlier try of that number wrote."""
    query = docs.writeStream.foreachBatch(lambda batch, number: write(detect(batch), number)).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="1 minute")).start()
