"""Incremental ingest: the per-document operators over arriving pages, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.corpus import html_blocks, paragraphs


def stream_pages(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def new_pages(pages: DataFrame, time: str = "fetched_at", delay: str = "1 day") -> DataFrame:
    """Each address once within the watermark, however often it arrives."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def ingest(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Blocks and paragraphs of each batch of pages to sink(paragraphs, batch id)."""

    def batch(df: DataFrame, number: int) -> None:
        sink(paragraphs(html_blocks(df).where("href is null").drop("href")), number)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """(hour, event_type, n) by event time; later events than the delay are left out in a stream."""
    base = events.withColumn("at", F.col("ts").cast("timestamp"))
    base = base.withWatermark("at", delay) if events.isStreaming else base
    return base.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
