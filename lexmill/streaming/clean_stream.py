"""Streaming forms: cleaning with keep-first inside a watermark, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import normalize
from ..operators.clean import CleanOptions, reject_reason


def clean_stream(docs: DataFrame, options: CleanOptions = CleanOptions(), time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Accepted texts of a stream; of equal texts within `delay` of each other, the first to arrive stays. State is bounded by the watermark."""
    read = docs.filter(F.col("text").isNotNull()).withColumn("text", normalize("text")).withColumn("reason_", reject_reason("text", options))
    kept = read.filter("reason_ IS NULL").drop("reason_").withColumn("digest", F.sha2("text", 256))
    return kept.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"]) if options.dedupe else kept


def event_windows(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Number and sum of events by tumbling window and type; also runs on a table."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, delay) if events.isStreaming else timed
    counted = timed.groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n_events", "total")
