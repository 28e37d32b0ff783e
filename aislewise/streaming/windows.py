"""Event streams: windowed totals with late data, first deliveries, and sessions. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, time: str, window: str, late: str, kind: str, value: str) -> DataFrame:
    """(window_start, kind, n, total): tumbling windows; a row later than `late` behind the newest one is dropped in a stream.

    `time` is a timestamp with or without a zone; rows where it is NULL are in no window.
    """
    stamped = events.where(F.col(time).isNotNull()).select(F.col(time).cast("timestamp").alias("__t"), F.col(kind).alias("kind"), F.col(value).alias("__v"))
    grouped = stamped.withWatermark("__t", late).groupBy(F.window("__t", window), "kind")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__v").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("window.start").alias("window_start"), "kind", "n", "total")


def first_deliveries(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once within the watermark; state for older keys is dropped."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.dropDuplicatesWithinWatermark([key]) if events.isStreaming else stamped.dropDuplicates([key])


def sessions(events: DataFrame, who: str, time: str, gap: str, late: str) -> DataFrame:
    """(who, session_start, session_end, n): runs of events with no gap of `gap` or more."""
    stamped = events.where(F.col(time).isNotNull()).select(F.col(who), F.col(time).cast("timestamp").alias("__t"))
    grouped = stamped.withWatermark("__t", late).groupBy(F.session_window("__t", gap), who)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(who, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now into Parquet and return the table; the checkpoint lets a later call go on."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
