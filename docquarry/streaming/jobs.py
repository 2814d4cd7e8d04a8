"""Structured Streaming jobs: ingestion, replay protection, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unix_lines


def ingest(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True):
    """Feed new text files below ``folder`` to ``sink``, a foreachBatch function. The checkpoint
    makes a restart go on where the last batch ended; a sink that upserts by key is then
    exact. ``once`` takes what is there and stops; else the folder is polled each second."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    docs = files.select(F.col("_metadata.file_path").alias("path"), unix_lines(F.col("value")).alias("text"))
    writer = docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def without_replays(events: DataFrame, keys: list[str], ts: str = "ts", skew: str = "5 minutes") -> DataFrame:
    """Events whose key did not come before within the clock skew; later ones are late."""
    return events.withWatermark(ts, skew).dropDuplicatesWithinWatermark(keys)


def failures_per_minute(events: DataFrame, key: str, ts: str = "ts", slide: str = "10 seconds", most: int = 5, late: str = "5 minutes") -> DataFrame:
    """Sliding one-minute windows in which a key has at least ``most`` failures."""
    w = F.window(ts, "60 seconds", slide)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("failures")).where(F.col("failures") >= most)


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """Sessions that a pause of ``gap`` ends."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events"))
