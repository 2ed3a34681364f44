"""Streams over observation and event tables; each has a batch twin among the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrack.operators.sessions import session_windows, windowed_counts


def read_events(spark, path: str, schema, late: str = "10 minutes", files_per_trigger: int = 8) -> DataFrame:
    """Event rows from a folder of Parquet files as they arrive, with a watermark on ``ts`` (read in the session time zone)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_windowed_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts (SS3); rows later than the watermark are dropped by Spark."""
    return windowed_counts(events, width, slide)


def stream_session_windows(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Session windows per track (SS3)."""
    return session_windows(events, gap)


def dedup_stream(events: DataFrame, key: list[str]) -> DataFrame:
    """Each natural key at most once within the watermark (SS9)."""
    return events.dropDuplicatesWithinWatermark(key)


def latest_per_source(batch: DataFrame) -> DataFrame:
    """(source_id, newest frame, dropped): the freshest frame of each source of a micro-batch (SS4); for ``foreachBatch``."""
    return batch.groupBy("source_id").agg(F.max(F.struct("stream_epoch", "frame_index", "timestamp_global")).alias("newest"), (F.count("*") - 1).alias("dropped")).select("source_id", "newest.*", "dropped")


def write_latest(frames: DataFrame, path: str, checkpoint: str):
    """Starts SS4: every micro-batch's freshest frames, one folder per batch id, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_source(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
