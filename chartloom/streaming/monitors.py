"""Mergeable aggregates over a stream of events: windowed counts and code frequencies with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENTS = StructType.fromDDL("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of event files; ``path`` may be a folder or one file."""
    place = path if any(c in path for c in "*[?") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(place).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_means(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts, means, maxima and sums by window and type; works on streams and tables alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "high", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take in what is there, to Parquet, and stop; call again to go on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
