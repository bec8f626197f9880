"""Windows, sessions and incremental streams over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events per type and tumbling (or sliding) window; late: how long a stream waits for late rows."""
    timed = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Per user, runs of events less than gap apart."""
    timed = events.withWatermark("ts", late) if late else events
    s = F.session_window("ts", gap)
    return timed.groupBy(s.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def available_now(spark: SparkSession, path: str, schema, transform, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Reads what is new under path since the last run, transforms it and appends it to a Parquet sink, exactly once."""
    stream = transform(spark.readStream.schema(schema).parquet(path))
    stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
