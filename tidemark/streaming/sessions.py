"""Event streams: sessions closed by a watermark, and a keyed table of the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_sessions(events: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """(key, start, end, n) of sessions whose gap has passed the watermark; end is the last event plus the gap."""
    w = events.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each event once, as long as its repeat comes within the delay; state older than that is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all there is now, into Parquet files with a checkpoint (a restart goes on after the last commit), and read them."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
