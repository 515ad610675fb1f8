"""Streams: states of stations at instants that arrive, and the latest value of each key in a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import interpolate
from ..operators.segments import BUCKET_US, holds

def stream_snapshot(instants: DataFrame, static_segments: DataFrame, current: bool = True, bucket_us: int = BUCKET_US) -> DataFrame:
    """value and state at each (station_id, t_us) of a stream, from ``bucketed_segments``; instants outside the events give
    no row. Stateless."""
    asked = instants.withColumn("bucket", F.floor(F.col("t_us") / bucket_us).cast("long"))
    found = asked.join(static_segments, ["station_id", "bucket"]).where(holds())
    value, state = (interpolate.current_value(), interpolate.current_state()) if current else (interpolate.tide_value(), interpolate.tide_state())
    return found.select("station_id", "t_us", value.alias("value"), state.alias("state"))


def conflate(rows: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """The latest value (columns key, ts, value) of each key in each window; rows later than the watermark are dropped."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts")).select("key", F.col("window.start").alias("start"), "value", "ts")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write everything that has arrived to Parquet and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


