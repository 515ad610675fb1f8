"""Segments and stations as stored tables that later reads find their way in: by bucket for lookups, by tile for boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import BUCKET_US, SEGMENT, bucketed_segments, holds

BUCKETS = 64
TILE_DEG = 0.5


def store_segments(events: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS, bucket_us: int = BUCKET_US, key: str = "station_id") -> None:
    """Write the segments of ``events`` as a table whose files are buckets of station and time bucket (a day), one file each.

    A busy station lies in as many buckets as it has days. Take more buckets for more data: one is read by one task."""
    rows = bucketed_segments(events, bucket_us, key).repartition(buckets, key, "bucket")
    writer = rows.write.format("parquet").mode("overwrite").bucketBy(buckets, key, "bucket").sortBy(key, "bucket", "t1")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def as_of_stored(spark: SparkSession, table: str, instants: DataFrame, bucket_us: int = BUCKET_US, key: str = "station_id") -> DataFrame:
    """The same as ``segments.as_of`` from a stored table: the instants go to the buckets, the segments stay where they are.

    The instants of a bucket are hashed and the segments run past them, so nothing is sorted either."""
    extra = [c for c in instants.columns if c != key]
    asked = instants.select(F.col(key).alias("_key"), F.floor(F.col("t_us") / bucket_us).cast("long").alias("_bucket"), *extra).hint("shuffle_hash")
    seg = spark.table(table)
    found = asked.join(seg, (F.col("_key") == F.col(key)) & (F.col("_bucket") == F.col("bucket")) & holds(), "left")
    return found.select(F.col("_key").alias(key), *extra, *SEGMENT)


# Tiles: squares of some degrees, numbered along the parallels from the south-west


def tile(lat: Column, lon: Column, degrees: float = TILE_DEG) -> Column:
    """The tile of a place; null without coordinates."""
    across = math.ceil(360 / degrees)
    row = F.floor((lat + 90) / degrees)
    return (row * across + F.floor(F.pmod(lon + 180, F.lit(360.0)) / degrees)).cast("long")


def _parts(box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """Ranges of longitude of a box (south, north, west, east), two where it goes over the date line."""
    _, _, west, east = box
    return [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]


def tile_ranges(box: tuple[float, float, float, float], degrees: float = TILE_DEG) -> list[tuple[int, int]]:
    """First and last tile of each row of tiles that a box touches."""
    south, north, _, _ = box
    across = math.ceil(360 / degrees)
    column = lambda lon: min(math.floor((lon + 180) / degrees), across - 1)
    out = []
    for row in range(math.floor((south + 90) / degrees), math.floor((north + 90) / degrees) + 1):
        for west, east in _parts(box):
            out.append((row * across + column(west), row * across + column(east)))
            if west <= -180.0 < 180.0 <= east or east == 180.0:
                out.append((row * across, row * across))  # the date line itself is in the first column
    return out


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a place is in a box (south, north, west, east), edges included; west of its west side is over the date line."""
    south, north, west, east = box
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def store_by_tile(rows: DataFrame, path: str, degrees: float = TILE_DEG) -> None:
    """Write rows that have lat and lon in a folder for each tile; rows without a place are in one of their own."""
    tiled = rows.withColumn("tile", tile(F.col("lat"), F.col("lon"), degrees))
    tiled.repartition("tile", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("overwrite").partitionBy("tile").parquet(path)  # up to 8 files a tile


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], degrees: float = TILE_DEG) -> DataFrame:
    """Rows of a stored table in a box; files of tiles that it does not touch are not opened."""
    touched = F.lit(False)
    for first, last in tile_ranges(box, degrees):
        touched = touched | F.col("tile").between(first, last)
    return spark.read.parquet(path).where(touched & in_box(F.col("lat"), F.col("lon"), box)).drop("tile")
