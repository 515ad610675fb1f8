"""The manifest of a folder of published station files: ``<year>/<stem>.<8 hex digits>.json``.

Names come from a listing with no content read; instants from the files' stations, which are read in many tasks. A name may
also be that of a folder that Spark wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import station_time_us
from ..operators.publish import STATION_FIELDS, manifest
from .readers import station_records

STEMS = tuple(STATION_FIELDS)
NAME = r"/(?:year=)?(\d+)/((?:name=)?([a-z_]+)\.[0-9a-f]{8}\.json)(?:/part-[^/]*)?$"
DATED = "year int, utc_offset int, days array<struct<month:int,day:int,readings:array<struct<time:string>>,events:array<struct<time:string>>>>"


def _named(rows: DataFrame, path: Column) -> DataFrame:
    """``rows`` of files with such a name and a known stem, with folder_year, stem and name."""
    part = lambda i: F.regexp_extract(path, NAME, i)
    return rows.withColumns({"folder_year": part(1).try_cast("int"), "name": part(2), "stem": part(3)}).where(F.col("folder_year").isNotNull() & F.col("stem").isin(*STEMS))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """year, kind and path (from the folder on) of the published files: of a kind the last by name. Other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    found = _named(files, F.col("path")).select(F.col("folder_year").alias("year"), F.col("stem").alias("kind"), "name")
    name = F.max(F.regexp_replace("name", "^name=", ""))
    return found.groupBy("year", "kind").agg(F.concat(F.col("year").cast("string"), F.lit("/"), name).alias("path"))


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """year, first_us and last_us: the first and last instant in each year's published files; stations without a year or an
    offset have none."""
    rows = _named(station_records(spark, f"{path}/*/*", DATED).where("reason is null"), F.col("file"))
    days = rows.select("folder_year", "station.year", "station.utc_offset", F.explode("station.days").alias("d"))
    entries = F.when(F.size("d.readings") > 0, F.col("d.readings")).otherwise(F.col("d.events"))
    times = days.select("folder_year", "year", "utc_offset", "d.month", "d.day", F.explode(entries).alias("e"))
    t = station_time_us(F.col("year"), F.col("month"), F.col("day"), F.col("e.time"), F.col("utc_offset"))
    return times.groupBy(F.col("folder_year").alias("year")).agg(F.min(t).alias("first_us"), F.max(t).alias("last_us"))


def folder_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row a year, ascending: the path of each kind, and the first and last instant as ISO text."""
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    found = ranges(spark, path).select("year", iso(F.col("first_us")).alias("first_extreme_utc"), iso(F.col("last_us")).alias("last_extreme_utc"))
    return manifest(listing(spark, path), found, list(STEMS))
