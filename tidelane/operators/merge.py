"""Ids, metadata and series across years and kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Within a year a later kind overwrites an earlier one.
KIND_ORDER = ("tidal_primary", "tidal_secondary", "current_primary", "current_secondary", "noaa_tidal_primary", "noaa_current_primary")


def namespaced(source: str, *parts: Column) -> Column:
    """``source:id`` or ``source:id:bin``; a null part is left out."""
    return F.concat_ws(":", F.lit(source), *(p.cast("string") for p in parts))


def latest(meta: DataFrame, rank: Column) -> DataFrame:
    """The row of the latest year, and within it of the highest rank, of each station_id."""
    rest = [c for c in meta.columns if c != "station_id"]
    best = F.max_by(F.struct(*rest), F.struct("year", rank, *([F.col("pos")] if "pos" in rest else [])))
    return meta.groupBy("station_id").agg(best.alias("_m")).select("station_id", "_m.*")


def merged(*series: DataFrame) -> DataFrame:
    """All series together; equal events stay. Order is (t_us, year, ord) in every later window."""
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def extreme_ranges(events: DataFrame) -> DataFrame:
    """First and last instant by (year, kind), by year and over all, in one pass."""
    return events.rollup("year", "kind").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count("*").alias("events"))
