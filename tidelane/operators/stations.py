"""Rules on the station dimension: what can be shown, and the full scale of service stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIDE_ZOOM, CURRENT_ZOOM, MARGIN_M = 9, 8, 0.3


def split_located(stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations with both coordinates, and the others, to be reported."""
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return stations.where(located), stations.where(~located)


def is_secondary(kind: Column, us_secondary: Column) -> Column:
    """Drawn as a secondary: by kind, or marked so by the service."""
    return F.coalesce(F.endswith(kind, F.lit("-secondary")) | us_secondary, us_secondary, F.endswith(kind, F.lit("-secondary")), F.lit(False))


def visible(stations: DataFrame, zoom: float) -> DataFrame:
    """Stations shown at a zoom: secondaries only from a level on that depends on tide or current."""
    least = F.when(F.startswith("kind", F.lit("tide")), TIDE_ZOOM).otherwise(CURRENT_ZOOM)
    return stations.where(~is_secondary(F.col("kind"), F.col("us_secondary")) | (F.lit(zoom) >= least))


def service_tide_bounds(events: DataFrame) -> DataFrame:
    """A year's highest and lowest value of each station with a margin, since the service gives no heights of its own."""
    return events.groupBy("station_id", "year").agg((F.max("v") + MARGIN_M).alias("high_m"), (F.min("v") - MARGIN_M).alias("low_m"))


def service_current_bound(max_flood: Column, max_ebb: Column) -> Column:
    """The larger of both speeds; none where both are absent or zero."""
    return F.nullif(F.greatest(F.abs(F.coalesce(max_flood, F.lit(0.0))), F.abs(F.coalesce(max_ebb, F.lit(0.0)))), F.lit(0.0))
