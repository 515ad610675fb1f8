"""What is published: pruned documents, fingerprints, and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields kept of a station and of its days, by kind (fixed values); other kinds pass through.
STATION_FIELDS = {
    "tidal_primary": ("name", "index_no", "year", "utc_offset", "latitude", "longitude", "higher_high_water_mean_tide", "higher_high_water_large_tide", "lower_low_water_mean_tide", "lower_low_water_large_tide", "days"),
    "tidal_secondary": ("name", "index_no", "latitude", "longitude", "reference_port", "higher_high_water_time_diff", "higher_high_water_mean_tide_diff", "higher_high_water_large_tide_diff", "lower_low_water_time_diff", "lower_low_water_mean_tide_diff", "lower_low_water_large_tide_diff"),
    "current_primary": ("name", "index_no", "year", "utc_offset", "latitude", "longitude", "flood_direction_true", "ebb_direction_true", "max_flood_knots", "max_ebb_knots", "days"),
    "current_secondary": ("name", "index_no", "latitude", "longitude", "reference_primary", "offsets_from_tides", "flood_direction_true", "turn_to_flood_diff", "turn_to_ebb_diff", "flood_max_diff", "ebb_max_diff", "pct_ref_flood", "pct_ref_ebb", "max_flood_knots", "max_ebb_knots"),
    "noaa_tidal_primary": ("name", "NOAA_station_name", "utc_offset", "year", "noaa_id", "latitude", "longitude", "US_secondary", "days"),
    "noaa_current_primary": ("name", "NOAA_station_name", "utc_offset", "year", "flood_direction_true", "ebb_direction_true", "noaa_id", "noaa_bin", "latitude", "longitude", "max_flood_knots", "max_ebb_knots", "US_secondary", "days"),
}
DAY_FIELDS = {
    "tidal_primary": ("month", "day", "readings"),
    "current_primary": ("month", "day", "events"),
    "noaa_tidal_primary": ("month", "day", "readings"),
    "noaa_current_primary": ("month", "day", "events"),
}


def strip(documents: DataFrame, kind: str) -> DataFrame:
    """The fields of ``kind`` alone; of events, ``weak_variable`` only where it is true."""
    if kind not in STATION_FIELDS:
        return documents
    out = documents.select(*[c for c in documents.columns if c in STATION_FIELDS[kind] or c == "station_id"])
    if "days" not in out.columns:
        return out
    inner = out.schema["days"].dataType.elementType
    kept = [f for f in inner.fieldNames() if f in DAY_FIELDS.get(kind, inner.fieldNames())]

    def event(e):
        return e.withField("weak_variable", F.when(e["weak_variable"], F.lit(True)))

    def day(d):
        has_weak = "events" in kept and "weak_variable" in inner["events"].dataType.elementType.fieldNames()
        return F.struct(*[(F.transform(d[f], event) if f == "events" and has_weak else d[f]).alias(f) for f in kept])

    return out.withColumn("days", F.transform("days", day))


def fingerprint(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Eight hex digits for each group of ``keys``, whatever the order of rows; repeats of a row count.

    Rows are hashed where they lie, and four 32-bit pieces of their hashes are summed: sums are made in each task before
    anything moves and take a few bytes a group, however large the group is."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    hashed = rows.select(*keys, F.sha2(F.concat_ws("|", *map(cell, columns)), 256).alias("h"))
    pieces = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    mark = F.concat_ws(",", F.count("*").cast("string"), *pieces)
    return hashed.groupBy(*keys).agg(F.substring(F.sha2(mark, 256), 1, 8).alias("fingerprint"))


def manifest(published: DataFrame, ranges: DataFrame, kinds: list[str]) -> DataFrame:
    """A row a year, ascending: the path of each kind, and the first and last instant. ``published``: year, kind, path."""
    paths = published.groupBy("year").pivot("kind", kinds).agg(F.first("path"))
    return paths.join(ranges, "year", "left").orderBy("year")
