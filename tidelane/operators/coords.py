"""Coordinates of stations from several sources: precedence, flags, and the sync of seeded overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from .derive import broadcast_if_small
from .override_file import SEEDED

MIN_DECIMALS, NEAR_M, GROSS_M = 3, 2000.0, 5000.0


def suppress(stations: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Without the suppressed numbers; a station without a number stays."""
    return stations.join(broadcast_if_small(suppressed), "index_no", "left_anti")


def resolve(stations: DataFrame, inventory: DataFrame, overrides: DataFrame) -> DataFrame:
    """lat and lon by precedence, with coord_source (override, verified, csv, kept), offset_m and flagged.

    An override replaces the coordinates, or with null says that they are right. The inventory does so if it is precise
    and near; if it is precise but not near, or far off at any precision, the station keeps its own and is flagged."""
    over = overrides.select("index_no", F.col("lat").alias("_olat"), F.col("lon").alias("_olon"), F.lit(True).alias("_o"))
    inv = inventory.select("index_no", F.col("lat").alias("_clat"), F.col("lon").alias("_clon"), F.col("decimals").alias("_dec"))
    rows = stations.join(broadcast_if_small(over), "index_no", "left").join(broadcast_if_small(inv), "index_no", "left")
    whole = F.col("index_no").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    offset = haversine_m(F.col("lat"), F.col("lon"), F.col("_clat"), F.col("_clon"))
    precise = F.col("_dec") >= MIN_DECIMALS
    source = (
        F.when(~whole, "kept").when(F.col("_o") & F.col("_olat").isNotNull(), "override").when(F.col("_o"), "verified")
        .when(precise & (offset <= NEAR_M), "csv").otherwise("kept")
    )
    flagged = whole & F.col("_o").isNull() & ((precise & (offset > NEAR_M)) | (offset > GROSS_M))
    rows = rows.withColumn("coord_source", source).withColumn("flagged", F.coalesce(flagged, F.lit(False))).withColumn("offset_m", F.when(whole & F.col("_o").isNull(), offset))
    pick = lambda c: F.when(F.col("coord_source") == "override", F.col(f"_o{c}")).when(F.col("coord_source") == "csv", F.col(f"_c{c}")).otherwise(F.col(c))
    return rows.withColumn("_lat", pick("lat")).withColumn("_lon", pick("lon")).drop("lat", "lon", "_olat", "_olon", "_clat", "_clon", "_o").withColumnsRenamed({"_lat": "lat", "_lon": "lon", "_dec": "decimals"})


def flags(resolved: DataFrame) -> DataFrame:
    return resolved.where("flagged").orderBy(F.desc("offset_m"), "index_no")


def outcome_counts(resolved: DataFrame, before: DataFrame) -> DataFrame:
    """Outcomes by kind and over all (kind null); ``before`` has the stations before suppression."""
    kept = resolved.select("kind", "coord_source")
    counts = kept.rollup("kind").agg(F.count("*").alias("stations"), F.count_if(F.col("coord_source") == "override").alias("overridden"), F.count_if(F.col("coord_source") == "csv").alias("csv"), F.count_if(F.col("coord_source").isin("kept", "verified")).alias("kept"))
    all_ = before.rollup("kind").agg(F.count("*").alias("_all")).withColumnRenamed("kind", "_kind")
    return counts.join(all_, F.col("kind").eqNullSafe(F.col("_kind"))).withColumn("suppressed", F.col("_all") - F.col("stations")).drop("_all", "_kind")


def sync(roster: DataFrame, upstream: DataFrame, current: DataFrame) -> DataFrame:
    """What a re-seeding does to every station or seeded override: index_no, action, and the value it has then.

    ``current`` has index_no, lat, lon and block, as ``override_file.provenance`` gives them: those seeded from the upstream
    listing (``SEEDED``) follow it, all others stay as they are. One row a number, however many kinds list it."""
    own = roster.where("index_no is not null and lat is not null and lon is not null").select("index_no").distinct().withColumn("_r", F.lit(True))
    up = upstream.select("index_no", F.round("lat", 6).alias("_ulat"), F.round("lon", 6).alias("_ulon"), F.lit(True).alias("_u"))
    rows = own.join(current, "index_no", "full_outer").join(up, "index_no", "left")
    seeded, by_hand = F.col("block") == SEEDED, F.col("block").isNotNull() & (F.col("block") != SEEDED)
    same = (F.col("lat") == F.col("_ulat")) & (F.col("lon") == F.col("_ulon"))
    action = (
        F.when(F.col("_r").isNull(), F.when(seeded, "removed_no_station"))
        .when(by_hand, "skipped_manual")
        .when(F.col("_u").isNull(), F.when(seeded, "removed_no_source").otherwise("no_action"))
        .when(seeded, F.when(same, "no_change").otherwise("refreshed")).otherwise("added")
    )
    new = F.col("action").isin("added", "refreshed")
    keep = F.col("action").isin("no_change", "skipped_manual")
    value = lambda c: F.when(new, F.col(f"_u{c}")).when(keep, F.col(c))
    return rows.withColumn("action", action).where("action is not null").select("index_no", "action", value("lat").alias("lat"), value("lon").alias("lon"))


def upstream_stations(listing: DataFrame) -> DataFrame:
    """Numeric codes with coordinates."""
    return listing.where(F.col("code").rlike(r"^\d+$") & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("code").cast("int").alias("index_no"), "lat", "lon")
