"""Catalogs of stations: regions, keyword matches, drift against recorded picks, movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from . import keywords
from .normalise import first_per

BOX = (45.5, 49.0, -125.0, -121.5)
MOVED_KM = 0.1


def tide_region(catalog: DataFrame, state: str = "WA") -> DataFrame:
    return catalog.where(F.col("state") == state)


def current_region(catalog: DataFrame, box: tuple = BOX) -> DataFrame:
    return catalog.where(F.col("lat").between(box[0], box[1]) & F.col("lng").between(box[2], box[3]))


def region_counts(catalog: DataFrame, region: DataFrame) -> DataFrame:
    return region.agg(F.count("*").alias("region_rows"), F.countDistinct("id").alias("ids")).crossJoin(F.broadcast(catalog.agg(F.count("*").alias("total"))))  # one row each


def one_per_id(catalog: DataFrame, last: bool) -> DataFrame:
    """First or last row of each id, with all its bins and depths in order."""
    rest = [c for c in catalog.columns if c not in ("id", "pos", "currbin", "depth")]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), "pos")
    extra = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("currbin", "bins"), ("depth", "depths")) if c in catalog.columns]
    return catalog.groupBy("id").agg(pick.alias("_c"), *extra).select("id", "_c.*", *(n for c, n in (("currbin", "bins"), ("depth", "depths")) if c in catalog.columns))


def keyword_match(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """Each label's stations: of every group of keywords at least one is in the lower-case name. Labels without a match
    have a null id. Names are matched once each (``keywords.matches``)."""
    found = catalog.join(keywords.matches(catalog.select("name"), rules), "name")
    return rules.select("label").join(found, "label", "left")


def names_match(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def _anomalies(rows: DataFrame, *found: tuple[str, Column, Column, Column]) -> DataFrame:
    items = F.array(*(F.when(test, F.struct(F.lit(kind).alias("kind"), old.cast("string").alias("recorded"), new.cast("string").alias("live"))) for kind, test, old, new in found))
    return rows.withColumn("_a", F.explode(F.filter(items, lambda x: x.isNotNull()))).select("id", "placename", "_a.*")


def _differ(a: str, b: str) -> Column:
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return filled(a) & filled(b) & (F.col(a) != F.col(b))


def _live(picks: DataFrame, live: DataFrame, direct: DataFrame | None) -> DataFrame:
    live = live.select("id", F.struct(*[c for c in live.columns if c != "id"]).alias("_live"))
    rows = picks.join(live, "id", "left")
    if direct is not None:  # ids that the bulk catalog lacks but a direct lookup has
        rows = rows.join(direct.select("id", F.struct(*[c for c in direct.columns if c != "id"]).alias("_direct")), "id", "left").withColumn("_live", F.coalesce("_live", "_direct")).drop("_direct")
    return rows


def tide_drift(picks: DataFrame, catalog: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Missing, renamed, re-referenced and retyped stations among the first pick of each id."""
    rows = _live(first_per(picks, ["id"]), one_per_id(catalog, last=True), direct)
    here = F.col("_live").isNotNull()
    rows = rows.withColumns({"_name": F.col("_live.name"), "_ref": F.col("_live.reference_id"), "_type": F.col("_live.type")})
    return _anomalies(
        rows, ("missing", ~here, F.col("name"), F.lit(None)), ("name_change", here & ~names_match(F.col("name"), F.col("_name")), F.col("name"), F.col("_name")),
        ("reference_change", here & _differ("reference_id", "_ref"), F.col("reference_id"), F.col("_ref")), ("type_change", here & _differ("type", "_type"), F.col("type"), F.col("_type")),
    )


def current_drift(picks: DataFrame, catalog: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """The same for current picks, each of them: missing, renamed, bin no longer offered, retyped."""
    rows = _live(picks.where("id is not null"), one_per_id(catalog, last=False), direct)
    here = F.col("_live").isNotNull()
    rows = rows.withColumns({"_name": F.col("_live.name"), "_type": F.col("_live.type"), "_bins": F.col("_live.bins")})
    gone = here & F.col("bin").isNotNull() & ~F.array_contains("_bins", F.col("bin"))
    return _anomalies(
        rows, ("missing", ~here, F.col("name"), F.lit(None)), ("name_change", here & ~names_match(F.col("name"), F.col("_name")), F.col("name"), F.col("_name")),
        ("bin_missing", gone, F.col("bin"), F.array_join(F.transform("_bins", lambda x: x.cast("string")), ",")), ("type_change", here & _differ("type", "_type"), F.col("type"), F.col("_type")),
    )


def moved(before: DataFrame, after: DataFrame, limit_km: float = MOVED_KM) -> DataFrame:
    """Stations of two snapshots (id, lat, lng) whose places differ by more than ``limit_km``."""
    b = after.select("id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    km = haversine_m(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")) / 1000
    return before.join(b, "id").withColumn("moved_km", km).where(F.col("moved_km") > limit_km).select("id", "moved_km")


def gate(anomalies: DataFrame, force: bool = False) -> int:
    """Number of anomalies; raises if there are any, unless forced."""
    n = anomalies.count()
    if n and not force:
        raise RuntimeError(f"{n} catalog anomalies; run again with force to go on")
    return n
