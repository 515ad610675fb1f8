"""Events from station documents and raw payloads, and the way back; picks and their catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import display_name, station_name
from ..functions.timeutil import CURRENT_WEEKDAYS, TIDE_WEEKDAYS, station_time_us, weekday_label

LOCAL_OFFSET, LOCAL_ZONE = -8, "PST"


def _exploded(documents: DataFrame, entries: str) -> DataFrame:
    days = documents.select("station_id", "year", "utc_offset", F.posexplode("days").alias("day_pos", "d"))
    rows = days.select("station_id", "year", "utc_offset", "day_pos", F.col("d.month").alias("month"), F.col("d.day").alias("day"), F.posexplode(f"d.{entries}").alias("pos", "e"))
    t = station_time_us(F.col("year"), F.col("month"), F.col("day"), F.col("e.time"), F.col("utc_offset"))
    return rows.withColumn("t_us", t).withColumn("ord", (F.col("day_pos") * 1_000_000 + F.col("pos")).cast("long"))


def tide_extremes(documents: DataFrame) -> DataFrame:
    return _exploded(documents, "readings").select("station_id", "year", "t_us", "ord", F.col("e.metres").alias("v"), F.lit(False).alias("weak"))


def current_extremes(documents: DataFrame) -> DataFrame:
    """Slacks and weak peaks are zero exactly; other peaks keep their sign."""
    weak = (F.col("e.kind") == "max") & F.coalesce(F.col("e.weak_variable"), F.lit(False))
    v = F.when((F.col("e.kind") == "slack") | weak, F.lit(0.0)).otherwise(F.col("e.knots"))
    return _exploded(documents, "events").select("station_id", "year", "t_us", "ord", v.alias("v"), weak.alias("weak"), F.col("e.kind").alias("kind"))


def _payload_rows(payloads: DataFrame, keys: list[str], entries: str) -> DataFrame:
    """A row an entry (p) with its place (pos) among all of its station: payloads of a station go by ``seq``, if they have it."""
    seq = F.col("seq") if "seq" in payloads.columns else F.lit(0)
    rows = payloads.select(*keys, seq.cast("long").alias("_seq"), F.posexplode(entries).alias("_pos", "p"))
    return rows.select(*keys, F.struct("_seq", "_pos").alias("pos"), "p")


def tide_rows(payloads: DataFrame) -> DataFrame:
    """id and its predictions (t ``YYYY-MM-DD HH:MM``, v text) as local date, clock and metres; an unreadable v is null."""
    rows = _payload_rows(payloads, ["id"], "predictions")
    at = F.split("p.t", " ")
    return rows.select("id", "pos", at[0].alias("date"), at[1].alias("time"), F.col("p.v").try_cast("double").alias("metres"), F.lit(LOCAL_OFFSET).alias("utc_offset"), F.lit(LOCAL_ZONE).alias("timezone"))


def current_rows(payloads: DataFrame) -> DataFrame:
    rows = _payload_rows(payloads, ["id", "bin"], "cp")
    at = F.split("p.Time", " ")
    slack = F.col("p.Type") == "slack"
    return rows.select(
        "id", "bin", "pos", at[0].alias("date"), at[1].alias("time"), F.when(slack, "slack").otherwise("max").alias("kind"),
        F.when(slack, F.lit(0.0)).otherwise(F.col("p.Velocity_Major")).alias("knots"), F.col("p.meanFloodDir").alias("flood_dir"), F.col("p.meanEbbDir").alias("ebb_dir"),
    )


def current_station(rows: DataFrame) -> DataFrame:
    """Largest flood and ebb (0 is none) and the directions of the first row that has a flood direction; without one, the
    last row's ebb direction."""
    speed = F.when(F.col("kind") == "max", F.col("knots"))
    first = F.min_by(F.struct("flood_dir", "ebb_dir"), F.when(F.col("flood_dir").isNotNull(), F.col("pos")))
    found = rows.groupBy("id", "bin").agg(
        F.nullif(F.max(F.when(speed > 0, speed)), F.lit(0.0)).alias("max_flood_knots"), F.nullif(F.max(F.when(speed < 0, -speed)), F.lit(0.0)).alias("max_ebb_knots"),
        first.alias("_d"), F.max_by("ebb_dir", "pos").alias("_last"), F.count_if(F.col("flood_dir").isNotNull()).alias("_n"),
    )
    return found.select("id", "bin", "max_flood_knots", "max_ebb_knots", F.when(F.col("_n") > 0, F.col("_d.flood_dir")).alias("flood_dir"), F.when(F.col("_n") > 0, F.col("_d.ebb_dir")).otherwise(F.col("_last")).alias("ebb_dir"))


def nest_days(rows: DataFrame, keys: list[str], fields: list[str], name: str = "readings") -> DataFrame:
    """One row for ``keys`` with the array of its days (date, weekday, entries in input order)."""
    labels = TIDE_WEEKDAYS if name == "readings" else CURRENT_WEEKDAYS
    days = rows.groupBy(*keys, "date").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("_e"))
    date = F.col("date").cast("date")
    entry = F.struct("date", F.month(date).alias("month"), F.day(date).alias("day"), weekday_label(date, labels).alias("weekday"), F.transform("_e", lambda x: x.dropFields("pos")).alias(name))
    return days.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("days"))


def first_per(rows: DataFrame, keys: list[str], order: Column | str = "pos") -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def tide_picks(picks: DataFrame) -> DataFrame:
    return first_per(picks, ["id"])


def current_picks(picks: DataFrame) -> DataFrame:
    return first_per(picks.where("id is not null"), ["id", "bin"])


def enrich(picks: DataFrame, catalog: DataFrame, last: bool, short: str | None = None) -> DataFrame:
    """Picks with the catalog's name, lat and lng: its last row of an id for tides, its first for currents. The
    catalog's name wins; an id that it lacks has no coordinates. ``display_name`` is the pick's own short name (column
    ``short``) where it has one, else the name without its offset, which ``station_name`` always is."""
    by = (F.max_by if last else F.min_by)(F.struct("name", "lat", "lng"), "pos")
    one = catalog.groupBy("id").agg(by.alias("_c"))
    rows = picks.join(one, "id", "left")
    name = F.coalesce(F.col("_c.name"), F.col("name"))
    return rows.select("id", *[c for c in picks.columns if c not in ("id", "name")], name.alias("name"), display_name(F.col(short) if short else F.lit(None).cast("string"), name).alias("display_name"), station_name(name).alias("station_name"), F.col("_c.lat").alias("lat"), F.col("_c.lng").alias("lng"))


def missing(picks: DataFrame, landed: DataFrame, keys: list[str], refresh: bool = False) -> DataFrame:
    """Picks to fetch: those without a payload, or all of them on a refresh."""
    work = picks.select(*keys).distinct()
    return work if refresh else work.join(landed, keys, "left_anti")


def summary(picks: DataFrame) -> DataFrame:
    return picks.groupBy("kind").agg(F.count_if(F.col("secondary")).alias("secondaries"), F.count_if(~F.col("secondary")).alias("primaries"))
