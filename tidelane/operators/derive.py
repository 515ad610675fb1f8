"""Secondary stations from the events of the reference stations that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import MINUTE_US, signed_minutes
from .classify import MAX_EBB, MAX_FLOOD, TO_EBB, TO_FLOOD

SUFFIXES = ("HARBOUR", "HARBOR", "INLET", "BAY")
#: Names of references that their own tables spell otherwise (fixed values).
CURRENT_ALIASES = {"JOHNSTONE STRAIT-CENTRAL": "JOHNSTONE STR. CEN."}
BROADCAST_STATIONS, BROADCAST_BYTES = 200_000, 64 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_STATIONS) -> DataFrame:
    """Hint a broadcast of a station table of at most ``limit`` rows and ``BROADCAST_BYTES`` (by the width of its columns; 64
    bytes a text); a larger one joins by shuffle, which takes a hint too: else Spark may broadcast the events, and the few tasks that
    read the stations derive everything. Counts up to that many rows."""
    width = sum(64 if f.dataType.simpleString() == "string" else 16 for f in df.schema.fields)
    most = min(limit, BROADCAST_BYTES // width)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def suffix_alias(name: Column) -> Column:
    """The name without a last word for a harbour, inlet or bay; null if it has none."""
    short = F.regexp_replace(name, rf"\s+(?:{'|'.join(SUFFIXES)})$", "")
    return F.when(short != name, short)


def reference_names(primaries: DataFrame) -> DataFrame:
    """(year, ref_name, ref_id): exact names win over aliases, the last of equal names and the first of aliases."""
    exact = primaries.select("year", F.col("name").alias("ref_name"), F.col("station_id").alias("ref_id"), F.lit(0).alias("_rank"), (-F.col("pos")).alias("_pos"))
    alias = primaries.select("year", suffix_alias(F.col("name")).alias("ref_name"), F.col("station_id").alias("ref_id"), F.lit(1).alias("_rank"), F.col("pos").alias("_pos")).where("ref_name is not null")
    by = Window.partitionBy("year", "ref_name").orderBy("_rank", "_pos")
    return exact.unionByName(alias).withColumn("_n", F.row_number().over(by)).where("_n = 1").select("year", "ref_name", "ref_id")


def resolve(secondaries: DataFrame, names: DataFrame, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Secondaries (year, reference) with ref_id, and those whose reference is unknown."""
    name = F.col("reference")
    if aliases:
        name = F.coalesce(F.create_map(*[F.lit(x) for p in aliases.items() for x in p])[name], name)
    rows = secondaries.withColumn("ref_name", name)
    return rows.join(broadcast_if_small(names), ["year", "ref_name"]).drop("ref_name"), rows.join(names, ["year", "ref_name"], "left_anti").drop("ref_name")


def has_magnitude(s: DataFrame) -> Column:
    return F.coalesce("pct_flood", "pct_ebb", "max_flood_knots", "max_ebb_knots").isNotNull()


def secondary_tides(resolved: DataFrame, reference_events: DataFrame, heights: DataFrame) -> DataFrame:
    """Events of secondary tide stations: each reference event shifted in time and height.

    The height difference goes from the mean tide's to the large tide's along the reference's own height. Secondaries
    are the small side and are broadcast, so the events of a reference that many share stay where they are."""
    s = broadcast_if_small(resolved.join(heights, "ref_id"))
    e = reference_events.withColumnRenamed("station_id", "ref_id")
    hi = F.col("is_high")
    pick = lambda c: F.when(hi, F.col(f"hw_{c}")).otherwise(F.col(f"lw_{c}"))
    span = pick("large") - pick("mean")
    slope = F.when(span == 0, F.lit(0.0)).otherwise(F.try_divide(pick("dh_large") - pick("dh_mean"), span))
    v = F.col("v") + pick("dh_mean") + (F.col("v") - pick("mean")) * slope
    return e.join(s, ["year", "ref_id"]).select("sec_id", "year", (F.col("t_us") + signed_minutes(pick("diff")) * MINUTE_US).alias("t_us"), F.col("ord"), v.alias("v"))


def secondary_currents(resolved: DataFrame, reference_events: DataFrame) -> DataFrame:
    """Events of secondary current stations from reference events with roles. Slacks are zero and shift by their turn;
    peaks shift by their own difference and are a share of the reference or a fixed speed; without that difference a
    peak stands halfway between two slacks of opposite kind."""
    s = broadcast_if_small(resolved.where(has_magnitude(resolved)))
    e = reference_events.withColumnRenamed("station_id", "ref_id")
    role = F.col("role")
    diff = F.when(role == TO_FLOOD, F.col("turn_to_flood")).when(role == TO_EBB, F.col("turn_to_ebb")).when(role == MAX_FLOOD, F.col("flood_diff")).otherwise(F.col("ebb_diff"))
    slack = role.isin(TO_FLOOD, TO_EBB)
    flood = F.coalesce(F.col("pct_flood") / 100.0 * F.col("v"), F.col("max_flood_knots"), F.lit(0.0))
    ebb = F.coalesce(F.col("pct_ebb") / 100.0 * F.col("v"), -F.col("max_ebb_knots"), F.lit(0.0))
    weak = ~slack & F.col("weak")
    v = F.when(slack | weak, F.lit(0.0)).when(role == MAX_FLOOD, flood).otherwise(ebb)
    shifted = e.join(s, ["year", "ref_id"]).where(diff.isNotNull()).select("sec_id", "year", (F.col("t_us") + signed_minutes(diff) * MINUTE_US).alias("t_us"), "ord", v.alias("v"), weak.alias("weak"), "role", F.col("max_flood_knots").alias("_f"), F.col("max_ebb_knots").alias("_e"), (F.col("flood_diff").isNull() | F.col("ebb_diff").isNull()).alias("_synth"))
    return shifted.drop("_f", "_e", "_synth").unionByName(midpoints(shifted))


def midpoints(shifted: DataFrame) -> DataFrame:
    by = Window.partitionBy("sec_id", "year").orderBy("t_us", "ord")
    rows = shifted.withColumn("_role", F.lead("role").over(by)).withColumn("_t", F.lead("t_us").over(by))
    opposite = ((F.col("role") == TO_FLOOD) & (F.col("_role") == TO_EBB)) | ((F.col("role") == TO_EBB) & (F.col("_role") == TO_FLOOD))
    peak = F.when(F.col("role") == TO_FLOOD, F.col("_f")).otherwise(-F.col("_e"))
    out = rows.where(F.col("_synth") & opposite).withColumn("_peak", peak).where("_peak is not null and _peak <> 0")
    role = F.when(F.col("role") == TO_FLOOD, MAX_FLOOD).otherwise(MAX_EBB)
    middle = F.expr("(t_us + _t) div 2")
    return out.select("sec_id", "year", middle.alias("t_us"), (F.col("ord") + 10**12).alias("ord"), F.col("_peak").alias("v"), F.lit(False).alias("weak"), role.alias("role"))


def current_bound(pct_flood, pct_ebb, max_flood, max_ebb, ref_flood, ref_ebb, from_tides) -> Column:
    """Full scale of a secondary current station; null where neither rule gives one."""
    own = F.greatest(F.abs(F.coalesce(max_flood, F.lit(0.0))), F.abs(F.coalesce(max_ebb, F.lit(0.0))))
    share = F.greatest(F.coalesce(pct_flood, F.lit(0)) / 100.0 * F.abs(ref_flood), F.coalesce(pct_ebb, F.lit(0)) / 100.0 * F.abs(ref_ebb))
    return F.when(F.coalesce(max_flood, max_ebb).isNotNull(), own).when(F.coalesce(pct_flood, pct_ebb).isNotNull() & ~from_tides, share)
