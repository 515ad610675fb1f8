"""The three workloads end to end, as functions from tables to tables; callers read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, classify, coords, derive, interpolate, merge, normalise, publish, segments


def tide_states(primary_events: DataFrame, primaries: DataFrame, secondaries: DataFrame, instants: DataFrame) -> DataFrame:
    """value and state of primary and secondary tide stations at ``instants`` (station_id, t_us).

    References are classed year by year, secondaries derived from them by a broadcast of the small side, all series
    merged, and instants looked up in one sorted pass by station. References are dealt out to a task for each
    ``segments.TASK_ROWS`` derived events, which are counted from the events of each reference, not derived for that."""
    resolved, _ = derive.resolve(secondaries, derive.reference_names(primaries))
    heights = primaries.select(F.col("station_id").alias("ref_id"), "hw_mean", "hw_large", "lw_mean", "lw_large")
    own = primary_events.select("station_id", "year", "t_us", "ord", "v")
    sec = merge.namespaced("sec", F.col("sec_id")).alias("station_id")
    sizes = own.groupBy("station_id", "year").agg(F.count("*").alias("n"))
    made_sizes = resolved.select("sec_id", "year", "ref_id").join(sizes.withColumnRenamed("station_id", "ref_id"), ["year", "ref_id"]).select(sec, "n")
    tasks = segments.tasks_for(made_sizes.agg(F.sum("n")).first()[0], own.sparkSession)
    # With a number, adaptive execution leaves these partitions as they are (their few bytes say nothing of the rows they make),
    # and by the station alone they serve the classes and the join.
    made = derive.secondary_tides(resolved, classify.high_low(own.repartition(tasks, "station_id"), "station_id", "year"), heights)
    made = made.select(sec, "year", "t_us", "ord", "v")
    series = merge.merged(own, made).withColumn("weak", F.lit(False))
    found = segments.lookup(series, instants, sizes=sizes.select("station_id", "n").unionByName(made_sizes))
    return found.select("station_id", "t_us", interpolate.tide_value().alias("value"), interpolate.tide_state().alias("state"))


def conform_and_publish(documents: DataFrame, inventory: DataFrame, overrides: DataFrame, suppressed: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a kind without the suppressed, with their coordinates settled and their fields pruned; and the flags."""
    rows = documents.withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    settled = coords.resolve(coords.suppress(rows, suppressed), inventory, overrides)
    flagged = coords.flags(settled)
    return publish.strip(settled.withColumnsRenamed({"lat": "latitude", "lon": "longitude"}), kind), flagged


def conform_payloads(payloads: DataFrame, picks: DataFrame, stations: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents of the tide picks that have a payload, and the picks that have none. Stops at a drift of the catalog."""
    catalog.gate(catalog.tide_drift(picks, stations), force)
    chosen = normalise.enrich(normalise.tide_picks(picks), stations, last=True)
    rows = normalise.tide_rows(payloads)
    docs = normalise.nest_days(rows.withColumn("year", F.year(F.col("date").cast("date"))), ["id", "year"], ["time", "metres"])
    out = chosen.join(docs, "id").withColumn("utc_offset", F.lit(normalise.LOCAL_OFFSET)).withColumn("station_id", merge.namespaced("noaa", F.col("id")))
    return out, normalise.missing(picks, payloads.select("id"), ["id"])
