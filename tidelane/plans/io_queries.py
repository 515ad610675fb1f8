"""Registered queries on readers, writers, streams, page headers, contents and merges, set from the given tables, with SQL.

What they write goes to a folder of its own under ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, extract_lines, interpolate, segments
from ..sources import publication, readers, writers
from ..sources.scratch import scratch_folder as folder
from ..streaming import instants
from . import adapters as A
from . import dimension_queries as D

Q, SQL = {}, {}
r6 = lambda c: F.round(c, 6) + F.lit(0.0)
R6 = lambda s: f"round({s}, 6) + 0.0"


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""SELECT CAST(c_custkey AS INTEGER) AS index_no, {R6('45 + (c_custkey % 400) / CAST(100 AS DOUBLE)')} AS lat, {R6('-(c_custkey % 90) - CAST(0.5 AS DOUBLE)')} AS lon, 1 AS decimals FROM customer WHERE c_custkey % 7 <> 6""")
def inventory_file(spark, sf_dir):
    """An inventory written as CSV files and read back; every seventh row has no number that parses."""
    k = F.col("c_custkey")
    path = folder(spark, "inventory")
    number = F.when(k % 7 == 6, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.lpad(k.cast("string"), 8, "0"))
    lat = F.format_string("%.2f", 45 + k % 400 / 100)
    A.table(spark, sf_dir, "customer").select(number.alias("STATION_NUMBER"), lat.alias("LATITUDE"), F.concat(F.lit("-"), (k % 90).cast("string"), F.lit(".5")).alias("LONGITUDE"), F.col("c_name").alias("NAME")).write.option("header", True).csv(path)
    return readers.inventory(spark, path).select("index_no", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "decimals")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS kind, count(*) AS n, sum(o_custkey) AS customers FROM orders GROUP BY 1, 2")
def published_rows(spark, sf_dir):
    """Orders published by year and priority, one kind changed and published again, and read by the index."""
    o = A.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("kind"), "o_orderkey", "o_custkey")
    path = folder(spark, "publication")
    publication.publish(o.withColumn("o_custkey", F.when(F.col("kind") == "5-LOW", F.lit(0)).otherwise(F.col("o_custkey")).cast("long")), path)
    publication.publish(o.withColumn("o_custkey", F.col("o_custkey").cast("long")), path)
    return publication.read_published(spark, path).groupBy("year", "kind").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))


@query(f"SELECT kind, count(*) AS anomalies, count(DISTINCT id) AS ids FROM ({D.SQL['drift_tides']}) GROUP BY kind")
def anomaly_report(spark, sf_dir):
    """The drift of the tide picks as a written report."""
    path = folder(spark, "report")
    drift = catalog.tide_drift(D._picks(spark, sf_dir), D._catalog(spark, sf_dir))
    catalog.gate(drift, force=True)
    writers.write_report(drift, path)
    return spark.read.parquet(path).where(F.get_json_object("detail", "$.placename").isNotNull()).groupBy("kind").agg(F.count("*").alias("anomalies"), F.count_distinct("id").alias("ids"))


@query(f"WITH {A.as_of_sql('cur')} SELECT station_id, t_us, {R6(A.CURRENT_VALUE)} AS value, {A.CURRENT_STATE} AS state FROM found WHERE t1 IS NOT NULL")
def streamed_states(spark, sf_dir):
    """The flagship lookup with the instants as a stream of files, each held against the segments of its day."""
    series = A.current_series(spark, sf_dir)
    path = folder(spark, "stream")
    A.instants(series).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("station_id string, t_us long").parquet(f"{path}/in")
    instants.run_available(instants.stream_snapshot(stream, segments.bucketed_segments(series)), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("station_id string, t_us long, value double, state string").parquet(f"{path}/out").select("station_id", "t_us", r6(F.col("value")).alias("value"), "state")


TICKS_SQL = f"""{A.SERIES_SQL}, {A.segments_sql('cur')},
  q AS (SELECT station_id, t_us FROM (SELECT DISTINCT station_id FROM cur), (SELECT DISTINCT epoch_us(date_trunc('day', ts)) + 43200000000 AS t_us FROM events)),
  found AS (SELECT q.station_id, q.t_us, t1, v1, t2, v2 FROM q ASOF JOIN seg ON q.station_id = seg.station_id AND q.t_us >= seg.t1 WHERE q.t_us < t2 OR is_last AND q.t_us = t2),
  st AS (SELECT *, {A.CURRENT_VALUE} AS value, {A.CURRENT_STATE} AS state FROM found),
  ch AS (SELECT *, lag(state) OVER (PARTITION BY station_id ORDER BY t_us) AS before FROM st)"""


@query(f"""WITH {TICKS_SQL} SELECT station_id, t_us, 'change' AS kind, state, {R6('value')} AS value FROM ch WHERE before IS NULL OR before <> state
  UNION ALL SELECT station_id, t2, 'extreme', {A.CURRENT_STATE.replace('t_us', 't2')}, {R6(A.CURRENT_VALUE.replace('t_us', 't2'))} FROM (SELECT DISTINCT station_id, t1, v1, t2, v2 FROM st) WHERE t2 <= (SELECT max(t_us) FROM q)""")
def tick_changes(spark, sf_dir):
    """The changes of all stations at a tick each noon, and the extremes that event time has passed, from a stream with state."""
    from ..streaming import ticks

    series, path = A.current_series(spark, sf_dir), folder(spark, "ticks")
    at = A.table(spark, sf_dir, "events").select((F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))) + 43_200_000_000).alias("t_us")).distinct()
    at.write.parquet(f"{path}/in")
    ticks.run_available(spark.readStream.schema("t_us long").parquet(f"{path}/in"), segments.bucketed_segments(series), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("station_id string, t_us long, kind string, state string, value double").parquet(f"{path}/out").withColumn("value", r6(F.col("value")))


@query("""WITH lim AS (SELECT max(ts) - INTERVAL 5 MINUTE AS late FROM events), w AS (SELECT user_id, date_trunc('hour', ts) AS start, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY 1, 2)
  SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(start) AS start_us, value, epoch_us(ts) AS ts_us FROM w, lim WHERE start + INTERVAL 1 HOUR <= late""")
def conflated_events(spark, sf_dir):
    """The latest event of each user and hour from a stream; hours that the watermark has not passed are still open."""
    path = folder(spark, "conflate")
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value")
    e.repartition(4).write.parquet(f"{path}/in")
    rows = instants.conflate(spark.readStream.schema(e.schema).parquet(f"{path}/in"), "1 hour")
    instants.run_available(rows, f"{path}/out", f"{path}/checkpoint")
    out = spark.read.schema("key string, start timestamp, value double, ts timestamp").parquet(f"{path}/out")
    return out.select("key", F.unix_micros("start").alias("start_us"), "value", F.unix_micros("ts").alias("ts_us"))


NAME = "translate(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '0123456789', 'ABCDEFGHIJ')"


def _name(k):
    return F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "ABCDEFGHIJ")


@query(f"""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'tide' ELSE 'current' END AS kind, 'PORT ' || {NAME} AS name, -8 AS utc_offset, CAST(2020 + c_custkey % 10 AS INTEGER) AS year,
  CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 360 AS INTEGER) END AS flood FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 11 <> 10""")
def page_headers(spark, sf_dir):
    """Headers of tide and current pages, among pages without one."""
    k = F.col("c_custkey")
    year, name = (2020 + k % 10).cast("string"), F.concat(F.lit("PORT "), _name(k))
    spoiled = k % 11 == 10
    tide = F.concat(name, F.when(spoiled, " ").otherwise(" PST-HNP (UTC-8) "), year, F.lit(" TIDE TABLES"))
    flow = F.concat(F.lit("Flood/flot direction "), F.lpad((k % 360).cast("string"), 3, "0"), F.lit(" True/vraie - Ebb/jusant direction 180 True/vraie"))
    lines = F.when(k % 3 == 0, F.array(tide)).when(k % 3 == 1, F.array(F.when(spoiled, "page").otherwise(year), name, F.lit("PST (UTC-8h)"), flow)).otherwise(F.array(F.lit("NOTES")))
    rows = A.table(spark, sf_dir, "customer").select(k.alias("k"), lines.alias("lines"))
    tides = rows.select("k", F.lit("tide").alias("kind"), extract_lines.tide_header(F.get("lines", F.lit(0))).alias("h"), F.lit(None).cast("int").alias("flood")).where("h is not null").select("k", "kind", "h.name", "h.utc_offset", "h.year", "flood")
    currents = rows.select("k", F.lit("current").alias("kind"), extract_lines.current_header(F.col("lines")).alias("h"), extract_lines.flow_directions(F.get("lines", F.lit(3)))["flood"].alias("flood")).where("h is not null")
    return tides.unionByName(currents.select("k", "kind", "h.name", "h.utc_offset", "h.year", "flood"))


@query(f"""WITH e AS (SELECT c_custkey // 40 AS d, c_custkey AS k, c_custkey % 40 + 10 AS p FROM customer WHERE c_custkey % 40 BETWEEN 1 AND 39 AND c_custkey % 40 <> 20)
  SELECT 'vol' || d AS doc, CASE WHEN p < 30 THEN 'Tide Tables' ELSE 'Current Tables' END AS section, 'PORT ' || translate(lpad(CAST(k AS VARCHAR), 6, '0'), '0123456789', 'ABCDEFGHIJ') AS title, CAST(p AS INTEGER) AS first_page, CAST(coalesce(lead(p) OVER (PARTITION BY d ORDER BY p), 60) AS INTEGER) AS end_page FROM e""")
def contents_ranges(spark, sf_dir):
    """Contents pages of forty lines, two sections each, and the pages that their stations fill."""
    k = F.col("c_custkey")
    n = k % 40
    text = F.when(n == 0, "Tide Tables").when(n == 20, "Current Tables").otherwise(F.concat(F.lit("PORT "), _name(k), F.lit(" .... "), (n + 10).cast("string")))
    rows = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("vol"), F.floor(k / 40).cast("string")).alias("doc"), n.cast("int").alias("row"), text.alias("text"), F.when(n % 20 == 0, 50.0).otherwise(90.0).alias("x0"))
    found = extract_lines.page_ranges(extract_lines.contents(rows), F.lit(60))
    return found.select("doc", "section", "title", "first_page", "end_page")


@query(f"""WITH p AS (SELECT c_custkey AS k, c_custkey // 50 AS d FROM customer WHERE c_custkey % 50 <> 49)
  SELECT 'by position' AS way, 'vol' || d AS doc, 'PORT ' || translate(lpad(CAST(k AS VARCHAR), 6, '0'), '0123456789', 'ABCDEFGHIJ') AS name, {R6('(k % 30) / CAST(10 AS DOUBLE)')} AS mean FROM p WHERE k % 13 <> 12
  UNION ALL SELECT 'by name', 'vol' || d, 'PORT ' || translate(lpad(CAST(k AS VARCHAR), 6, '0'), '0123456789', 'ABCDEFGHIJ'), {R6('(k % 30) / CAST(10 AS DOUBLE)')} FROM p WHERE k % 13 <> 12""")
def merged_tables(spark, sf_dir):
    """Stations with their rows of a table, by place and by name; every 13th has another name there, every 50th no row."""
    k = F.col("c_custkey")
    doc = F.concat(F.lit("vol"), F.floor(k / 50).cast("string")).alias("doc")
    name = F.concat(F.lit("PORT "), _name(k))
    c = A.table(spark, sf_dir, "customer")
    stations = c.select(doc, (k % 50).cast("int").alias("pos"), name.alias("name"), F.lit(-8).alias("utc_offset"))
    other = F.when(k % 13 == 12, F.concat(F.lit("OTHER "), name)).otherwise(name)
    rows = c.where(k % 50 != 49).select(doc, (k % 50).cast("int").alias("pos"), other.alias("name"), F.lit(-8).alias("utc_offset"), (k % 30 / 10).alias("mean"))
    placed, _ = extract_lines.merge_by_position(stations, rows)
    named, _ = extract_lines.merge_by_name(stations.drop("pos"), rows.select("doc", F.lower(F.regexp_replace("name", " ", " - ")).alias("name"), "mean"))
    both = placed.select(F.lit("by position").alias("way"), "doc", "name", "mean").unionByName(named.select(F.lit("by name").alias("way"), "doc", "name", "mean"))
    return both.withColumn("mean", r6(F.col("mean")))


#: One decimal by exact value, middles (quarters of an odd number, which doubles hold exactly) away from zero.
ONE_DECIMAL = "CASE WHEN v = 0 THEN '0.0' WHEN abs(v) * 4 % 2 = 1 THEN printf('%.1f', v + sign(v) * 0.01) ELSE printf('%.1f', v) END"


@query(f"WITH {A.SERIES_SQL} SELECT station_id, {R6('55 - least(greatest(v, -greatest(hi, 0.5)), greatest(hi, 0.5)) / greatest(hi, 0.5) * 33')} AS y, {ONE_DECIMAL} || ' kt' AS speed, t_us FROM cur JOIN (SELECT station_id, max(abs(v)) / 2 AS hi FROM cur GROUP BY 1) USING (station_id)")
def current_chart(spark, sf_dir):
    """Events on the axis of a current's chart, with their speeds as text."""
    from ..functions.text import speed_text

    rows = A.current_series(spark, sf_dir)
    most = rows.groupBy("station_id").agg((F.max(F.abs("v")) / 2).alias("hi"))
    found = rows.join(most, "station_id")
    return found.select("station_id", r6(interpolate.current_axis(F.col("v"), F.col("hi"))).alias("y"), speed_text(F.col("v")).alias("speed"), "t_us")
