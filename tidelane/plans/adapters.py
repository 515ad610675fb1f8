"""Station-shaped frames from the given tables: event users are stations, customers are secondaries and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import micros

HOUR_US = 3_600_000_000
OFFSET_HOURS = -8
SHEET = 1_000_000
TIDE_KIND, CURRENT_KIND = "tidal_primary", "current_primary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("station_id"), F.year("ts").alias("year"), micros(F.col("ts")).alias("t_us"), F.col("event_id").alias("ord"), "event_type", "value", "user_id")


def tide_series(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select("station_id", "year", "t_us", "ord", (F.col("value") / 50).alias("v"), F.lit(False).alias("weak"), "user_id")


def current_series(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    v = F.when(kind.isin("view", "error"), F.lit(0.0)).when(kind == "purchase", -F.col("value") / 50).otherwise(F.col("value") / 50)
    return _events(spark, sf_dir).select("station_id", "year", "t_us", "ord", v.alias("v"), (kind == "error").alias("weak"), F.when(kind == "view", "slack").otherwise("max").alias("kind"), "user_id")


def instants(series: DataFrame) -> DataFrame:
    """Each event's own instant, and others before and behind it."""
    return series.select("station_id", F.explode(F.array(*(F.col("t_us") + k * 2_000_000_000 for k in (-1, 0, 1)))).alias("t_us"))


def _local(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).withColumn("local", F.timestamp_micros(F.col("t_us") + OFFSET_HOURS * HOUR_US))


def tide_documents(spark, sf_dir) -> DataFrame:
    """Nested documents as the yearbooks have them, one a station, local month and sheet of ``SHEET`` event numbers, so that
    a busy station is many documents and not one long row."""
    reading = F.struct("ord", F.date_format("local", "HH:mm").alias("time"), (F.col("value") / 50).alias("metres"))
    days = _local(spark, sf_dir).groupBy("station_id", F.year("local").alias("year"), F.month("local").alias("month"), F.day("local").alias("day"), F.floor(F.col("ord") / SHEET).alias("sheet")).agg(F.sort_array(F.collect_list(reading)).alias("r"))
    days = days.withColumn("readings", F.transform("r", lambda x: F.struct(x["time"].alias("time"), x["metres"].alias("metres"))))
    day = F.struct("month", "day", "readings")
    return days.groupBy("station_id", "year", "sheet", F.col("month").alias("_month")).agg(F.sort_array(F.collect_list(day)).alias("days")).drop("sheet", "_month").withColumn("utc_offset", F.lit(OFFSET_HOURS))


def current_documents(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    event = F.struct(
        "ord", F.date_format("local", "HH:mm").alias("time"), F.when(kind == "view", "slack").otherwise("max").alias("kind"),
        F.when(kind == "purchase", -F.col("value") / 50).otherwise(F.col("value") / 50).alias("knots"), (kind == "error").alias("weak_variable"),
    )
    days = _local(spark, sf_dir).groupBy("station_id", F.year("local").alias("year"), F.month("local").alias("month"), F.day("local").alias("day"), F.floor(F.col("ord") / SHEET).alias("sheet")).agg(F.sort_array(F.collect_list(event)).alias("r"))
    days = days.withColumn("events", F.transform("r", lambda x: x.dropFields("ord")))
    return days.groupBy("station_id", "year", "sheet", F.col("month").alias("_month")).agg(F.sort_array(F.collect_list(F.struct("month", "day", "events"))).alias("days")).drop("sheet", "_month").withColumn("utc_offset", F.lit(OFFSET_HOURS))


def primaries(spark, sf_dir) -> DataFrame:
    """Users as reference stations of 2024; every other name ends in a word that has an alias."""
    users = _events(spark, sf_dir).select("user_id", "station_id").distinct()
    name = F.concat(F.lit("REF "), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, " HARBOUR").otherwise(""))
    return users.select(
        "station_id", name.alias("name"), F.col("user_id").alias("pos"), F.lit(2024).alias("year"),
        (3.0 + F.col("user_id") * 0.1).alias("hw_mean"), (4.0 + F.col("user_id") * 0.1).alias("hw_large"),
        F.lit(1.0).alias("lw_mean"), F.when(F.col("user_id") % 5 == 0, 1.0).otherwise(0.5).alias("lw_large"),
        (F.col("user_id") % 7 + 1.5).cast("double").alias("max_flood_knots"), (-(F.col("user_id") % 4) - 2.0).cast("double").alias("max_ebb_knots"),
    )


def _signed(minutes):
    m = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def secondaries(spark, sf_dir) -> DataFrame:
    """Customers as secondary stations of 2024, dealt out to all users; every 41st names a reference that does not exist."""
    k = F.col("c_custkey")
    users = table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("users"))
    c = table(spark, sf_dir, "customer").crossJoin(F.broadcast(users))  # one row
    when = lambda r, x: F.when(k % 5 == r, x)
    return c.select(
        k.alias("sec_id"), F.col("c_name").alias("name"), F.lit(2024).alias("year"),
        F.when(k % 41 == 40, "NOWHERE").otherwise(F.concat(F.lit("REF "), (k % F.col("users")).cast("string"))).alias("reference"),
        _signed(k * 37 % 361 - 180).alias("hw_diff"), _signed(k * 53 % 361 - 180).alias("lw_diff"),
        (k % 9 * 0.1).alias("hw_dh_mean"), (k % 11 * 0.2).alias("hw_dh_large"), (k % 3 * -0.1).alias("lw_dh_mean"), (k % 4 * 0.1).alias("lw_dh_large"),
        _signed(k * 37 % 61 - 30).alias("turn_to_flood"), _signed(k * 53 % 61 - 30).alias("turn_to_ebb"),
        F.when(k % 5 < 3, _signed(k * 7 % 61 - 30)).alias("flood_diff"), F.when(k % 5 < 3, _signed(k * 11 % 61 - 30)).alias("ebb_diff"),
        when(0, k % 90 + 10).cast("int").alias("pct_flood"), when(0, k % 80 + 15).cast("int").alias("pct_ebb"),
        F.when((k % 5).isin(1, 3), k % 6 + 1.5).cast("double").alias("max_flood_knots"), F.when((k % 5).isin(1, 3), k % 8 * 0.5).cast("double").alias("max_ebb_knots"),
        (k % 10 == 3).alias("from_tides"),
    )


#: The same frames in DuckDB's SQL.
SERIES_SQL = """
tide AS (SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(year(ts) AS INTEGER) AS year, epoch_us(ts) AS t_us, event_id AS ord, value / 50 AS v, false AS weak, user_id FROM events),
cur AS (SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(year(ts) AS INTEGER) AS year, epoch_us(ts) AS t_us, event_id AS ord,
  CASE WHEN event_type IN ('view', 'error') THEN 0.0 WHEN event_type = 'purchase' THEN -value / 50 ELSE value / 50 END AS v, event_type = 'error' AS weak, CASE WHEN event_type = 'view' THEN 'slack' ELSE 'max' END AS kind, user_id FROM events)"""


def segments_sql(source: str) -> str:
    return f"""seg AS (SELECT * FROM (SELECT station_id, t_us AS t1, v AS v1, weak AS w1, lead(t_us) OVER w AS t2, lead(v) OVER w AS v2, lead(weak) OVER w AS w2, lead(t_us, 2) OVER w IS NULL AS is_last, ord
  FROM {source} WINDOW w AS (PARTITION BY station_id ORDER BY t_us, ord)) WHERE t2 IS NOT NULL)"""


def as_of_sql(source: str) -> str:
    return f"""{SERIES_SQL}, {segments_sql(source)},
q AS (SELECT station_id, t_us + k * 2000000000 AS t_us FROM {source}, (VALUES (-1), (0), (1)) x(k)),
found AS (SELECT q.station_id, q.t_us, CASE WHEN ok THEN t1 END AS t1, CASE WHEN ok THEN v1 END AS v1, CASE WHEN ok THEN w1 END AS w1, CASE WHEN ok THEN t2 END AS t2, CASE WHEN ok THEN v2 END AS v2, CASE WHEN ok THEN w2 END AS w2
  FROM (SELECT q.station_id, q.t_us, t1, v1, w1, t2, v2, w2, q.t_us <= t2 AS ok FROM q ASOF LEFT JOIN seg ON q.station_id = seg.station_id AND q.t_us >= seg.t1) q)"""


TAU = "((t_us - t1) / CAST(t2 - t1 AS DOUBLE))"
HALF = f"((v1 + v2) / 2 + (v1 - v2) / 2 * cos(pi() * {TAU}))"
TIDE_VALUE = f"(CASE WHEN t1 = t2 THEN v1 ELSE {HALF} END)"
TIDE_STATE = "(CASE WHEN t1 IS NULL THEN NULL WHEN t1 = t2 OR t_us - t1 < 300000000 OR t2 - t_us < 300000000 THEN 'slack' WHEN v2 > v1 THEN 'flood' ELSE 'ebb' END)"
CURRENT_VALUE = f"(CASE WHEN t1 = t2 THEN v1 WHEN v1 = 0 AND v2 = 0 THEN 0.0 WHEN v1 = 0 THEN v2 * sin(pi() * {TAU} / 2) WHEN v2 = 0 THEN v1 * cos(pi() * {TAU} / 2) ELSE {HALF} END)"
CURRENT_STATE = f"(CASE WHEN t1 IS NULL THEN NULL WHEN t1 = t2 OR abs({CURRENT_VALUE}) < 0.1 THEN 'slack' WHEN {CURRENT_VALUE} > 0 THEN 'flood' ELSE 'ebb' END)"
PRIMARIES_SQL = """prim AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS station_id, 'REF ' || user_id || CASE WHEN user_id % 2 = 0 THEN ' HARBOUR' ELSE '' END AS name, user_id AS pos, 2024 AS year,
  CAST(3.0 + user_id * CAST(0.1 AS DOUBLE) AS DOUBLE) AS hw_mean, CAST(4.0 + user_id * CAST(0.1 AS DOUBLE) AS DOUBLE) AS hw_large, CAST(1.0 AS DOUBLE) AS lw_mean, CAST(CASE WHEN user_id % 5 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS lw_large,
  CAST(user_id % 7 + 1.5 AS DOUBLE) AS ref_flood, CAST(-(user_id % 4) - 2.0 AS DOUBLE) AS ref_ebb FROM events)"""


def _signed_sql(m: str) -> str:
    return f"(({m}) * 60000000)"


SECONDARIES_SQL = f"""sec AS (SELECT c_custkey AS sec_id, c_name AS name, 2024 AS year, CASE WHEN c_custkey % 41 = 40 THEN 'NOWHERE' ELSE 'REF ' || (c_custkey % (SELECT count(DISTINCT user_id) FROM events)) END AS reference,
  {_signed_sql('c_custkey * 37 % 361 - 180')} AS hw_us, {_signed_sql('c_custkey * 53 % 361 - 180')} AS lw_us,
  c_custkey % 9 * CAST(0.1 AS DOUBLE) AS hw_dh_mean, c_custkey % 11 * CAST(0.2 AS DOUBLE) AS hw_dh_large, c_custkey % 3 * CAST(-0.1 AS DOUBLE) AS lw_dh_mean, c_custkey % 4 * CAST(0.1 AS DOUBLE) AS lw_dh_large,
  {_signed_sql('c_custkey * 37 % 61 - 30')} AS ttf, {_signed_sql('c_custkey * 53 % 61 - 30')} AS tte,
  CASE WHEN c_custkey % 5 < 3 THEN {_signed_sql('c_custkey * 7 % 61 - 30')} END AS fmd, CASE WHEN c_custkey % 5 < 3 THEN {_signed_sql('c_custkey * 11 % 61 - 30')} END AS emd,
  CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 90 + 10 END AS pct_flood, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 80 + 15 END AS pct_ebb,
  CAST(CASE WHEN c_custkey % 5 IN (1, 3) THEN c_custkey % 6 + 1.5 END AS DOUBLE) AS max_flood, CAST(CASE WHEN c_custkey % 5 IN (1, 3) THEN c_custkey % 8 * 0.5 END AS DOUBLE) AS max_ebb, c_custkey % 10 = 3 AS from_tides
  FROM customer),
nm AS (SELECT year, ref_name, arg_min(station_id, k) AS ref_id FROM (SELECT year, name AS ref_name, station_id, -pos AS k FROM prim UNION ALL SELECT year, regexp_replace(name, ' HARBOUR$', ''), station_id, pos + 1000 FROM prim WHERE name LIKE '% HARBOUR') GROUP BY 1, 2),
res AS (SELECT sec.*, nm.ref_id FROM sec JOIN nm ON sec.year = nm.year AND sec.reference = nm.ref_name)"""
