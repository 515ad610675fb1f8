"""Registered queries on event series, with their SQL: lookup, grids, curves, classes and derived stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import opposite, within_degrees
from ..functions.timeutil import iso_minutes, local_clock, local_midnight_us, weekday_label
from ..functions.text import feet
from ..operators import classify, derive, interpolate, merge, normalise, segments
from . import adapters as A

ZONE = "America/Vancouver"
STEP_US = 3 * 60 * 1_000_000
r6 = lambda c: F.round(c, 6) + F.lit(0.0)
R6 = lambda s: f"round({s}, 6) + 0.0"

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _asof(spark, sf_dir, current: bool = False) -> DataFrame:
    s = (A.current_series if current else A.tide_series)(spark, sf_dir)
    return segments.lookup(s, A.instants(s))


@query(f"WITH {A.as_of_sql('cur')} SELECT station_id, t_us, {R6(A.CURRENT_VALUE)} AS value, {A.CURRENT_STATE} AS state, coalesce(CASE WHEN t1 = t2 THEN w1 OR w2 ELSE (w1 AND {A.TAU} < 0.5) OR (w2 AND {A.TAU} >= 0.5) END, false) AS weak FROM found")
def current_state_at(spark, sf_dir):
    rows = _asof(spark, sf_dir, True)
    return rows.select("station_id", "t_us", r6(interpolate.current_value()).alias("value"), interpolate.current_state().alias("state"), interpolate.current_weak().alias("weak"))


@query(f"WITH {A.as_of_sql('cur')} SELECT station_id, t_us, {R6(A.CURRENT_VALUE)} AS value FROM found")
def current_value_at(spark, sf_dir):
    """By the lookup that a single busy station does not slow."""
    s = A.current_series(spark, sf_dir)
    return segments.as_of_spread(s, A.instants(s)).select("station_id", "t_us", r6(interpolate.current_value()).alias("value"))


@query(f"WITH {A.as_of_sql('tide')} SELECT station_id, t_us, {R6(A.TIDE_VALUE)} AS value FROM found")
def tide_value_at(spark, sf_dir):
    return _asof(spark, sf_dir).select("station_id", "t_us", r6(interpolate.tide_value()).alias("value"))


@query(f"WITH {A.as_of_sql('tide')} SELECT station_id, t_us, {R6(A.TIDE_VALUE)} AS value, {A.TIDE_STATE} AS state FROM found")
def tide_state_at(spark, sf_dir):
    return _asof(spark, sf_dir).select("station_id", "t_us", r6(interpolate.tide_value()).alias("value"), interpolate.tide_state().alias("state"))


@query(f"WITH {A.SERIES_SQL}, {A.segments_sql('tide')} SELECT station_id, t1, {R6('v1')} AS v1, t2, {R6('v2')} AS v2, is_last FROM seg")
def tide_segments(spark, sf_dir):
    return segments.spread_segments(A.tide_series(spark, sf_dir)).select("station_id", "t1", r6(F.col("v1")).alias("v1"), "t2", r6(F.col("v2")).alias("v2"), "is_last")


SNAPS = (1_704_500_000_000_000, 1_705_000_000_000_000, 1_705_500_000_000_000, 1_706_000_000_000_000)


@query(f"""WITH {A.SERIES_SQL}, box AS (SELECT CAST(c_custkey AS VARCHAR) AS station_id, (c_custkey * 13) % 360 AS flood_dir, (c_custkey * 13 + 180) % 360 AS ebb_dir FROM customer WHERE 45 + (c_custkey % 400) / 100.0 BETWEEN 45.2 AND 46.0 AND -125 + (c_custkey * 7 % 350) / 100.0 BETWEEN -125 AND -122.5),
  near AS (SELECT cur.* FROM cur SEMI JOIN box USING (station_id)), {A.segments_sql('near')}, q AS (SELECT unnest({list(SNAPS)}) AS t_us),
  found AS (SELECT seg.*, q.t_us FROM seg JOIN q ON q.t_us >= t1 AND (q.t_us < t2 OR (is_last AND q.t_us = t2)))
  SELECT station_id, t_us, {R6(A.CURRENT_VALUE)} AS value, {A.CURRENT_STATE} AS state, CASE WHEN {A.CURRENT_STATE} = 'flood' THEN flood_dir ELSE ebb_dir END AS bearing, {R6(f"0.45 + 0.55 * least(abs({A.CURRENT_VALUE}) / 8, 1.0)")} AS strength FROM found JOIN box USING (station_id)""")
def snapshot_bbox(spark, sf_dir):
    """Every station in view at a few instants, with its arrow; the box is applied before the lookup."""
    k = F.col("c_custkey")
    lat, lon = 45 + k % 400 / 100, -125 + k * 7 % 350 / 100
    box = A.table(spark, sf_dir, "customer").where(lat.between(45.2, 46.0) & lon.between(-125, -122.5)).select(k.cast("string").alias("station_id"), (k * 13 % 360).alias("flood_dir"))
    box = derive.broadcast_if_small(box.withColumn("ebb_dir", opposite(F.col("flood_dir"))))
    near = A.current_series(spark, sf_dir).join(box, "station_id", "left_semi")
    at = segments.snapshot(near, spark.createDataFrame([(t,) for t in SNAPS], "t_us long"))
    state = interpolate.current_state()
    return at.join(box, "station_id").select("station_id", "t_us", r6(interpolate.current_value()).alias("value"), state.alias("state"), interpolate.bearing(state, F.col("flood_dir"), F.col("ebb_dir")).alias("bearing"), r6(interpolate.arrow_strength(interpolate.current_value())).alias("strength"))


@query(SQL["snapshot_bbox"])
def snapshot_tiles(spark, sf_dir):
    """The same from segments that are stored by tile: files of tiles outside the box are not opened."""
    from ..sources import scratch, stored

    k = F.col("c_custkey")
    places = A.table(spark, sf_dir, "customer").select(k.cast("string").alias("station_id"), (45 + k % 400 / 100).alias("lat"), (-125 + k * 7 % 350 / 100).alias("lon"), (k * 13 % 360).alias("flood_dir"))
    path = scratch.scratch_folder(spark, "segments-by-tile")
    stored.store_by_tile(segments.segments(A.current_series(spark, sf_dir)).join(places, "station_id"), path)
    seen = stored.read_box(spark, path, (45.2, 46.0, -125.0, -122.5)).withColumn("ebb_dir", opposite(F.col("flood_dir")))
    at = seen.join(F.broadcast(spark.createDataFrame([(t,) for t in SNAPS], "t_us long")), segments.holds())  # four instants
    state = interpolate.current_state()
    return at.select("station_id", "t_us", r6(interpolate.current_value()).alias("value"), state.alias("state"), interpolate.bearing(state, F.col("flood_dir"), F.col("ebb_dir")).alias("bearing"), r6(interpolate.arrow_strength(interpolate.current_value())).alias("strength"))


@query(SQL["current_value_at"])
def stored_value_at(spark, sf_dir):
    """The lookup in segments that are stored in buckets of station and day, none of which move."""
    import uuid

    from ..sources import scratch, stored

    series, table = A.current_series(spark, sf_dir), f"segments_{uuid.uuid4().hex}"
    stored.store_segments(series, table, scratch.scratch_folder(spark, "segments"), buckets=8)
    return stored.as_of_stored(spark, table, A.instants(series)).select("station_id", "t_us", r6(interpolate.current_value()).alias("value"))


@query("SELECT DISTINCT (c_custkey * 13) % 360 AS flood_dir, (c_custkey * 13 + 180) % 360 AS ebb_dir, abs(((c_custkey * 13) % 360 - 90 + 180 + 360) % 360 - 180) <= 45 AS eastward FROM customer")
def flow_bearings(spark, sf_dir):
    flood = F.col("c_custkey") * 13 % 360
    return A.table(spark, sf_dir, "customer").select(flood.alias("flood_dir"), opposite(flood).alias("ebb_dir"), within_degrees(flood, F.lit(90), 45).alias("eastward")).distinct()


GRID_SQL = f"""{A.SERIES_SQL}, {A.segments_sql('cur')}, pts AS (SELECT *, unnest(generate_series(CAST(ceil(t1 / {STEP_US}) AS BIGINT) * {STEP_US}, CASE WHEN is_last THEN t2 ELSE t2 - 1 END, {STEP_US})) AS t_us FROM seg)"""


def _grid(spark, sf_dir, current=True) -> DataFrame:
    s = (A.current_series if current else A.tide_series)(spark, sf_dir)
    return interpolate.grid(segments.segments(s), STEP_US)


@query(f"WITH {GRID_SQL} SELECT station_id, count(*) AS points, {R6(f'sum({A.CURRENT_VALUE})')} AS total, {R6(f'min({A.CURRENT_VALUE})')} AS low, {R6(f'max({A.CURRENT_VALUE})')} AS high FROM pts GROUP BY 1")
def grid_resample(spark, sf_dir):
    """The whole 3-minute grid of every station, summed up for comparison."""
    rows = _grid(spark, sf_dir).withColumn("value", interpolate.current_value())
    return rows.groupBy("station_id").agg(F.count("*").alias("points"), r6(F.sum("value")).alias("total"), r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"))


@query(f"""WITH {A.SERIES_SQL}, {A.segments_sql('tide')}, starts AS (SELECT station_id, min(t_us) - 3600000000 AS start_us FROM tide GROUP BY 1), q AS (SELECT station_id, start_us, unnest(generate_series(start_us, start_us + 54000000000, {STEP_US})) AS t_us FROM starts),
  found AS (SELECT q.station_id, start_us, q.t_us, CASE WHEN q.t_us <= t2 THEN t1 END AS t1, CASE WHEN q.t_us <= t2 THEN t2 END AS t2, v1, v2 FROM q ASOF LEFT JOIN seg ON q.station_id = seg.station_id AND q.t_us >= seg.t1),
  val AS (SELECT station_id, start_us, t_us, CASE WHEN t1 IS NULL THEN NULL ELSE {A.TIDE_VALUE} END AS value FROM found), rng AS (SELECT station_id, min(v) AS lo, max(v) AS hi FROM tide GROUP BY 1)
  SELECT station_id, {R6("(t_us - start_us) / 54000000000.0 * 100")} AS x, {R6("22 + ((hi + greatest(0.0, (0.6 - (hi - lo)) / 2)) - value) / ((hi + greatest(0.0, (0.6 - (hi - lo)) / 2)) - (lo - greatest(0.0, (0.6 - (hi - lo)) / 2))) * 66")} AS y FROM val JOIN rng USING (station_id)""")
def chart_scaled(spark, sf_dir):
    """A 15-hour curve of every station from an hour before its first event, on the axes of a chart."""
    s = A.tide_series(spark, sf_dir)
    spans = s.groupBy("station_id").agg((F.min("t_us") - A.HOUR_US).alias("start_us"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = segments.lookup(s, interpolate.window_grid(spans))
    x = (F.col("t_us") - F.col("start_us")) / F.lit(54_000_000_000.0) * 100
    return at.select("station_id", r6(x).alias("x"), r6(interpolate.tide_axis(interpolate.tide_value(), F.col("lo"), F.col("hi"))).alias("y"))


RUN_SQL = """marked AS (SELECT *, CASE WHEN state = lag(state) OVER w THEN 0 ELSE 1 END AS change FROM states WINDOW w AS (PARTITION BY station_id ORDER BY t_us)),
  ids AS (SELECT *, sum(change) OVER (PARTITION BY station_id ORDER BY t_us) AS run FROM marked)
  SELECT station_id, CAST(state AS INTEGER) AS sign, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS points FROM ids WHERE state <> 0 GROUP BY station_id, run, state"""


@query(f"WITH {GRID_SQL}, states AS (SELECT station_id, t_us, CASE WHEN {A.CURRENT_VALUE} > 0 THEN 1 WHEN {A.CURRENT_VALUE} < 0 THEN -1 ELSE 0 END AS state FROM pts), {RUN_SQL}")
def sign_runs(spark, sf_dir):
    return interpolate.runs(_grid(spark, sf_dir).withColumn("value", interpolate.current_value()), signed=True, within=("t1", "ord"))


@query(f"WITH {A.as_of_sql('cur')}, u AS (SELECT DISTINCT station_id, t_us, t1 FROM found), states AS (SELECT station_id, t_us, CASE WHEN t1 IS NULL THEN 0 ELSE 1 END AS state FROM u), {RUN_SQL}")
def curve_runs(spark, sf_dir):
    rows = _asof(spark, sf_dir, True).select("station_id", "t_us", "t1").distinct()
    return interpolate.runs(rows, "t1")


@query(f"""WITH {A.SERIES_SQL}, hl AS (SELECT station_id, t_us, v, v >= coalesce(lag(v) OVER w, '-infinity') AND v >= coalesce(lead(v) OVER w, '-infinity') AS is_high FROM tide WINDOW w AS (PARTITION BY station_id ORDER BY t_us, ord))
  SELECT station_id, t_us, CASE WHEN is_high THEN 'HW' ELSE 'LW' END AS label, round(v * 3.28084, 1) AS feet FROM hl WHERE t_us BETWEEN {SNAPS[1]} AND {SNAPS[2]}
  UNION ALL SELECT station_id, t_us, CASE WHEN weak OR abs(v) < 0.05 THEN 'slack' WHEN v > 0 THEN 'flood' ELSE 'ebb' END, NULL FROM cur WHERE t_us BETWEEN {SNAPS[1]} AND {SNAPS[2]}""")
def window_labels(spark, sf_dir):
    """Labels of the events in a window; neighbours outside it still count."""
    inside = F.col("t_us").between(SNAPS[1], SNAPS[2])
    tides = classify.high_low(A.tide_series(spark, sf_dir)).where(inside).select("station_id", "t_us", F.when(F.col("is_high"), "HW").otherwise("LW").alias("label"), feet(F.col("v")).alias("feet"))
    currents = A.current_series(spark, sf_dir).where(inside).select("station_id", "t_us", interpolate.current_label(F.col("v"), F.col("weak")).alias("label"), F.lit(None).cast("double").alias("feet"))
    return tides.unionByName(currents)


@query("""SELECT station_id, day_start_us, epoch_us(to_timestamp(day_start_us / 1000000) AT TIME ZONE 'America/Vancouver') // 60000000 AS local_minute, weekday, events FROM
  (SELECT CAST(user_id AS VARCHAR) AS station_id, epoch_us(CAST(date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Vancouver') AS TIMESTAMP) AT TIME ZONE 'America/Vancouver') AS day_start_us,
   strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Vancouver', '%a') AS weekday, count(*) AS events FROM events GROUP BY 1, 2, 3)""")
def local_days(spark, sf_dir):
    """Events by local day: the instant of its midnight, the label of its weekday."""
    s = A.tide_series(spark, sf_dir)
    start = local_midnight_us(F.col("t_us"), ZONE)
    rows = s.select("station_id", start.alias("day_start_us")).groupBy("station_id", "day_start_us").agg(F.count("*").alias("events"))
    local = F.from_utc_timestamp(F.timestamp_micros("day_start_us"), ZONE)
    return rows.select("station_id", "day_start_us", F.floor(F.unix_micros(local) / 60_000_000).alias("local_minute"), weekday_label(F.to_date(local_clock(F.col("day_start_us"), ZONE, "yyyy-MM-dd"))).alias("weekday"), "events")


@query(f"""WITH {A.SERIES_SQL}, starts AS (SELECT station_id, min(t_us) AS s FROM tide GROUP BY 1), t AS (SELECT station_id, unnest(generate_series(CAST(ceil(s / 900000000) AS BIGINT) * 900000000, s + 54000000000, 900000000)) AS t_us FROM starts)
  SELECT station_id, t_us, CASE WHEN t_us % 3600000000 = 0 THEN 'hour' WHEN t_us % 1800000000 = 0 THEN 'half' ELSE 'quarter' END AS kind FROM t""")
def ticks(spark, sf_dir):
    starts = A.tide_series(spark, sf_dir).groupBy("station_id").agg(F.min("t_us").alias("s"))
    return starts.select("station_id", F.explode(interpolate.ticks(F.col("s"))).alias("k")).select("station_id", "k.t_us", "k.kind")


@query(f"""WITH {A.as_of_sql('tide')}, p AS (SELECT *, abs(v2 - v1) AS r, v2 > v1 AS up FROM found)
  SELECT station_id, t_us, {R6('r')} AS range_m, CASE WHEN t1 IS NULL THEN NULL WHEN up THEN 'rising' ELSE 'falling' END AS tendency, CAST(round((t_us - t1) / 3600000000.0) AS BIGINT) AS hours,
  CAST(CASE WHEN t1 IS NULL THEN NULL WHEN up THEN CASE WHEN round(abs(r - 3.0), 9) <= least(round(abs(r - 1.8), 9), round(abs(r - 0.6), 9)) THEN 3.0 WHEN round(abs(r - 1.8), 9) <= round(abs(r - 0.6), 9) THEN 1.8 ELSE 0.6 END
   ELSE CASE WHEN round(abs(r - 3.0), 9) <= least(round(abs(r - 1.8), 9), round(abs(r - 1.2), 9)) THEN 3.0 WHEN round(abs(r - 1.8), 9) <= round(abs(r - 1.2), 9) THEN 1.8 ELSE 1.2 END END AS DOUBLE) AS curve_m FROM p""")
def phase_features(spark, sf_dir):
    return interpolate.phase(_asof(spark, sf_dir)).select("station_id", "t_us", r6(F.col("range_m")).alias("range_m"), "tendency", "hours", "curve_m")


@query(f"WITH {A.SERIES_SQL}, lim AS (SELECT min(t_us) AS a, max(t_us) AS b FROM tide) SELECT station_id, t_us, least(greatest(t_us * 2 - a, a), b) AS clamped, t_us * 2 - a > b OR t_us * 2 - a < a AS outside FROM tide, lim")
def clamped_instants(spark, sf_dir):
    s = A.tide_series(spark, sf_dir)
    limits = s.agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    asked = F.col("t_us") * 2 - F.col("a")
    rows = s.crossJoin(F.broadcast(limits))  # one row
    return rows.select("station_id", "t_us", interpolate.clamp(asked, F.col("a"), F.col("b")).alias("clamped"), ((asked > F.col("b")) | (asked < F.col("a"))).alias("outside"))


KNOTS_SQL = "CASE WHEN event_type IN ('view', 'error') THEN 0.0 WHEN event_type = 'purchase' THEN -value / 50 ELSE value / 50 END"
DOC_SQL = """loc AS (SELECT *, ts - INTERVAL 8 HOUR AS l FROM events), numbered AS (SELECT *, CAST(year(l) AS INTEGER) AS y, dense_rank() OVER (PARTITION BY user_id, year(l), month(l), event_id // 1000000 ORDER BY CAST(l AS DATE)) - 1 AS dp, row_number() OVER (PARTITION BY user_id, CAST(l AS DATE), event_id // 1000000 ORDER BY event_id) - 1 AS rp FROM loc)"""


@query(f"WITH {DOC_SQL} SELECT CAST(user_id AS VARCHAR) AS station_id, y AS year, epoch_us(date_trunc('minute', ts)) AS t_us, dp * 1000000 + rp AS ord, {R6('value / 50')} AS v FROM numbered")
def tide_extremes(spark, sf_dir):
    rows = normalise.tide_extremes(A.tide_documents(spark, sf_dir))
    return rows.select("station_id", "year", "t_us", "ord", r6(F.col("v")).alias("v"))


@query(f"WITH {DOC_SQL} SELECT CAST(user_id AS VARCHAR) AS station_id, y AS year, epoch_us(date_trunc('minute', ts)) AS t_us, dp * 1000000 + rp AS ord, {R6(KNOTS_SQL)} AS v, event_type = 'error' AS weak FROM numbered")
def current_extremes(spark, sf_dir):
    rows = normalise.current_extremes(A.current_documents(spark, sf_dir))
    return rows.select("station_id", "year", "t_us", "ord", r6(F.col("v")).alias("v"), "weak")


@query("SELECT CAST(user_id AS VARCHAR) AS station_id, epoch_us(date_trunc('minute', ts)) AS t_us, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def station_time_utc(spark, sf_dir):
    rows = normalise.tide_extremes(A.tide_documents(spark, sf_dir))
    return rows.select("station_id", "t_us", iso_minutes(F.col("t_us")).alias("iso"))


HILO_SQL = "v >= coalesce(lag(v) OVER w, '-infinity') AND v >= coalesce(lead(v) OVER w, '-infinity')"


@query(f"WITH {A.SERIES_SQL} SELECT station_id, t_us, {HILO_SQL} AS is_high FROM tide WINDOW w AS (PARTITION BY station_id, year ORDER BY t_us, ord)")
def hi_lo(spark, sf_dir):
    return classify.high_low(A.tide_series(spark, sf_dir), "station_id", "year").select("station_id", "t_us", "is_high")


@query(f"WITH {A.SERIES_SQL} SELECT station_id, t_us, CASE WHEN {HILO_SQL} THEN 'slack-to-ebb' ELSE 'slack-to-flood' END AS role FROM tide WINDOW w AS (PARTITION BY station_id, year ORDER BY t_us, ord)")
def tide_as_current(spark, sf_dir):
    return classify.tide_as_current(classify.high_low(A.tide_series(spark, sf_dir), "station_id", "year")).select("station_id", "t_us", "role")


ROLES_SQL = """signs AS (SELECT *, CASE WHEN v <> 0 THEN sign(v) END AS s FROM cur),
near AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY station_id, year ORDER BY t_us, ord ROWS UNBOUNDED PRECEDING) AS p, first_value(s IGNORE NULLS) OVER (PARTITION BY station_id, year ORDER BY t_us, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM signs),
roles AS (SELECT *, CASE WHEN v > 0 THEN 'max-flood' WHEN v < 0 THEN 'max-ebb' WHEN kind = 'max' THEN CASE WHEN coalesce(n, p, 0) >= 0 THEN 'max-flood' ELSE 'max-ebb' END WHEN coalesce(n, -p, 0) >= 0 THEN 'slack-to-flood' ELSE 'slack-to-ebb' END AS role FROM near)"""


@query(f"WITH {A.SERIES_SQL}, {ROLES_SQL} SELECT station_id, t_us, role FROM roles")
def current_roles(spark, sf_dir):
    return classify.current_roles(A.current_series(spark, sf_dir)).select("station_id", "t_us", "role")


@query(f"WITH {A.PRIMARIES_SQL}, {A.SECONDARIES_SQL} SELECT sec_id, reference, ref_id FROM res UNION ALL SELECT sec_id, reference, NULL FROM sec WHERE sec_id NOT IN (SELECT sec_id FROM res)")
def ref_resolution(spark, sf_dir):
    found, lost = derive.resolve(A.secondaries(spark, sf_dir), derive.reference_names(A.primaries(spark, sf_dir)))
    return found.select("sec_id", "reference", "ref_id").unionByName(lost.select("sec_id", "reference", F.lit(None).cast("string").alias("ref_id")))


def _resolved(spark, sf_dir) -> DataFrame:
    return derive.resolve(A.secondaries(spark, sf_dir), derive.reference_names(A.primaries(spark, sf_dir)))[0]


def _tide_secondaries(spark, sf_dir) -> DataFrame:
    s = _resolved(spark, sf_dir)
    heights = A.primaries(spark, sf_dir).select(F.col("station_id").alias("ref_id"), "hw_mean", "hw_large", "lw_mean", "lw_large")
    return derive.secondary_tides(s, classify.high_low(A.tide_series(spark, sf_dir), "station_id", "year"), heights)


@query(f"""WITH {A.SERIES_SQL}, {A.PRIMARIES_SQL}, {A.SECONDARIES_SQL}, ref AS (SELECT *, {HILO_SQL} AS hi FROM tide WINDOW w AS (PARTITION BY station_id, year ORDER BY t_us, ord)),
  j AS (SELECT r.*, e.t_us, e.ord, e.v, e.hi, p.hw_mean, p.hw_large, p.lw_mean, p.lw_large FROM res r JOIN prim p ON r.ref_id = p.station_id JOIN ref e ON e.station_id = r.ref_id AND e.year = r.year)
  SELECT sec_id, CASE WHEN hi THEN t_us + hw_us ELSE t_us + lw_us END AS t_us, {R6("CASE WHEN hi THEN v + hw_dh_mean + (v - hw_mean) * CASE WHEN hw_large = hw_mean THEN 0 ELSE (hw_dh_large - hw_dh_mean) / (hw_large - hw_mean) END ELSE v + lw_dh_mean + (v - lw_mean) * CASE WHEN lw_large = lw_mean THEN 0 ELSE (lw_dh_large - lw_dh_mean) / (lw_large - lw_mean) END END")} AS v FROM j""")
def secondary_tides(spark, sf_dir):
    return _tide_secondaries(spark, sf_dir).select("sec_id", "t_us", r6(F.col("v")).alias("v"))


def _current_secondaries(spark, sf_dir) -> DataFrame:
    refs = classify.current_roles(A.current_series(spark, sf_dir)).drop("kind", "user_id")
    return derive.secondary_currents(_resolved(spark, sf_dir).where("not from_tides"), refs)


SECONDARY_CURRENTS_SQL = f"""{A.SERIES_SQL}, {A.PRIMARIES_SQL}, {A.SECONDARIES_SQL}, {ROLES_SQL},
  j AS (SELECT r.sec_id, e.t_us + CASE role WHEN 'slack-to-flood' THEN ttf WHEN 'slack-to-ebb' THEN tte WHEN 'max-flood' THEN fmd ELSE emd END AS t_us, e.ord, role, role LIKE 'max%' AND weak AS weak,
    CASE WHEN role LIKE 'slack%' OR weak THEN 0.0 WHEN role = 'max-flood' THEN coalesce(pct_flood / 100.0 * v, max_flood, 0.0) ELSE coalesce(pct_ebb / 100.0 * v, -max_ebb, 0.0) END AS v, max_flood, max_ebb, fmd IS NULL OR emd IS NULL AS synth
    FROM res r JOIN roles e ON e.station_id = r.ref_id AND e.year = r.year WHERE NOT from_tides AND coalesce(pct_flood, pct_ebb, max_flood, max_ebb) IS NOT NULL),
  shifted AS (SELECT * FROM j WHERE t_us IS NOT NULL),
  nxt AS (SELECT *, lead(role) OVER w AS r2, lead(t_us) OVER w AS t2 FROM shifted WINDOW w AS (PARTITION BY sec_id ORDER BY t_us, ord)),
  mid AS (SELECT sec_id, (t_us + t2) // 2 AS t_us, CASE WHEN role = 'slack-to-flood' THEN max_flood ELSE -max_ebb END AS v, CASE WHEN role = 'slack-to-flood' THEN 'max-flood' ELSE 'max-ebb' END AS role FROM nxt
    WHERE synth AND ((role = 'slack-to-flood' AND r2 = 'slack-to-ebb') OR (role = 'slack-to-ebb' AND r2 = 'slack-to-flood')))"""


@query(f"WITH {SECONDARY_CURRENTS_SQL} SELECT sec_id, t_us, {R6('v')} AS v, weak, role FROM shifted UNION ALL SELECT sec_id, t_us, {R6('v')}, false, role FROM mid WHERE v <> 0")
def secondary_currents(spark, sf_dir):
    return _current_secondaries(spark, sf_dir).select("sec_id", "t_us", r6(F.col("v")).alias("v"), "weak", "role")


@query(f"WITH {SECONDARY_CURRENTS_SQL} SELECT sec_id, role, count(*) AS peaks, min(t_us) AS first_us FROM mid WHERE v <> 0 GROUP BY 1, 2")
def midpoint_peaks(spark, sf_dir):
    made = _current_secondaries(spark, sf_dir).where("ord >= 1000000000000")
    return made.groupBy("sec_id", "role").agg(F.count("*").alias("peaks"), F.min("t_us").alias("first_us"))


@query(f"""WITH {A.PRIMARIES_SQL}, {A.SECONDARIES_SQL} SELECT sec_id, {R6('hw_large + hw_dh_large')} AS high_m, {R6('lw_large + lw_dh_large')} AS low_m,
  {R6("CASE WHEN coalesce(max_flood, max_ebb) IS NOT NULL THEN greatest(abs(coalesce(max_flood, 0)), abs(coalesce(max_ebb, 0))) WHEN coalesce(pct_flood, pct_ebb) IS NOT NULL AND NOT from_tides THEN greatest(coalesce(pct_flood, 0) / 100.0 * abs(ref_flood), coalesce(pct_ebb, 0) / 100.0 * abs(ref_ebb)) END")} AS max_knots FROM res JOIN prim ON ref_id = station_id""")
def display_bounds(spark, sf_dir):
    p = A.primaries(spark, sf_dir).select(F.col("station_id").alias("ref_id"), "hw_large", "lw_large", F.col("max_flood_knots").alias("rf"), F.col("max_ebb_knots").alias("re"))
    rows = _resolved(spark, sf_dir).join(derive.broadcast_if_small(p), "ref_id")
    bound = derive.current_bound(*(F.col(c) for c in ("pct_flood", "pct_ebb", "max_flood_knots", "max_ebb_knots", "rf", "re", "from_tides")))
    return rows.select("sec_id", r6(F.col("hw_large") + F.col("hw_dh_large")).alias("high_m"), r6(F.col("lw_large") + F.col("lw_dh_large")).alias("low_m"), r6(bound).alias("max_knots"))


@query("""SELECT 'chs:' || (c_custkey % 200) AS station_id, arg_max(c_name, k) AS name, arg_max(y, k) AS year, arg_max(r, k) AS kind_rank FROM
  (SELECT c_custkey, c_name, 2024 + c_custkey % 3 AS y, c_nationkey % 6 AS r, (2024 + c_custkey % 3) * 100000000000 + (c_nationkey % 6) * 10000000000 + c_custkey AS k FROM customer) GROUP BY c_custkey % 200""")
def latest_meta(spark, sf_dir):
    k = F.col("c_custkey")
    meta = A.table(spark, sf_dir, "customer").select(merge.namespaced("chs", k % 200).alias("station_id"), F.col("c_name").alias("name"), (2024 + k % 3).alias("year"), (F.col("c_nationkey") % 6).alias("kind_rank"), k.alias("pos"))
    return merge.latest(meta, F.col("kind_rank")).drop("pos")


@query(f"WITH {A.SERIES_SQL}, u AS (SELECT station_id, t_us, year, ord, v FROM tide UNION ALL SELECT station_id, t_us, year, ord, v FROM cur) SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY t_us, year, ord, v) AS n, t_us, {R6('v')} AS v FROM u")
def merged_series(spark, sf_dir):
    from pyspark.sql import Window

    rows = merge.merged(A.tide_series(spark, sf_dir).select("station_id", "t_us", "year", "ord", "v"), A.current_series(spark, sf_dir).select("station_id", "t_us", "year", "ord", "v"))
    n = F.row_number().over(Window.partitionBy("station_id").orderBy("t_us", "year", "ord", "v"))
    return rows.select("station_id", n.cast("long").alias("n"), "t_us", r6(F.col("v")).alias("v"))


@query(f"WITH {A.SERIES_SQL}, u AS (SELECT year, 'tidal_primary' AS kind, t_us FROM tide UNION ALL SELECT year, 'current_primary', t_us FROM cur) SELECT year, kind, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS events FROM u GROUP BY ROLLUP (year, kind)")
def extreme_range_rollup(spark, sf_dir):
    rows = merge.merged(A.tide_series(spark, sf_dir).select("year", "t_us").withColumn("kind", F.lit("tidal_primary")), A.current_series(spark, sf_dir).select("year", "t_us").withColumn("kind", F.lit("current_primary")))
    return merge.extreme_ranges(rows)


@query(f"""WITH {A.SERIES_SQL}, {A.PRIMARIES_SQL}, {A.SECONDARIES_SQL}, ref AS (SELECT *, {HILO_SQL} AS hi FROM tide WINDOW w AS (PARTITION BY station_id, year ORDER BY t_us, ord)),
  made AS (SELECT 'sec:' || sec_id AS station_id, e.year, CASE WHEN hi THEN t_us + hw_us ELSE t_us + lw_us END AS t_us, ord, CASE WHEN hi THEN v + hw_dh_mean + (v - hw_mean) * CASE WHEN hw_large = hw_mean THEN 0 ELSE (hw_dh_large - hw_dh_mean) / (hw_large - hw_mean) END ELSE v + lw_dh_mean + (v - lw_mean) * CASE WHEN lw_large = lw_mean THEN 0 ELSE (lw_dh_large - lw_dh_mean) / (lw_large - lw_mean) END END AS v, false AS weak
    FROM res r JOIN prim p ON r.ref_id = p.station_id JOIN ref e ON e.station_id = r.ref_id AND e.year = r.year),
  ser AS (SELECT station_id, year, t_us, ord, v, weak FROM tide UNION ALL SELECT * FROM made), {A.segments_sql('ser')}, q AS (SELECT DISTINCT station_id, unnest({list(SNAPS)}) AS t_us FROM ser),
  found AS (SELECT q.station_id, q.t_us, CASE WHEN q.t_us <= t2 THEN t1 END AS t1, CASE WHEN q.t_us <= t2 THEN t2 END AS t2, v1, v2 FROM q ASOF LEFT JOIN (SELECT * FROM seg WHERE t1 < t2) seg ON q.station_id = seg.station_id AND q.t_us >= seg.t1)
  SELECT station_id, t_us, CASE WHEN t1 IS NULL THEN NULL ELSE {R6(A.TIDE_VALUE)} END AS value, {A.TIDE_STATE} AS state FROM found""")
def station_states(spark, sf_dir):
    """The whole first workload: references classed, secondaries derived, series merged, states looked up."""
    from . import jobs

    own = A.tide_series(spark, sf_dir)
    ids = own.select("station_id").distinct().unionByName(_resolved(spark, sf_dir).select(F.concat(F.lit("sec:"), F.col("sec_id").cast("string")).alias("station_id")))
    asked = ids.select("station_id", F.explode(F.array(*map(F.lit, SNAPS))).alias("t_us"))
    rows = jobs.tide_states(own, A.primaries(spark, sf_dir), A.secondaries(spark, sf_dir), asked)
    return rows.select("station_id", "t_us", r6(F.col("value")).alias("value"), "state")


@query(f"WITH {A.SERIES_SQL} SELECT station_id, year, {R6('max(v) + 0.3')} AS high_m, {R6('min(v) - 0.3')} AS low_m FROM tide GROUP BY 1, 2")
def service_bounds(spark, sf_dir):
    from ..operators import stations

    rows = stations.service_tide_bounds(A.tide_series(spark, sf_dir))
    return rows.select("station_id", "year", r6(F.col("high_m")).alias("high_m"), r6(F.col("low_m")).alias("low_m"))
