"""Registered queries on station dimensions, catalogs, payloads and publication, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decimals
from ..operators import catalog, coords, normalise, profile, publish, reconcile
from . import adapters as A

Q, SQL = {}, {}
r6 = lambda c: F.round(c, 6) + F.lit(0.0)
R6 = lambda s: f"round({s}, 6) + 0.0"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _customer(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))


def stations(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    kind = F.when(k % 3 == 0, "tidal_primary").when(k % 3 == 1, "tidal_secondary").otherwise("current_primary")
    lat = F.when(k % 59 != 58, 45 + k % 400 / 100)
    return _customer(spark, sf_dir).select(F.when(k % 101 != 100, k.cast("int")).alias("index_no"), k.alias("row"), F.col("c_name").alias("name"), kind.alias("kind"), lat.alias("lat"), (-125 + k * 7 % 350 / 100).alias("lon"))


def _text(value, places):
    whole = F.floor(value / 10_000).cast("string")
    return F.concat(whole, F.when(places > 0, F.concat(F.lit("."), F.substring(F.lpad((value % 10_000).cast("string"), 4, "0"), F.lit(1), places))).otherwise(""))


def inventory(spark, sf_dir) -> DataFrame:
    """Coordinates off by up to some kilometres, as text cut to 0 to 4 decimals; every fourth is missing."""
    k = F.col("k")
    places = (k % 5).cast("int")
    lat = _text(450_000 + k % 400 * 100 + k % 9 * 60, places)
    lon = F.concat(F.lit("-"), _text(1_250_000 - k * 7 % 350 * 100, places))
    rows = _customer(spark, sf_dir).where(k % 4 != 3).select(k.cast("int").alias("index_no"), lat.alias("a"), lon.alias("b"))
    return rows.select("index_no", F.col("a").cast("double").alias("lat"), F.col("b").cast("double").alias("lon"), F.least(decimals(F.col("a")), decimals(F.col("b"))).alias("decimals"))


def overrides(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    value = k % 11 == 0
    rows = _customer(spark, sf_dir).where(value | (k % 13 == 0))
    return rows.select(k.cast("int").alias("index_no"), F.when(value, 45.05 + k % 400 / 100).alias("lat"), F.when(value, -125.05 + k * 7 % 350 / 100).alias("lon"))


def suppressed(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    return _customer(spark, sf_dir).where(k % 97 == 0).select(k.cast("int").alias("index_no"))


def _resolved(spark, sf_dir) -> DataFrame:
    s = coords.suppress(stations(spark, sf_dir), suppressed(spark, sf_dir))
    return coords.resolve(s, inventory(spark, sf_dir), overrides(spark, sf_dir))


HAVERSINE = "2 * 6371000.0 * asin(sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))"
TXT = lambda v: f"(({v}) // 10000) || CASE WHEN c_custkey % 5 > 0 THEN '.' || substr(lpad(CAST(({v}) % 10000 AS VARCHAR), 4, '0'), 1, CAST(c_custkey % 5 AS INTEGER)) ELSE '' END"
PICK = lambda c: f"CASE coord_source WHEN 'override' THEN o{c} WHEN 'csv' THEN c{c} ELSE {c} END"
COORD_SQL = f"""st AS (SELECT CASE WHEN c_custkey % 101 <> 100 THEN c_custkey END AS index_no, c_custkey AS row, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'tidal_primary' WHEN 1 THEN 'tidal_secondary' ELSE 'current_primary' END AS kind,
   CASE WHEN c_custkey % 59 <> 58 THEN 45 + (c_custkey % 400) / CAST(100 AS DOUBLE) END AS lat, -125 + (c_custkey * 7 % 350) / CAST(100 AS DOUBLE) AS lon FROM customer),
 inv AS (SELECT c_custkey AS index_no, CAST({TXT('450000 + c_custkey % 400 * 100 + c_custkey % 9 * 60')} AS DOUBLE) AS clat, CAST('-' || {TXT('1250000 - c_custkey * 7 % 350 * 100')} AS DOUBLE) AS clon, CAST(c_custkey % 5 AS INTEGER) AS decimals FROM customer WHERE c_custkey % 4 <> 3),
 ov AS (SELECT c_custkey AS index_no, CASE WHEN c_custkey % 11 = 0 THEN CAST(45.05 AS DOUBLE) + (c_custkey % 400) / CAST(100 AS DOUBLE) END AS olat, CASE WHEN c_custkey % 11 = 0 THEN CAST(-125.05 AS DOUBLE) + (c_custkey * 7 % 350) / CAST(100 AS DOUBLE) END AS olon, true AS o FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 13 = 0),
 kept AS (SELECT * FROM st WHERE index_no IS NULL OR index_no % 97 <> 0),
 j AS (SELECT kept.*, inv.clat, inv.clon, inv.decimals, ov.olat, ov.olon, o, index_no IS NOT NULL AND lat IS NOT NULL AS whole, {HAVERSINE} AS d FROM kept LEFT JOIN inv USING (index_no) LEFT JOIN ov USING (index_no)),
 res AS (SELECT *, CASE WHEN NOT whole THEN 'kept' WHEN o AND olat IS NOT NULL THEN 'override' WHEN o THEN 'verified' WHEN decimals >= 3 AND d <= 2000 THEN 'csv' ELSE 'kept' END AS coord_source,
   coalesce(whole AND o IS NULL AND ((decimals >= 3 AND d > 2000) OR d > 5000), false) AS flagged FROM j)"""


@query(f"WITH {COORD_SQL} SELECT row, CAST(index_no AS INTEGER) AS index_no, {R6(PICK('lat'))} AS lat, {R6(PICK('lon'))} AS lon, coord_source FROM res")
def coord_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir).select("row", "index_no", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "coord_source")


@query(f"WITH {COORD_SQL} SELECT CAST(index_no AS INTEGER) AS index_no, name, round(d, 3) AS offset_m, decimals FROM res WHERE flagged")
def coord_flags(spark, sf_dir):
    return coords.flags(_resolved(spark, sf_dir)).select("index_no", "name", F.round("offset_m", 3).alias("offset_m"), "decimals")


@query(f"""WITH {COORD_SQL}, c AS (SELECT kind, count(*) AS stations, count_if(coord_source = 'override') AS overridden, count_if(coord_source = 'csv') AS csv, count_if(coord_source IN ('kept', 'verified')) AS kept FROM res GROUP BY ROLLUP (kind)),
  b AS (SELECT kind, count(*) AS n FROM st GROUP BY ROLLUP (kind)) SELECT c.*, n - stations AS suppressed FROM c JOIN b ON c.kind IS NOT DISTINCT FROM b.kind""")
def coord_summary_rollup(spark, sf_dir):
    return coords.outcome_counts(_resolved(spark, sf_dir), stations(spark, sf_dir))


@query("""WITH roster AS (SELECT DISTINCT c_custkey AS n FROM customer WHERE c_custkey % 6 <> 5), up AS (SELECT c_custkey AS n, round(45 + (c_custkey % 400) / CAST(100 AS DOUBLE), 6) AS ulat, round(-125 + (c_custkey * 7 % 350) / CAST(100 AS DOUBLE), 6) AS ulon FROM customer WHERE c_custkey % 7 <> 6),
  cur AS (SELECT c_custkey AS n, 45 + (c_custkey % 400) / CAST(100 AS DOUBLE) + CASE WHEN c_custkey % 4 = 1 THEN CAST(0.25 AS DOUBLE) ELSE 0 END AS lat, -125 + (c_custkey * 7 % 350) / CAST(100 AS DOUBLE) AS lon, CASE WHEN c_custkey % 5 = 0 THEN 'manual' WHEN c_custkey % 5 = 1 THEN 'us' ELSE 'iwls' END AS block FROM customer WHERE c_custkey % 3 <> 0),
  j AS (SELECT coalesce(roster.n, cur.n) AS n, roster.n AS r, block, round(lat, 6) AS lat, round(lon, 6) AS lon, up.n AS u, ulat, ulon FROM roster FULL JOIN cur ON roster.n = cur.n LEFT JOIN up ON up.n = coalesce(roster.n, cur.n)),
  a AS (SELECT *, CASE WHEN r IS NULL THEN CASE WHEN block = 'iwls' THEN 'removed_no_station' END WHEN block IN ('manual', 'us') THEN 'skipped_manual' WHEN u IS NULL THEN CASE WHEN block = 'iwls' THEN 'removed_no_source' ELSE 'no_action' END
    WHEN block = 'iwls' THEN CASE WHEN lat = ulat AND lon = ulon THEN 'no_change' ELSE 'refreshed' END ELSE 'added' END AS action FROM j)
  SELECT CAST(n AS INTEGER) AS index_no, action, CASE WHEN action IN ('added', 'refreshed') THEN ulat WHEN action IN ('no_change', 'skipped_manual') THEN lat END AS lat, CASE WHEN action IN ('added', 'refreshed') THEN ulon WHEN action IN ('no_change', 'skipped_manual') THEN lon END AS lon FROM a WHERE action IS NOT NULL""")
def override_sync(spark, sf_dir):
    k = F.col("k")
    c = _customer(spark, sf_dir).select(k, k.cast("int").alias("index_no"), (45 + k % 400 / 100).alias("lat"), (-125 + k * 7 % 350 / 100).alias("lon"))
    current = c.where(k % 3 != 0).select("index_no", F.round(F.col("lat") + F.when(k % 4 == 1, 0.25).otherwise(0.0), 6).alias("lat"), F.round("lon", 6).alias("lon"), F.when(k % 5 == 0, "manual").when(k % 5 == 1, "us").otherwise("iwls").alias("block"))
    return coords.sync(c.where(k % 6 != 5), c.where(k % 7 != 6), current)


# Catalogs: suppliers and parts


def _catalog(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    s = A.table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))
    return s.select(
        (k % 120).cast("string").alias("id"), k.alias("pos"), F.concat("s_name", F.when(k % 10 == 3, ", 0.6 mi. NE of").otherwise("")).alias("name"), F.when(k % 2 == 0, "WA").otherwise("OR").alias("state"),
        (45 + k % 400 / 100).alias("lat"), (-125 + k * 7 % 350 / 100).alias("lng"), F.when(k % 3 == 0, "S").otherwise("R").alias("type"), (k % 17).cast("string").alias("reference_id"), (k % 3).cast("int").alias("currbin"), (k % 5 * 1.5).cast("double").alias("depth"),
    )


CATALOG_SQL = """cat AS (SELECT CAST(s_suppkey % 120 AS VARCHAR) AS id, s_suppkey AS pos, s_name || CASE WHEN s_suppkey % 10 = 3 THEN ', 0.6 mi. NE of' ELSE '' END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'WA' ELSE 'OR' END AS state,
  45 + (s_suppkey % 400) / CAST(100 AS DOUBLE) AS lat, -125 + (s_suppkey * 7 % 350) / CAST(100 AS DOUBLE) AS lng, CASE WHEN s_suppkey % 3 = 0 THEN 'S' ELSE 'R' END AS type, CAST(s_suppkey % 17 AS VARCHAR) AS reference_id, CAST(s_suppkey % 3 AS INTEGER) AS currbin, CAST(s_suppkey % 5 * 1.5 AS DOUBLE) AS depth FROM supplier)"""


def _picks(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    c = _customer(spark, sf_dir)
    name = F.concat(F.lit("  supplier#"), F.lpad((k % 120).cast("string"), 9, "0"))
    return c.select(
        F.when(k % 23 != 22, (k % 120).cast("string")).alias("id"), k.alias("pos"), F.when(k % 4 == 0, name).otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("placename"),
        F.when(k % 3 == 0, "S").when(k % 3 == 1, "R").alias("type"), F.when(k % 2 == 0, (k % 19).cast("string")).otherwise("").alias("reference_id"), (k % 4).cast("int").alias("bin"), (k % 3 == 0).alias("secondary"), F.when(k % 2 == 0, "tide").otherwise("current").alias("kind"),
    )


PICKS_SQL = """picks AS (SELECT CASE WHEN c_custkey % 23 <> 22 THEN CAST(c_custkey % 120 AS VARCHAR) END AS id, c_custkey AS pos, CASE WHEN c_custkey % 4 = 0 THEN '  supplier#' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0') ELSE c_name END AS name, c_mktsegment AS placename,
  CASE c_custkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'R' END AS type, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 19 AS VARCHAR) ELSE '' END AS reference_id, CAST(c_custkey % 4 AS INTEGER) AS bin, c_custkey % 3 = 0 AS secondary, CASE WHEN c_custkey % 2 = 0 THEN 'tide' ELSE 'current' END AS kind FROM customer)"""
FIRST_PICK = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM picks) WHERE n = 1)"


@query(f"WITH {CATALOG_SQL}, r AS (SELECT * FROM cat WHERE lat BETWEEN 45.5 AND 49.0 AND lng BETWEEN -125.0 AND -121.5) SELECT (SELECT count(*) FROM r) AS region_rows, (SELECT count(DISTINCT id) FROM r) AS ids, (SELECT count(*) FROM cat) AS total UNION ALL SELECT (SELECT count(*) FROM cat WHERE state = 'WA'), (SELECT count(DISTINCT id) FROM cat WHERE state = 'WA'), (SELECT count(*) FROM cat)")
def catalog_region(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return catalog.region_counts(c, catalog.current_region(c)).unionByName(catalog.region_counts(c, catalog.tide_region(c)))


RULES = [("ones", [["1"], ["supplier"]]), ("two or three", [["2", "3"], ["000"]]), ("none", [["xyz"]]), ("offset", [["mi."], ["ne", "sw"]])]
RULES_SQL = "rules AS (SELECT 'ones' AS label, [['1'], ['supplier']] AS groups UNION ALL SELECT 'two or three', [['2', '3'], ['000']] UNION ALL SELECT 'none', [['xyz']] UNION ALL SELECT 'offset', [['mi.'], ['ne', 'sw']])"
FITS = "len(list_filter(groups, lambda g: len(list_filter(g, lambda w: contains(lower(name), w))) > 0)) = len(groups)"


def _rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "label string, groups array<array<string>>")


@query(f"WITH {CATALOG_SQL}, {RULES_SQL}, one AS (SELECT id, arg_max(name, pos) AS name FROM cat GROUP BY id) SELECT label, id, name FROM rules LEFT JOIN one ON {FITS}")
def keyword_match(spark, sf_dir):
    return catalog.keyword_match(catalog.one_per_id(_catalog(spark, sf_dir), last=True), _rules(spark)).select("label", "id", "name")


@query(f"WITH {CATALOG_SQL}, {RULES_SQL}, one AS (SELECT id, arg_min(name, pos) AS name, arg_min(type, pos) AS type, array_to_string(list_sort(list(DISTINCT currbin)), ',') AS bins, array_to_string(list_sort(list(DISTINCT CAST(depth * 10 AS INTEGER))), ',') AS depths FROM cat GROUP BY id) SELECT label, id, name, type, bins, depths FROM rules LEFT JOIN one ON {FITS}")
def keyword_match_bins(spark, sf_dir):
    found = catalog.keyword_match(catalog.one_per_id(_catalog(spark, sf_dir), last=False), _rules(spark))
    text = lambda c, f: F.array_join(F.transform(c, lambda x: f(x).cast("string")), ",")
    return found.select("label", "id", "name", "type", text("bins", lambda x: x).alias("bins"), text("depths", lambda x: (x * 10).cast("int")).alias("depths"))


@query(f"""WITH {CATALOG_SQL}, {PICKS_SQL}, live AS (SELECT id, arg_max(name, pos) AS lname, arg_max(reference_id, pos) AS lref, arg_max(type, pos) AS ltype FROM cat GROUP BY id), j AS (SELECT p.*, lname, lref, ltype, live.id IS NOT NULL AS here FROM {FIRST_PICK} p LEFT JOIN live ON p.id = live.id)
  SELECT id, placename, 'missing' AS kind, name AS recorded, NULL AS live FROM j WHERE NOT here UNION ALL SELECT id, placename, 'name_change', name, lname FROM j WHERE here AND lower(trim(name)) <> lower(trim(lname))
  UNION ALL SELECT id, placename, 'reference_change', reference_id, lref FROM j WHERE here AND reference_id <> '' AND lref <> '' AND reference_id <> lref UNION ALL SELECT id, placename, 'type_change', type, ltype FROM j WHERE here AND type <> ltype""")
def drift_tides(spark, sf_dir):
    return catalog.tide_drift(_picks(spark, sf_dir), _catalog(spark, sf_dir))


@query(f"""WITH {CATALOG_SQL}, {PICKS_SQL}, live AS (SELECT id, arg_min(name, pos) AS lname, arg_min(type, pos) AS ltype, list_sort(list(DISTINCT currbin)) AS bins FROM cat GROUP BY id), j AS (SELECT p.*, lname, ltype, bins, live.id IS NOT NULL AS here FROM picks p LEFT JOIN live ON p.id = live.id WHERE p.id IS NOT NULL)
  SELECT id, placename, 'missing' AS kind, name AS recorded, NULL AS live FROM j WHERE NOT here UNION ALL SELECT id, placename, 'name_change', name, lname FROM j WHERE here AND lower(trim(name)) <> lower(trim(lname))
  UNION ALL SELECT id, placename, 'bin_missing', CAST(bin AS VARCHAR), array_to_string(bins, ',') FROM j WHERE here AND NOT list_contains(bins, bin) UNION ALL SELECT id, placename, 'type_change', type, ltype FROM j WHERE here AND type <> ltype""")
def drift_currents(spark, sf_dir):
    return catalog.current_drift(_picks(spark, sf_dir), _catalog(spark, sf_dir))


@query(f"WITH {CATALOG_SQL}, one AS (SELECT id, arg_min(lat, pos) AS lat, arg_min(lng, pos) AS lon, arg_min(lat, pos) + CASE WHEN CAST(id AS INTEGER) % 4 = 0 THEN CAST(0.01 AS DOUBLE) WHEN CAST(id AS INTEGER) % 4 = 1 THEN CAST(0.0005 AS DOUBLE) ELSE 0 END AS clat, arg_min(lng, pos) AS clon FROM cat GROUP BY id) SELECT id, {R6(f'{HAVERSINE} / 1000')} AS moved_km FROM one WHERE {HAVERSINE} > 100")
def moved_stations(spark, sf_dir):
    one = catalog.one_per_id(_catalog(spark, sf_dir), last=False).select("id", "lat", "lng")
    n = F.col("id").cast("int") % 4
    after = one.withColumn("lat", F.col("lat") + F.when(n == 0, 0.01).when(n == 1, 0.0005).otherwise(0.0))
    return catalog.moved(one, after).select("id", r6(F.col("moved_km")).alias("moved_km"))


@query(f"WITH {PICKS_SQL} SELECT 'tide' AS kind, id, pos, CAST(NULL AS INTEGER) AS bin FROM {FIRST_PICK} UNION ALL SELECT 'current', id, pos, bin FROM (SELECT *, row_number() OVER (PARTITION BY id, bin ORDER BY pos) AS n FROM picks WHERE id IS NOT NULL) WHERE n = 1")
def pick_dedup(spark, sf_dir):
    p = _picks(spark, sf_dir)
    tides = normalise.tide_picks(p).select(F.lit("tide").alias("kind"), "id", "pos", F.lit(None).cast("int").alias("bin"))
    return tides.unionByName(normalise.current_picks(p).select(F.lit("current").alias("kind"), "id", "pos", "bin"))


@query(f"""WITH {CATALOG_SQL}, {PICKS_SQL}, l AS (SELECT id, arg_max(name, pos) AS cname, arg_max(lat, pos) AS lat, arg_max(lng, pos) AS lng FROM cat GROUP BY id), j AS (SELECT p.id, p.pos, coalesce(cname, name) AS name, lat, lng FROM {FIRST_PICK} p LEFT JOIN l ON p.id = l.id)
  SELECT id, pos, name, CASE WHEN pos % 7 = 0 AND pos % 14 <> 0 THEN 'Short ' || pos WHEN name LIKE '%, 0.6 mi%' THEN split_part(name, ',', 1) ELSE name END AS display_name, CASE WHEN name LIKE '%, 0.6 mi%' THEN split_part(name, ',', 1) ELSE name END AS station_name, {R6('lat')} AS lat, {R6('lng')} AS lng FROM j""")
def catalog_enrich(spark, sf_dir):
    """Every seventh pick has a short name of its own, every fourteenth an empty one."""
    picks = _picks(spark, sf_dir).withColumn("short_name", F.when(F.col("pos") % 14 == 0, "").when(F.col("pos") % 7 == 0, F.concat(F.lit("Short "), F.col("pos").cast("string"))))
    rows = normalise.enrich(normalise.tide_picks(picks), _catalog(spark, sf_dir), last=True, short="short_name")
    return rows.select("id", "pos", "name", "display_name", "station_name", r6(F.col("lat")).alias("lat"), r6(F.col("lng")).alias("lng"))


@query(f"WITH {CATALOG_SQL}, {PICKS_SQL} SELECT DISTINCT p.id, p.bin FROM picks p WHERE p.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cat c WHERE c.id = p.id AND c.currbin = p.bin)")
def missing_payloads(spark, sf_dir):
    landed = _catalog(spark, sf_dir).select("id", F.col("currbin").alias("bin"))
    return normalise.missing(_picks(spark, sf_dir).where("id is not null"), landed, ["id", "bin"])


@query(f"WITH {PICKS_SQL} SELECT kind, count_if(secondary) AS secondaries, count_if(NOT secondary) AS primaries FROM picks GROUP BY kind")
def pick_summary(spark, sf_dir):
    return normalise.summary(_picks(spark, sf_dir))


# Payloads: events as they come from a prediction service, one a station, day and sheet of event numbers, in that order


def _payload_seq():
    return F.unix_date(F.to_date("ts")).cast("long") * 1_000_000 + F.floor(F.col("event_id") / A.SHEET)


def _tide_payloads(spark, sf_dir) -> DataFrame:
    e = A.table(spark, sf_dir, "events").withColumn("t", F.date_format("ts", "yyyy-MM-dd HH:mm"))
    item = F.struct("event_id", "t", F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("v"))
    return e.groupBy(F.col("user_id").cast("string").alias("id"), _payload_seq().alias("seq")).agg(F.sort_array(F.collect_list(item)).alias("p")).select("id", "seq", F.transform("p", lambda x: F.struct(x["t"].alias("t"), x["v"].alias("v"))).alias("predictions"))


@query("SELECT CAST(user_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time, CAST(CASE WHEN event_id % 50 <> 0 THEN event_id END AS DOUBLE) AS metres, -8 AS utc_offset FROM events")
def normalise_payload_tides(spark, sf_dir):
    return normalise.tide_rows(_tide_payloads(spark, sf_dir)).select("id", "date", "time", "metres", "utc_offset")


def _current_payloads(spark, sf_dir) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    item = F.struct(
        n, F.date_format("ts", "yyyy-MM-dd HH:mm").alias("Time"), F.when(kind == "purchase", -F.col("value") / 50).otherwise(F.col("value") / 50).alias("Velocity_Major"), F.when(kind == "view", "slack").when(kind == "purchase", "ebb").otherwise("flood").alias("Type"),
        F.when((n % 7 == 0) & (F.col("user_id") % 3 != 0), (n % 360).cast("double")).alias("meanFloodDir"), (n % 180).cast("double").alias("meanEbbDir"),
    )
    return e.groupBy(F.col("user_id").cast("string").alias("id"), (F.col("user_id") % 4).cast("int").alias("bin"), _payload_seq().alias("seq")).agg(F.sort_array(F.collect_list(item)).alias("p")).select("id", "bin", "seq", F.transform("p", lambda x: x.dropFields("event_id")).alias("cp"))


@query(f"""WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN -value / 50 ELSE value / 50 END AS vel FROM events),
  a AS (SELECT user_id, max(CASE WHEN event_type <> 'view' AND vel > 0 THEN vel END) AS f, max(CASE WHEN event_type <> 'view' AND vel < 0 THEN -vel END) AS b, arg_max(event_id % 180, (CAST(ts AS DATE), event_id)) AS last_ebb, arg_min(event_id, (CAST(ts AS DATE), event_id)) FILTER (WHERE event_id % 7 = 0 AND user_id % 3 <> 0) AS first_id FROM e GROUP BY user_id)
  SELECT CAST(user_id AS VARCHAR) AS id, CAST(user_id % 4 AS INTEGER) AS bin, {R6('nullif(f, 0)')} AS max_flood_knots, {R6('nullif(b, 0)')} AS max_ebb_knots, CAST(first_id % 360 AS DOUBLE) AS flood_dir, CAST(coalesce(first_id % 180, last_ebb) AS DOUBLE) AS ebb_dir FROM a""")
def normalise_payload_currents(spark, sf_dir):
    rows = normalise.current_station(normalise.current_rows(_current_payloads(spark, sf_dir)))
    return rows.select("id", "bin", r6(F.col("max_flood_knots")).alias("max_flood_knots"), r6(F.col("max_ebb_knots")).alias("max_ebb_knots"), "flood_dir", "ebb_dir")


@query("SELECT CAST(user_id AS VARCHAR) AS id, CAST(ts AS DATE)::VARCHAR AS date, strftime(ts, '%a') AS weekday, count(*) AS entries, CAST(arg_min(CASE WHEN event_id % 50 <> 0 THEN event_id END, event_id) AS DOUBLE) AS first_metres FROM (SELECT *, event_id AS e FROM events) GROUP BY 1, 2, 3")
def day_nesting_counts(spark, sf_dir):
    """Days nested and opened again."""
    nested = normalise.nest_days(normalise.tide_rows(_tide_payloads(spark, sf_dir)), ["id"], ["time", "metres"])
    d = nested.select("id", F.explode("days").alias("d"))
    first = F.get(F.filter(F.transform("d.readings", lambda x: x["metres"]), lambda x: x.isNotNull()), F.lit(0))
    return d.select("id", F.col("d.date").alias("date"), F.col("d.weekday").alias("weekday"), F.size("d.readings").cast("long").alias("entries"), first.alias("first_metres"))


# Profile, reconciliation, publication


@query("""WITH loc AS (SELECT *, ts - INTERVAL 8 HOUR AS l FROM events), docs AS (SELECT DISTINCT user_id, year(l) AS y, month(l) AS m, event_id // 1000000 AS s FROM loc), days AS (SELECT DISTINCT user_id, year(l) AS y, month(l) AS m, day(l) AS d, event_id // 1000000 AS s FROM loc),
  cells AS (SELECT 'station' AS level, 'station_id' AS field, CAST(user_id AS VARCHAR) AS value FROM docs UNION ALL SELECT 'station', 'year', CAST(y AS VARCHAR) FROM docs UNION ALL SELECT 'station', 'utc_offset', '-8' FROM docs
   UNION ALL SELECT 'day', 'month', CAST(m AS VARCHAR) FROM days UNION ALL SELECT 'day', 'day', CAST(d AS VARCHAR) FROM days
   UNION ALL SELECT 'event', 'time', strftime(l, '%H:%M') FROM loc UNION ALL SELECT 'event', 'kind', CASE WHEN event_type = 'view' THEN 'slack' ELSE 'max' END FROM loc UNION ALL SELECT 'event', 'weak_variable', CAST(event_type = 'error' AS VARCHAR) FROM loc
   UNION ALL SELECT 'event', 'knots', CAST(CAST(round(CASE WHEN event_type = 'purchase' THEN -value / 50 ELSE value / 50 END * 10) AS BIGINT) AS VARCHAR) FROM loc),
  n AS (SELECT 'station' AS level, count(*) AS objects FROM docs UNION ALL SELECT 'day', count(*) FROM days UNION ALL SELECT 'event', count(*) FROM loc),
  c AS (SELECT level, field, value, count(*) AS cnt, row_number() OVER (PARTITION BY level, field ORDER BY count(*) DESC, value) AS r FROM cells GROUP BY 1, 2, 3)
  SELECT level, field, round(max(cnt) / CAST(any_value(objects) AS DOUBLE), 6) + 0.0 AS share, count(*) AS n_values, string_agg(value || '=' || cnt, '|' ORDER BY r) FILTER (WHERE r <= 3) AS top3, CASE WHEN max(cnt) / any_value(objects) >= 0.95 THEN '★' WHEN max(cnt) / any_value(objects) >= 0.8 THEN '○' ELSE '' END AS tag FROM c JOIN n USING (level) GROUP BY 1, 2""")
def field_profile(spark, sf_dir):
    """Documents with speeds in tenths of a knot, which every engine prints alike."""
    tenth = lambda e: e.withField("knots", F.round(e["knots"] * 10).cast("long"))
    days = F.transform("days", lambda d: d.withField("events", F.transform(d["events"], tenth)))
    values, totals = profile.levels(A.current_documents(spark, sf_dir).withColumn("days", days), "events")
    rows = profile.profile(values, totals)
    return rows.withColumn("share", r6(F.col("share")))


@query("""WITH loc AS (SELECT *, ts - INTERVAL 8 HOUR AS l FROM events), cells AS (SELECT 'time' AS field, strftime(l, '%H:%M') AS value FROM loc UNION ALL SELECT 'kind', CASE WHEN event_type = 'view' THEN 'slack' ELSE 'max' END FROM loc UNION ALL SELECT 'weak_variable', CAST(event_type = 'error' AS VARCHAR) FROM loc)
  SELECT field, CAST(sum(n) AS BIGINT) AS present, max(n) AS top, count(*) AS counted FROM (SELECT field, value, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY field""")
def field_sketches(spark, sf_dir):
    """Frequent values of the events' fields by sketches of each station, merged twice; with fewer values than a sketch holds, its
    counts are exact."""
    docs = A.current_documents(spark, sf_dir)
    events = docs.select("station_id", "year", F.explode("days").alias("d")).select("station_id", "year", F.explode("d.events").alias("e")).select("station_id", "year", "e.time", "e.kind", "e.weak_variable")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("time", "kind", "weak_variable")))
    values = events.select("station_id", "year", F.lit("event").alias("level"), F.explode(fields).alias("x")).select("station_id", "year", "level", "x.*")
    merged = profile.merged_sketches(profile.merged_sketches(profile.sketches(values, ["station_id", "year"]), ["year"]), [])
    found = profile.sketched_profile(merged, [], k=5_000)
    return found.select("field", "present", F.array_max(F.transform("top", lambda x: x["count"])).alias("top"), F.size("top").cast("long").alias("counted"))


def _extracts(spark, sf_dir):
    k = F.col("k")
    p = A.table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    expected = p.select(k, F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.when(k % 3 == 0, F.col("p_brand")).alias("brand"))
    actual = p.where(k % 37 != 36).select(
        k, F.when(k % 11 == 0, F.concat(F.lit("x"), "p_name")).otherwise(F.concat("p_name", F.lit(" (suffix)"))).alias("name"), F.when(k % 13 == 0, F.col("p_size") + 1).when(k % 29 == 0, F.lit(None)).otherwise(F.col("p_size")).alias("size"),
        F.when(k % 17 == 0, F.col("p_retailprice") + 0.01).when(k % 19 == 0, F.col("p_retailprice") + 1e-8).when(k % 31 == 0, F.lit(None)).otherwise(F.col("p_retailprice")).alias("price"), F.when(k % 15 == 0, F.lit("other")).otherwise(F.col("p_brand")).alias("brand"),
    )
    return expected, actual, reconcile.differences(expected, actual, "k", exact=["size"], floats=["price"], prefixes=["name"], conditional=["brand"])


RECON_SQL = """d AS (SELECT p_partkey AS k, '*' AS field FROM part WHERE p_partkey % 37 = 36 UNION ALL
  SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey % 13 = 0 OR p_partkey % 29 = 0 THEN 'size' END, CASE WHEN p_partkey % 17 = 0 OR (p_partkey % 31 = 0 AND p_partkey % 19 <> 0) THEN 'price' END, CASE WHEN p_partkey % 11 = 0 THEN 'name' END, CASE WHEN p_partkey % 15 = 0 AND p_partkey % 3 = 0 THEN 'brand' END], lambda x: x IS NOT NULL)) FROM part WHERE p_partkey % 37 <> 36)"""


@query(f"WITH {RECON_SQL} SELECT k, field FROM d")
def reconcile_fields(spark, sf_dir):
    return _extracts(spark, sf_dir)[2].select("k", "field")


@query(f"WITH {RECON_SQL} SELECT 'part' AS table_name, count(*) - (SELECT count(DISTINCT k) FROM d) AS ok, count(*) AS total FROM part")
def reconcile_summary(spark, sf_dir):
    expected, _, diffs = _extracts(spark, sf_dir)
    return reconcile.summary("part", expected, diffs, "k")


@query("""SELECT CAST(user_id AS VARCHAR) AS station_id, y AS year, m AS month, d AS day, count(*) AS events, count_if(event_type = 'error') AS weak, count_if(event_type = 'view') AS slacks FROM
  (SELECT *, CAST(year(l) AS INTEGER) AS y, CAST(month(l) AS INTEGER) AS m, CAST(day(l) AS INTEGER) AS d FROM (SELECT *, ts - INTERVAL 8 HOUR AS l FROM events)) GROUP BY 1, 2, 3, 4, event_id // 1000000""")
def publish_projection(spark, sf_dir):
    """Documents pruned for publication; weak_variable is left where it is true."""
    docs = publish.strip(A.current_documents(spark, sf_dir).withColumn("note", F.lit("dropped")), "current_primary")
    rows = docs.select("station_id", "year", F.explode("days").alias("d"))
    count = lambda f: F.size(F.filter("d.events", f)).cast("long")
    return rows.select("station_id", "year", F.col("d.month").alias("month"), F.col("d.day").alias("day"), F.size("d.events").cast("long").alias("events"), count(lambda e: e["weak_variable"].isNotNull()).alias("weak"), count(lambda e: e["kind"] == "slack").alias("slacks"))


FINGER_SQL = f"""h AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS kind, sha256(concat_ws('|', o_orderkey, o_custkey, coalesce(o_orderstatus, '~'))) AS h FROM orders),
  f AS (SELECT year, kind, left(sha256(concat_ws(',', count(*), {', '.join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT))" for i in range(4))})), 8) AS fingerprint FROM h GROUP BY year, kind)"""


def _fingerprints(spark, sf_dir) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").withColumns({"year": F.year("o_orderdate"), "kind": F.col("o_orderpriority")})
    return publish.fingerprint(o, ["year", "kind"], "o_orderkey", "o_custkey", "o_orderstatus")


@query(f"WITH {FINGER_SQL} SELECT * FROM f")
def fingerprint(spark, sf_dir):
    return _fingerprints(spark, sf_dir)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH {FINGER_SQL}, r AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, min(epoch_us(o_orderdate)) AS first_us, max(epoch_us(o_orderdate)) AS last_us FROM orders GROUP BY 1)
  SELECT f.year, {', '.join(f"max(CASE WHEN kind = '{p}' THEN f.year || '/' || kind || '.' || fingerprint END) AS {'p' + p[0]}" for p in PRIORITIES)}, any_value(first_us) AS first_us, any_value(last_us) AS last_us FROM f JOIN r ON f.year = r.year GROUP BY f.year""")
def manifest(spark, sf_dir):
    from ..functions.timeutil import micros

    made = _fingerprints(spark, sf_dir).withColumn("path", F.concat(F.col("year").cast("string"), F.lit("/"), "kind", F.lit("."), "fingerprint"))
    o = A.table(spark, sf_dir, "orders")
    ranges = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.min(micros(F.col("o_orderdate"))).alias("first_us"), F.max(micros(F.col("o_orderdate"))).alias("last_us"))
    return publish.manifest(made, ranges, PRIORITIES).withColumnsRenamed({p: "p" + p[0] for p in PRIORITIES})


@query("""WITH s AS (SELECT c_custkey AS row, CASE c_custkey % 4 WHEN 0 THEN 'tide-primary' WHEN 1 THEN 'tide-secondary' WHEN 2 THEN 'current-primary' ELSE 'current-secondary' END AS kind, c_custkey % 7 = 0 AS us, c_custkey % 59 <> 58 AS located FROM customer),
  v AS (SELECT *, kind LIKE '%-secondary' OR us AS secondary FROM s)
  SELECT zoom, kind, count_if(located AND (NOT secondary OR zoom >= CASE WHEN kind LIKE 'tide%' THEN 9 ELSE 8 END)) AS shown, count_if(located) AS located FROM v, (VALUES (7), (8), (9)) z(zoom) GROUP BY 1, 2""")
def visible_stations(spark, sf_dir):
    """Stations shown at three zoom levels, of those that have coordinates."""
    from ..operators import stations as rules

    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ("tide-primary", "tide-secondary", "current-primary", "current-secondary"))), (k % 4 + 1).cast("int"))
    located, _ = rules.split_located(stations(spark, sf_dir).withColumn("k", F.col("row")).withColumn("kind", kind).withColumn("us_secondary", k % 7 == 0))
    totals = located.groupBy("kind").agg(F.count("*").alias("located"))
    shown = None
    for zoom in (7, 8, 9):
        part = rules.visible(located, zoom).groupBy("kind").agg(F.count("*").alias("shown")).withColumn("zoom", F.lit(zoom))
        shown = part if shown is None else shown.unionByName(part)
    every = totals.crossJoin(F.broadcast(spark.createDataFrame([(z,) for z in (7, 8, 9)], "zoom int")))  # three rows
    return every.join(shown, ["kind", "zoom"], "left").select("zoom", "kind", F.coalesce("shown", F.lit(0)).alias("shown"), "located")


@query(f"WITH {PICKS_SQL} SELECT DISTINCT id, bin FROM picks WHERE id IS NOT NULL")
def refreshed_payloads(spark, sf_dir):
    """The work list of a refresh: every pick, whatever has landed."""
    landed = _catalog(spark, sf_dir).select("id", F.col("currbin").alias("bin"))
    return normalise.missing(_picks(spark, sf_dir).where("id is not null"), landed, ["id", "bin"], refresh=True)


@query(f"""WITH {CATALOG_SQL}, {PICKS_SQL}, live AS (SELECT id, arg_max(name, pos) AS lname, arg_max(reference_id, pos) AS lref, arg_max(type, pos) AS ltype FROM cat WHERE CAST(id AS INTEGER) % 3 <> 0 GROUP BY id),
  direct AS (SELECT id, arg_max(name, pos) AS dname, arg_max(reference_id, pos) AS dref, arg_max(type, pos) AS dtype FROM cat WHERE CAST(id AS INTEGER) % 3 = 0 GROUP BY id),
  j AS (SELECT p.*, coalesce(lname, dname) AS lname, coalesce(lref, dref) AS lref, coalesce(ltype, dtype) AS ltype, live.id IS NOT NULL OR direct.id IS NOT NULL AS here FROM {FIRST_PICK} p LEFT JOIN live ON p.id = live.id LEFT JOIN direct ON p.id = direct.id)
  SELECT kind, count(*) AS anomalies FROM (SELECT 'missing' AS kind FROM j WHERE NOT here UNION ALL SELECT 'name_change' FROM j WHERE here AND lower(trim(name)) <> lower(trim(lname))
  UNION ALL SELECT 'reference_change' FROM j WHERE here AND reference_id <> '' AND lref <> '' AND reference_id <> lref UNION ALL SELECT 'type_change' FROM j WHERE here AND type <> ltype) GROUP BY kind""")
def drift_with_fallback(spark, sf_dir):
    """Drift where a third of the ids is only known to a direct lookup; the gate lets it pass by force."""
    whole = _catalog(spark, sf_dir)
    here = F.col("id").cast("int") % 3 == 0
    direct = catalog.one_per_id(whole.where(here), last=True)
    found = catalog.tide_drift(_picks(spark, sf_dir), whole.where(~here), direct)
    return found.groupBy("kind").agg(F.count("*").alias("anomalies"))


@query("SELECT CAST(c_custkey AS INTEGER) AS index_no, round(45 + (c_custkey % 400) / CAST(100 AS DOUBLE), 6) + 0.0 AS lat, round(-125 + (c_custkey * 7 % 350) / CAST(100 AS DOUBLE), 6) + 0.0 AS lon FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 11 <> 10")
def upstream_stations(spark, sf_dir):
    """Of a listing, the stations with a number for a code and with coordinates."""
    k = F.col("k")
    code = F.when(k % 5 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.lpad(k.cast("string"), 6, "0"))
    listing = _customer(spark, sf_dir).select(code.alias("code"), F.when(k % 11 != 10, 45 + k % 400 / 100).alias("lat"), (-125 + k * 7 % 350 / 100).alias("lon"))
    return coords.upstream_stations(listing).select("index_no", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


@query("SELECT kind, array_to_string(list_sort(list(DISTINCT c_custkey % 7)), ',') AS present FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'tidal_secondary' WHEN 1 THEN 'current_secondary' WHEN 2 THEN 'noaa_tidal_primary' ELSE 'noaa_current_primary' END AS kind FROM customer) GROUP BY kind")
def publish_kinds(spark, sf_dir):
    """Stations of the kinds without a yearbook of their own, pruned; the fields left are as allowed, and hold their rows."""
    k, out = F.col("k"), None
    every = sorted({f for fields in publish.STATION_FIELDS.values() for f in fields} - {"days"})
    for i, kind in enumerate(("tidal_secondary", "current_secondary", "noaa_tidal_primary", "noaa_current_primary")):
        docs = publish.strip(_customer(spark, sf_dir).where(k % 4 == i).select(*((k % 7).alias(f) for f in every), F.lit(1).alias("timezone")), kind)
        assert set(docs.columns) == set(publish.STATION_FIELDS[kind]) - {"days"}
        rows = docs.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.array(*docs.columns))).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_set("n")).cast("array<string>"), ",").alias("present"))
