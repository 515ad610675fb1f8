"""Registered queries that write files as the sources have them and read them back, with SQL over the tables behind them.

Files go to folders of their own under ``spark.checkpoint.dir``; many files are written side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, coords, override_file
from ..sources import published_files, readers, writers
from ..sources.scratch import scratch_folder as folder
from ..sources.scratch import written
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


def _s(c):
    return c.cast("string")


def write_texts(rows: DataFrame, path: str) -> None:
    """One file of the lines ``text`` in the order of ``n`` in a folder for each ``volume`` (some thousand lines).

    Dealt out by a hash of the volume: by the volume itself, Spark leaves the exchange out where a union's sides are already
    dealt out by it, and then merges each side's partitions on its own, so a volume would be two files."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that they are not merged: a file costs more than its bytes
    rows = rows.select("volume", "n", "text").repartition(tasks, F.xxhash64("volume")).sortWithinPartitions("volume", "n")
    rows.select("volume", "text").write.partitionBy("volume").text(path)


STATIONS = 50  # stations of a file
STATION = "station_id string, year int, place struct<lat:double>, readings array<struct<time:string,metres:double>>"


def _station_files(spark, sf_dir) -> str:
    """Customers as stations, fifty to a file; every 19th has lost a quote, every 31st has no field that is known."""
    k = F.col("k")
    readings = F.concat(F.lit('[\n        {"time": "01:05", "metres": '), _s(k % 10), F.lit('.5},\n        {"time": "13:45", "metres": '), _s(k % 7), F.lit(".25}\n      ]"))
    known = F.concat(F.lit('      "station_id": "'), _s(k), F.when(k % 19 == 18, "").otherwise('"'), F.lit(',\n      "year": 2026,\n      "place": {"lat": '), _s(45 + k % 5), F.lit('.5},\n      "readings": '), readings)
    body = F.concat(F.lit("    {\n"), F.when(k % 31 == 30, F.lit('      "remark": "{ not a station }"')).otherwise(known), F.lit("\n    }"), F.when(F.col("last"), "").otherwise(","))
    from pyspark.sql import Window

    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    volume = F.floor(k / STATIONS)
    rows = c.withColumn("volume", volume).withColumn("last", F.lead("k").over(Window.partitionBy("volume").orderBy("k")).isNull())
    ends = rows.select("volume").distinct().select("volume", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("n"), F.lit('{\n  "stations": [').alias("text")), F.struct(F.lit(2**62).alias("n"), F.lit("  ]\n}").alias("text")))).alias("e")).select("volume", "e.*")
    path = folder(spark, "station-files")
    write_texts(rows.select("volume", k.cast("long").alias("n"), body.alias("text")).unionByName(ends), path)
    return path


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS station_id, 2026 AS year, CAST(45.5 + c_custkey % 5 AS DOUBLE) AS lat, {R6('c_custkey % 10 + CAST(0.5 AS DOUBLE) + c_custkey % 7 + CAST(0.25 AS DOUBLE)')} AS metres
  FROM customer WHERE c_custkey % 19 <> 18 AND c_custkey % 31 <> 30""")
def station_documents(spark, sf_dir):
    """Stations of many files, each file cut into its stations."""
    rows = readers.stations(spark, _station_files(spark, sf_dir), STATION)
    return rows.select("station_id", "year", "place.lat", r6(F.aggregate("readings", F.lit(0.0), lambda a, x: a + x["metres"])).alias("metres"))


@query("SELECT CAST(c_custkey // 50 AS VARCHAR) AS volume, CASE WHEN c_custkey % 31 = 30 THEN 'empty' ELSE 'malformed' END AS reason, count(*) AS stations FROM customer WHERE c_custkey % 19 = 18 OR c_custkey % 31 = 30 GROUP BY 1, 2")
def rejected_stations(spark, sf_dir):
    """What could not be read of those files, by reason."""
    rows = readers.rejected_stations(spark, _station_files(spark, sf_dir), STATION)
    return rows.groupBy(F.regexp_extract("file", r"volume=(\d+)", 1).alias("volume"), "reason").agg(F.count("*").alias("stations"))


def _payload_files(spark, sf_dir) -> str:
    """Payloads of suppliers, a folder each by the name that a payload has: tides and currents, errors and broken files."""
    k = F.col("k")
    s = A.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).cast("int").alias("k"), F.col("s_suppkey").alias("n"))
    items = s.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list("n")), lambda n: F.concat(F.lit('{"t": "2026-01-01 00:10", "v": "'), _s(n), F.lit('"}'))), ", ").alias("items"))
    name = F.when(k % 3 == 0, F.concat(F.lit("current_"), _s(k), F.lit("_bin"), _s(k % 5), F.lit(".json"))).otherwise(F.concat(F.lit("tide_"), _s(k), F.lit(".json")))
    tide = F.concat(F.lit('{"predictions": ['), F.col("items"), F.lit("]}"))
    text = F.when(k % 10 == 7, F.concat(F.lit('{"error": {"message": "no '), _s(k), F.lit('"}}'))).when(k % 10 == 8, F.lit("{}")).when(k % 10 == 9, F.substring(tide, F.lit(1), F.length(tide) - 3))
    text = text.when(k % 3 == 0, F.lit('{"current_predictions": {"cp": [{"Time": "2026-01-01 00:10", "Type": "slack"}]}}')).otherwise(tide)
    path = folder(spark, "payload-files")
    items.select(name.alias("payload"), text.alias("text")).repartition("payload").write.partitionBy("payload").text(path)
    return path


PAYLOADS_SQL = "p AS (SELECT CAST(s_suppkey % 60 AS INTEGER) AS k, count(*) AS n, sum(s_suppkey) AS total FROM supplier GROUP BY 1)"


@query(f"WITH {PAYLOADS_SQL} SELECT CASE WHEN k % 3 = 0 THEN 'current' ELSE 'tide' END AS kind, CAST(k AS VARCHAR) AS id, CASE WHEN k % 3 = 0 THEN k % 5 END AS bin, CASE WHEN k % 3 = 0 THEN 1 ELSE n END AS events, CASE WHEN k % 3 <> 0 THEN total END AS total FROM p WHERE k % 10 < 7")
def raw_payloads(spark, sf_dir):
    """Payloads that can be used, with kind, id and bin from their names."""
    good, _ = readers.split_errors(readers.payloads(spark, _payload_files(spark, sf_dir)))
    total = F.aggregate("predictions", F.lit(0).cast("long"), lambda a, x: a + x["v"].cast("long"))
    return good.select("kind", "id", "bin", F.coalesce(F.size(F.nullif("predictions", F.lit(None))), F.size("cp")).cast("long").alias("events"), total.alias("total"))


@query(f"WITH {PAYLOADS_SQL} SELECT CASE WHEN k % 3 = 0 THEN 'current' ELSE 'tide' END AS kind, CAST(k AS VARCHAR) AS id, CASE k % 10 WHEN 7 THEN 'error' WHEN 8 THEN 'no predictions' ELSE 'malformed' END AS reason, CASE WHEN k % 10 = 7 THEN 'no ' || k END AS message FROM p WHERE k % 10 >= 7")
def rejected_payloads(spark, sf_dir):
    """The others, with the reason."""
    _, bad = readers.split_errors(readers.payloads(spark, _payload_files(spark, sf_dir)))
    return bad.select("kind", "id", "reason", "message")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS kind, count(*) AS n, sum(o_custkey) AS customers FROM orders GROUP BY 1, 2")
def written_stations(spark, sf_dir):
    """Tables by year and kind, one year written a second time in place of the first."""
    path = folder(spark, "stations-by-kind")
    o = A.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("kind"), "o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"))
    writers.write_stations(o.withColumn("o_custkey", F.when(F.col("year") == 1995, F.lit(0).cast("long")).otherwise(F.col("o_custkey"))), path)
    writers.write_stations(o.where("year = 1995"), path)
    return spark.read.parquet(path).groupBy("year", "kind").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))


# Override files of a hundred customers each: 20 entries above any block, then blocks of nulls, of the neighbours and of
# seeded ones, and in every other file one more block of five behind.
REMARK = 'seeded from the listing; "do not edit"'


def _override_entries(spark, sf_dir) -> DataFrame:
    """volume, at and body of every entry."""
    k, j = F.col("k"), F.col("k") % 100
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("volume", F.floor(k / 100))
    lat, lon = 45 + k % 400 / 100 + F.when(k % 4 == 1, 0.25).otherwise(0.0), -125 + k * 7 % 350 / 100
    value = F.when((j >= 20) & (j < 30), F.lit("null")).otherwise(F.concat(F.lit("[\n    "), override_file.number_text(lon), F.lit(",\n    "), override_file.number_text(lat), F.lit("\n  ]")))
    own = c.where((j < 70) | ((j < 75) & (F.col("volume") % 2 == 0))).select("volume", j.cast("double").alias("at"), F.concat(F.lit('  "'), _s(k), F.lit('": '), value).alias("body"))
    names = {block: key for key, block in override_file.BLOCKS.items()}
    remarks = [(-1.0, "_format"), (19.5, names["csv_wrong"]), (29.5, names["us"]), (39.5, names["iwls"]), (69.5, names["manual"])]
    heads = F.explode(F.array(*(F.struct(F.lit(at).alias("at"), F.lit(f'  "{key}": "of {key}: 8\\u00b0"').alias("body")) for at, key in remarks))).alias("e")
    every = c.select("volume").distinct().select("volume", heads).select("volume", "e.*").where("at <> 69.5 or volume % 2 = 0")
    return own.unionByName(every)


def _override_lines(spark, sf_dir) -> DataFrame:
    """Those files, written and read back as lines, each file opened once however often the lines are used."""
    from pyspark.sql import Window

    rows = _override_entries(spark, sf_dir).withColumn("last", F.lead("at").over(Window.partitionBy("volume").orderBy("at")).isNull())
    rows = rows.select("volume", "at", F.concat(F.when(F.col("at") == -1, "{\n").otherwise(""), F.col("body"), F.when(F.col("last"), "\n}").otherwise(",")).alias("text"))
    path = folder(spark, "override-files")
    write_texts(rows.withColumnRenamed("at", "n"), path)
    return written(override_file.read_lines(spark, path).withColumn("file", F.regexp_extract("file", r"volume=(\d+)", 1)), "override-lines")


BLOCK_SQL = "CASE WHEN j < 20 THEN 'manual' WHEN j < 30 THEN 'csv_wrong' WHEN j < 40 THEN 'us' WHEN j < 70 THEN 'iwls' WHEN j < 75 AND f % 2 = 0 THEN 'manual' END"
OVER_SQL = f"""c AS (SELECT c_custkey AS k, c_custkey // 100 AS f, c_custkey % 100 AS j, round(45 + (c_custkey % 400) / CAST(100 AS DOUBLE), 6) AS ulat, round(-125 + (c_custkey * 7 % 350) / CAST(100 AS DOUBLE), 6) AS ulon FROM customer),
  b AS (SELECT *, {BLOCK_SQL} AS block, CASE WHEN j BETWEEN 20 AND 29 THEN NULL ELSE round(ulat + CASE WHEN k % 4 = 1 THEN CAST(0.25 AS DOUBLE) ELSE 0 END, 6) END AS lat, CASE WHEN j BETWEEN 20 AND 29 THEN NULL ELSE ulon END AS lon FROM c),
  s AS (SELECT *, CASE WHEN k % 6 = 5 THEN CASE WHEN block = 'iwls' THEN 'removed_no_station' END WHEN block <> 'iwls' THEN 'skipped_manual' WHEN k % 7 = 6 THEN CASE WHEN block = 'iwls' THEN 'removed_no_source' ELSE 'no_action' END
    WHEN block = 'iwls' THEN CASE WHEN lat = ulat AND lon = ulon THEN 'no_change' ELSE 'refreshed' END ELSE 'added' END AS action FROM b)"""


def _synced(spark, sf_dir, lines: DataFrame) -> DataFrame:
    """The sync of all files; each customer's number belongs to one of them."""
    k = F.col("k")
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("int").alias("index_no"), (45 + F.col("c_custkey") % 400 / 100).alias("lat"), (-125 + F.col("c_custkey") * 7 % 350 / 100).alias("lon"))
    found = coords.sync(c.where(k % 6 != 5), c.where(k % 7 != 6), override_file.current(lines).drop("file"))
    return found.withColumn("file", _s(F.floor(F.col("index_no") / 100)))


@query(f"WITH {OVER_SQL} SELECT CAST(f AS VARCHAR) AS file, CAST(k AS INTEGER) AS index_no, block FROM b WHERE block IS NOT NULL")
def override_provenance(spark, sf_dir):
    """The block of each key of written files."""
    return override_file.provenance(_override_lines(spark, sf_dir))


@query(f"WITH {OVER_SQL} SELECT CAST(k AS INTEGER) AS index_no, lat, lon FROM b WHERE block IS NOT NULL")
def override_values(spark, sf_dir):
    """The values of written files, read as objects."""
    from pyspark.sql import Window

    rows = _override_entries(spark, sf_dir).withColumn("last", F.lead("at").over(Window.partitionBy("volume").orderBy("at")).isNull())
    path = folder(spark, "override-files")
    write_texts(rows.select("volume", F.col("at").alias("n"), F.concat(F.when(F.col("at") == -1, "{\n").otherwise(""), F.col("body"), F.when(F.col("last"), "\n}").otherwise(",")).alias("text")), path)
    return readers.overrides(spark, path).select("index_no", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


@query("SELECT DISTINCT CAST(s_suppkey * 3 AS INTEGER) AS index_no FROM supplier WHERE s_suppkey % 10 <> 9")
def suppressed_numbers(spark, sf_dir):
    """Lists of suppressed numbers in files, some of them texts, some no numbers at all."""
    k = F.col("s_suppkey")
    item = F.when(k % 10 == 9, F.concat(F.lit('"x'), _s(k), F.lit('"'))).when(k % 10 == 8, F.concat(F.lit('"'), _s(k * 3), F.lit('"'))).otherwise(_s(k * 3))
    rows = A.table(spark, sf_dir, "supplier").groupBy(F.floor(k / 25).alias("volume")).agg(F.array_join(F.collect_list(item), ", ").alias("items"))
    path = folder(spark, "suppressed")
    write_texts(rows.select("volume", F.lit(0).alias("n"), F.concat(F.lit('{"_suppress_index_nos": ['), F.col("items"), F.lit('], "1": null}')).alias("text")), path)
    return readers.suppressed(spark, path)


@query(f"WITH {OVER_SQL} SELECT CAST(k AS INTEGER) AS index_no, action, CASE WHEN action IN ('added', 'refreshed') THEN ulat WHEN action IN ('no_change', 'skipped_manual') THEN lat END AS lat, CASE WHEN action IN ('added', 'refreshed') THEN ulon WHEN action IN ('no_change', 'skipped_manual') THEN lon END AS lon FROM s WHERE action IS NOT NULL")
def override_actions(spark, sf_dir):
    """From the text of override files to what a re-seeding does to each station."""
    found = _synced(spark, sf_dir, _override_lines(spark, sf_dir))
    return found.select("index_no", "action", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


NUMBER_SQL = lambda x: f"regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\\.$', '.0')"
ENTRY_SQL = lambda lat, lon: f"""'  "' || k || '": ' || CASE WHEN {lat} IS NULL THEN 'null' ELSE '[' || chr(10) || '    ' || {NUMBER_SQL(lon)} || ',' || chr(10) || '    ' || {NUMBER_SQL(lat)} || chr(10) || '  ]' END"""
REMARKS_SQL = "VALUES (-1.0, '_format'), (19.5, '_block_pdf_correct_csv_wrong'), (29.5, '_block_us_cross_border'), (39.5, '_block_iwls_seeded'), (69.5, '_block_pdf_wrong_replaced_with_chs_official')"


@query(f"""WITH {OVER_SQL},
  rows AS (SELECT f, CAST(j AS DOUBLE) AS place, 0 AS then_, {ENTRY_SQL('lat', 'lon')} AS body FROM b WHERE block IS NOT NULL AND block <> 'iwls'
    UNION ALL SELECT f, place, 0, CASE WHEN key = '_block_iwls_seeded' THEN '  "_block_iwls_seeded": "seeded from the listing; \\"do not edit\\""' ELSE '  "' || key || '": "of ' || key || ': 8\\u00b0"' END FROM (SELECT DISTINCT f FROM c), ({REMARKS_SQL}) r(place, key) WHERE place <> 69.5 OR f % 2 = 0
    UNION ALL SELECT f, CASE WHEN f % 2 = 0 THEN 69.25 ELSE 80 END, k, {ENTRY_SQL("CASE WHEN action = 'no_change' THEN lat ELSE ulat END", "CASE WHEN action = 'no_change' THEN lon ELSE ulon END")} FROM s WHERE action IN ('added', 'refreshed', 'no_change')),
  n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY place, then_) AS n, count(*) OVER (PARTITION BY f) AS many FROM rows),
  t AS (SELECT f, '{{' || chr(10) || string_agg(body, ',' || chr(10) ORDER BY n) || chr(10) || '}}' AS text FROM n GROUP BY f)
  SELECT CAST(f AS VARCHAR) AS file, i - 1 AS line, string_split(text, chr(10))[i] AS text FROM t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)""")
def override_rewrite(spark, sf_dir):
    """The lines of those files after a re-seeding."""
    lines = _override_lines(spark, sf_dir)
    return override_file.rewritten(lines, _synced(spark, sf_dir, lines), REMARK).select("file", F.col("line").cast("long").alias("line"), "text")


@query(f"SELECT count(*) AS anomalies, count(*) > 0 AS stopped FROM ({D.SQL['drift_tides']})")
def drift_gate(spark, sf_dir):
    """Whether the gate stops a job for the drift of the tide picks, and the anomalies that it goes by."""
    drift = catalog.tide_drift(D._picks(spark, sf_dir), D._catalog(spark, sf_dir))
    try:
        n, stopped = catalog.gate(drift), False
    except RuntimeError:
        n, stopped = catalog.gate(drift, force=True), True
    return spark.range(1).select(F.lit(n).cast("long").alias("anomalies"), F.lit(stopped).alias("stopped"))


TIMES_SQL = "o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(left(o_orderpriority, 1) AS INTEGER) AS p, o_orderkey % 1440 AS clock, o_orderdate FROM orders)"
KINDS = published_files.STEMS


def _published_folder(spark, sf_dir) -> str:
    """A published file a year and priority, a station each with a reading or an event an order; and files that are none: names
    without a mark, with a wrong one, of an unknown kind, which have an instant far off."""
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"), p.alias("p")).withColumn("at", F.col("o_orderkey") % 1440)
    time = F.concat(F.lpad(_s(F.floor(F.col("at") / 60)), 2, "0"), F.lit(":"), F.lpad(_s(F.col("at") % 60), 2, "0"))
    days = o.groupBy(F.year("date").alias("year"), "p", F.month("date").alias("month"), F.day("date").alias("day")).agg(F.collect_list(F.struct(time.alias("time"))).alias("e"))
    tide = F.col("p") % 2 == 1
    day = F.struct("month", "day", F.when(tide, F.col("e")).alias("readings"), F.when(~tide, F.col("e")).alias("events"))
    files = days.groupBy("year", "p").agg(F.collect_list(day).alias("days"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("p"))
    name = lambda mark: F.concat(kind, F.lit("."), mark, F.lit(".json"))
    mark = F.substring(F.sha2(F.concat(_s(F.col("year")), _s(F.col("p"))), 256), 1, 8)
    doc = F.to_json(F.struct(F.array(F.struct(F.col("year"), F.lit(-8).alias("utc_offset"), "days"), F.struct(F.col("year"), F.lit(None).cast("int").alias("utc_offset"), "days")).alias("stations")))
    good = files.select("year", name(mark).alias("name"), doc.alias("text"))
    far = F.lit('{"stations": [{"year": 1900, "utc_offset": 0, "days": [{"month": 1, "day": 1, "readings": [{"time": "00:00"}]}]}]}')
    stray = F.explode(F.array(F.concat(kind, F.lit(".json")), name(F.upper(F.lit("0a1b2c3d"))), F.lit("unknown.0a1b2c3d.json"), name(F.lit("0a1b2c3")))).alias("name")
    path = folder(spark, "published")
    good.unionByName(files.where("p = 1").select("year", stray, far.alias("text"))).repartition("year", "name").write.partitionBy("year", "name").text(path)
    return path


ISO_SQL = lambda f: f"strftime({f}(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(clock + 480)), '%Y-%m-%dT%H:%M:00Z')"


@query(f"""WITH {TIMES_SQL} SELECT year, {', '.join(f"max(CASE WHEN p = {i + 1} THEN year || '/{k}.' || left(sha256(CAST(year AS VARCHAR) || p), 8) || '.json' END) AS {k}" for i, k in enumerate(KINDS))}, {ISO_SQL('min')} AS first_extreme_utc, {ISO_SQL('max')} AS last_extreme_utc FROM o GROUP BY year""")
def folder_manifest(spark, sf_dir):
    """The manifest of a folder, from its listing and its files."""
    return published_files.folder_manifest(spark, _published_folder(spark, sf_dir))
