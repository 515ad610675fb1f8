"""Registered queries on whole yearbooks and on the table of current stations, set from the given tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import station_table, yearbook
from ..sources.scratch import written
from . import text_queries as T

Q, SQL = {}, {}
r6 = lambda c: F.round(c, 6) + F.lit(0.0)
R6 = lambda s: f"round({s}, 6) + 0.0"
_s = T._s


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Volumes of eight users and a month: a cover, the contents, a station's pages for each user in turn, then again for its
# currents, at least four. Behind every third tide station and behind currents of fewer pages lie pages without a header,
# which are nobody's. A page's printed number is 3 more.
STATIONS, CONTENTS, FIRST, PRINTED = 8, 2, 4, 3


def _name(user):
    return F.concat(F.lit("PORT "), T._letters(user))


def _line(top: float, *words, x0: float = 30.0):
    """Words of a line, 60 apart."""
    return [F.struct(text.alias("text"), F.lit(x0 + 60.0 * i).alias("x0"), F.lit(top).alias("top")) for i, text in enumerate(words)]


def _placed(rows: DataFrame, words: list) -> DataFrame:
    return rows.select("doc", "page", F.explode(F.array(*words)).alias("w")).select("doc", "page", "w.text", "w.x0", "w.top")


def _volumes(tides: DataFrame, currents: DataFrame) -> DataFrame:
    """All words of all volumes; ``tides`` and ``currents`` have words by user (doc) and sheet (page)."""
    sheets = tides.select("doc", "page").distinct().select(F.lit(0).alias("part"), "doc", "page").unionByName(currents.select("doc", "page").distinct().select(F.lit(1).alias("part"), "doc", "page"))
    user = F.col("user").cast("int")
    sheets = sheets.select("part", F.col("doc").alias("user"), F.col("page").alias("sheet"), F.lit(0).alias("extra"))
    month = F.floor((F.col("sheet") / 10_000).cast("int") - 1)
    last = sheets.groupBy("part", "user", month.alias("_m")).agg(F.max("sheet").alias("sheet")).drop("_m")
    notes = last.where((F.col("part") == 0) & (user % 3 == 0)).withColumn("extra", F.lit(1))
    blank = last.where("part = 1").withColumn("extra", F.explode(F.sequence(F.lit(1), F.lit(yearbook.CURRENT_PAGES))))
    rows = sheets.unionByName(notes).unionByName(blank).withColumn("doc", F.concat(F.lit("vol"), _s(F.floor(user / STATIONS)), F.lit("-"), _s(F.floor(month / 12)), F.lpad(_s(month % 12 + 1), 2, "0")))
    nth = F.row_number().over(Window.partitionBy("doc", "part", "user").orderBy("extra", "sheet"))
    rows = rows.withColumn("_nth", nth).where((F.col("part") == 0) | (F.col("extra") == 0) | (F.col("_nth") <= yearbook.CURRENT_PAGES))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("part", user, "extra", "sheet"))
    rows = written(rows.withColumn("page", (number + FIRST - 1).cast("int")), "sheets")
    mine = rows.where("extra = 0").select("part", "user", "sheet", "doc", "page")
    words = tides.select(F.lit(0).alias("part"), F.col("doc").alias("user"), F.col("page").alias("sheet"), "text", "x0", "top").unionByName(currents.select(F.lit(1).alias("part"), F.col("doc").alias("user"), F.col("page").alias("sheet"), "text", "x0", "top"))
    body = words.join(mine, ["part", "user", "sheet"]).select("doc", "page", "text", "x0", "top")
    year = _s(F.floor(month / 12))
    named = mine.select("doc", "page", "part", user.alias("user"), "sheet")
    tide_head = _placed(named.where("part = 0"), _line(20.0, F.lit("PORT"), T._letters(F.col("user")), F.lit("PST-HNP"), F.lit("(UTC-8)"), year, F.lit("TIDE"), F.lit("TABLES")))
    flow = _line(50.0, *map(F.lit, ("Flood/flot", "direction")), F.lpad(_s(F.col("user") % 360), 3, "0"), *map(F.lit, ("True/vraie", "-", "Ebb/jusant", "direction", "180", "True/vraie")))
    current_head = _placed(named.where("part = 1"), _line(20.0, year) + _line(30.0, F.lit("PORT"), T._letters(F.col("user"))) + _line(40.0, F.lit("PST"), F.lit("(UTC-8h)")) + flow)
    empty = _placed(rows.where("extra > 0"), _line(20.0, F.lit("NOTES"), F.lit("OF"), year))
    first = mine.groupBy("doc", "part", user.alias("user")).agg(F.min("page").alias("first"))
    place = Window.partitionBy("doc").orderBy("part", "user")
    listed = first.select("doc", F.lit(CONTENTS).alias("page"), "user", (F.col("first") + PRINTED).alias("printed"), (80.0 + 30.0 * F.col("part") + 10.0 * F.row_number().over(place)).alias("y"))
    entry = F.array(F.struct(F.lit("PORT").alias("text"), F.lit(90.0).alias("x0")), F.struct(T._letters(F.col("user")).alias("text"), F.lit(130.0).alias("x0")), F.struct(_s(F.col("printed")).alias("text"), F.lit(280.0).alias("x0")))
    entries = listed.select("doc", "page", F.col("y").alias("top"), F.explode(entry).alias("w")).select("doc", "page", "w.text", "w.x0", "top")
    ends = first.where("part = 1").groupBy("doc").agg(F.count("*").alias("n")).join(first.where("part = 0").groupBy("doc").agg(F.count("*").alias("t")), "doc").select("doc", F.lit(CONTENTS).alias("page"), (100.0 + 10.0 * F.col("t")).alias("top"))
    heads = _placed(ends.select("doc", "page"), _line(20.0, F.lit("Table"), F.lit("of"), F.lit("Contents"), x0=50.0) + _line(80.0, F.lit("Tide"), F.lit("Tables"), x0=50.0) + _line(2000.0, F.lit(str(CONTENTS + PRINTED)), x0=400.0))
    second = ends.select("doc", "page", F.explode(F.array(F.struct(F.lit("Current").alias("text"), F.lit(50.0).alias("x0")), F.struct(F.lit("Tables").alias("text"), F.lit(110.0).alias("x0")))).alias("w"), "top").select("doc", "page", "w.text", "w.x0", "top")
    cover = _placed(ends.select("doc", F.lit(1).alias("page")), _line(20.0, F.lit("COVER")))
    out = body
    for more in (tide_head, current_head, empty, entries, heads, second, cover):
        out = out.unionByName(more)
    return out.select("doc", "page", "text", "x0", "top", (F.col("top") + 8).alias("bottom"), F.lit(620.0).alias("page_width"), F.lit(2200.0).alias("page_height"))


def _books(spark, sf_dir) -> DataFrame:
    v = F.col("event_id") % 97
    tide = lambda word: (word(F.date_format("ts", "HH:mm"), 25.0), word(T._tenths(v), 50.0), word(T._tenths(v * 3), 75.0))
    current = lambda word: (word(F.date_format("ts", "HHmm"), 40.0), word(T._tenths(v - 40), 62.0))
    events = written(T._numbered(spark, sf_dir), "numbered-events")
    tides, currents = (written(T._page_words(events, second, cells), "page-words") for second, cells in (("Jour", tide), ("jour", current)))
    return written(_volumes(tides, currents), "book-words")


BOOK_SQL = f"""e AS (SELECT *, 'vol' || (user_id // {STATIONS}) || '-' || strftime(ts, '%Y%m') AS doc, 'PORT ' || translate(lpad(CAST(user_id AS VARCHAR), 6, '0'), '0123456789', 'ABCDEFGHIJ') AS name, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, strftime(ts, '%H:%M') AS time,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS n FROM events)"""


@query(f"WITH {BOOK_SQL} SELECT doc, name, 'PST-HNP' AS timezone, -8 AS utc_offset, year, month, day, time, {R6('(event_id % 97) / CAST(10 AS DOUBLE)')} AS metres FROM e")
def station_readings(spark, sf_dir):
    """Readings with the names of their stations, from contents, headers and pages of volumes."""
    words = _books(spark, sf_dir)
    pages, _ = yearbook.stations_of(words, yearbook.TIDE)
    return yearbook.tide_readings(words, written(pages, "headed-pages")).select("doc", "name", "timezone", "utc_offset", "year", "month", "day", "time", r6(F.col("metres")).alias("metres"))


@query(f"WITH {BOOK_SQL} SELECT doc, name, CAST(user_id % 360 AS INTEGER) AS flood, year, month, day, time, {R6('(event_id % 97 - 40) / CAST(10 AS DOUBLE)')} AS knots FROM e WHERE n < 5 * {yearbook.CURRENT_PAGES}")
def station_events(spark, sf_dir):
    """The same for currents. A current station has four pages in a book, here of five events a day, and a day's later events
    would be on pages that are no longer its own."""
    words = _books(spark, sf_dir)
    pages, _ = yearbook.stations_of(words, yearbook.CURRENT)
    return yearbook.current_events(words, written(pages, "headed-pages")).select("doc", "name", "flood", "year", "month", "day", "time", r6(F.col("knots")).alias("knots"))


LINES, STATION_ROWS = 8, 20  # lines set for a row of the table; rows of a page


def _table_words(spark, sf_dir) -> DataFrame:
    """Pages of twenty stations: two references, then two ports with secondaries, among zones, marks, remarks and headings."""
    k, i = F.col("k"), F.col("k") % STATION_ROWS
    page = F.floor(k / STATION_ROWS).cast("int")
    word = lambda text, x, test=F.lit(True): F.when(test, F.struct(F.lit(float(x)).alias("x0"), text.alias("text")))
    line = lambda test, *words: F.when(test, F.filter(F.array(*words), lambda w: w.isNotNull()))
    text = lambda *parts: [word(p if not isinstance(p, str) else F.lit(p), 72 + 30 * n) for n, p in enumerate(parts)]
    second, inline = i >= 2, (i % 7 == 3) & (i >= 2)
    minutes = F.lpad(_s(k % 60), 2, "0")
    row = [
        word(F.lpad(_s(k % 10_000), 4, "0"), 42), word(F.lit("REACH"), 72), word(_s(k), 100), word(F.lpad(_s(k % 360), 3, "0"), 182), word(_s(48 + k % 5), 212), word(_s(k * 7 % 60), 222), word(_s(123 + k % 4), 236), word(_s(k * 11 % 60), 254),
        word(F.lit("LW"), 276, inline), word(F.concat(F.when(k % 2 == 0, "+").otherwise("-"), _s(k % 10)), 280, second), word(F.concat(minutes, F.when(i % 9 == 1, "(a)").otherwise("")), 295, second),
        word(F.lit("+1"), 320, second & ~inline & (i % 4 != 1)), word(minutes, 335, second & ~inline), word(F.lit("HW"), 359, inline), word(F.lit("0"), 365, second), word(minutes, 380, second),
        word(F.concat(_s(k % 9), F.lit(".5")), 446, i % 3 != 0), word(F.lit("x"), 486, i % 5 == 0), word(_s(k % 100), 515, second),
    ]
    lines = F.array(
        line(i == 2, *text("on/sur", "MAIN", _s(page), ",", "pages", "12-15")[:2], word(F.concat(_s(page), F.lit(",")), 132), word(F.lit("pages"), 162), word(F.lit("12-15"), 192)),
        line(i == 12, word(F.lit("on/sur"), 72), word(F.lit("OTHER,"), 102), word(F.lit("pages"), 132), word(F.lit("3"), 162)),
        line(i % 4 == 2, *text("ZONE", _s(k))), line(i % 6 == 2, word(F.lit("LW"), 300), word(F.lit("HW"), 380)), line(i % 8 == 6, *text("CURRENT", "STATIONS")), line(F.lit(True), *row),
        line(i % 5 == 4, *text("(NOTE", F.concat(_s(k), F.lit(")")))), line(i % 10 == 4, *text("(LATER)")),
    )
    rows = T._customers(spark, sf_dir).select(F.lit("vol").alias("doc"), page.alias("page"), "k", F.posexplode(lines).alias("j", "words")).where("words is not null")
    return rows.select("doc", "page", ((F.col("k") % STATION_ROWS) * LINES * 3.0 + F.col("j") * 3.0 + 0.3).alias("top"), F.explode("words").alias("w")).select("doc", "page", "top", "w.*")


def _t4_sql() -> str:
    two = "lpad(CAST(k % 60 AS VARCHAR), 2, '0')"
    zone = "(i % 4 = 2)"
    tides = "(i >= 2 AND (i % 7 = 3 OR i % 6 = 2))"
    return f"""WITH c AS (SELECT c_custkey AS k, c_custkey % {STATION_ROWS} AS i, c_custkey // {STATION_ROWS} AS p FROM customer)
  SELECT CAST(k % 10000 AS INTEGER) AS index_no, CASE WHEN {tides} AND {zone} THEN 'ZONE ' || k || ' ' ELSE '' END || 'REACH ' || k AS name, CASE WHEN i < 2 THEN 'reference' ELSE 'secondary' END AS role, CAST(k % 360 AS INTEGER) AS flood_direction_true,
  {R6('48 + k % 5 + (k * 7 % 60) / CAST(60 AS DOUBLE)')} AS latitude, {R6('-(123 + k % 4 + (k * 11 % 60) / CAST(60 AS DOUBLE))')} AS longitude, CASE WHEN i >= 12 THEN 'OTHER' WHEN i >= 2 THEN 'MAIN ' || p END AS reference_primary,
  CASE WHEN i >= 2 AND {zone} AND NOT {tides} THEN 'ZONE ' || k END AS geographic_zone, CASE WHEN i >= 2 AND i % 5 = 4 THEN '(NOTE ' || k || ')' END AS name_annotation,
  CASE WHEN i >= 2 THEN CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END || '0' || (k % 10) || ':' || {two} END AS turn_to_flood_diff, CASE WHEN i >= 2 AND i % 7 <> 3 AND i % 4 <> 1 THEN '+01:' || {two} END AS flood_max_diff, CASE WHEN i >= 2 THEN '+00:' || {two} END AS turn_to_ebb_diff,
  CASE WHEN i >= 2 THEN CAST(k % 100 AS INTEGER) END AS pct_ref_flood, CASE WHEN i % 3 <> 0 THEN {R6('k % 9 + CAST(0.5 AS DOUBLE)')} END AS max_flood_knots, {tides} AS offsets_from_tides, i >= 2 AND i % 9 = 1 AS has_footnote FROM c"""


@query(_t4_sql())
def current_station_table(spark, sf_dir):
    """Stations with references above the first port, both kinds of tide reference, zones, remarks and footnotes."""
    found = station_table.current_stations(_table_words(spark, sf_dir))
    numbers = [r6(F.col(c)).alias(c) for c in ("latitude", "longitude", "max_flood_knots")]
    return found.select("index_no", "name", "role", "flood_direction_true", *numbers[:2], "reference_primary", "geographic_zone", "name_annotation", "turn_to_flood_diff", "flood_max_diff", "turn_to_ebb_diff", "pct_ref_flood", numbers[2], "offsets_from_tides", "has_footnote")
