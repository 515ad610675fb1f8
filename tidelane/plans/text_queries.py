"""Registered queries on page lines and page words, which are set from the given tables; their SQL reads the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_footnote, time_diff
from ..operators import extract_lines, extract_words, station_table
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


def _customers(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


def _s(c):
    return c.cast("string")


def _letters(k):
    return F.translate(F.lpad(_s(k), 6, "0"), "0123456789", "ABCDEFGHIJ")


LETTERS_SQL = "translate(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '0123456789', 'ABCDEFGHIJ')"


def _port_text(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    text = F.concat(F.lit("  PORT "), _letters(k), F.lit(" "), F.lpad(_s(k % 10_000), 4, "0"), F.lit(" - 8 "), _s(45 + k % 5), F.lit(" "), _s(k % 60), F.lit(" 1"), _s(20 + k % 6), F.lit(" "), _s(k * 7 % 60), F.lit(" MSD "), _s(k % 4), F.lit(" ."), _s(k % 10), F.lit(" "), _s(k % 7), F.lit(". "), _s(k % 9))
    return _customers(spark, sf_dir).select(F.concat(F.lit("vol"), _s(F.floor(k / 500))).alias("doc"), F.floor(k / 50).cast("int").alias("page"), k.alias("line"), F.when(k % 17 == 16, "heading only").otherwise(text).alias("text"))


@query(f"""SELECT 'vol' || (c_custkey // 500) AS doc, 'PORT ' || {LETTERS_SQL} AS name, CAST(c_custkey % 10000 AS INTEGER) AS index_no, -8 AS utc_offset, {R6('45 + c_custkey % 5 + (c_custkey % 60) / CAST(60 AS DOUBLE)')} AS latitude, {R6('-(120 + c_custkey % 6 + (c_custkey * 7 % 60) / CAST(60 AS DOUBLE))')} AS longitude,
  'MSD' AS tide_type, {R6('c_custkey % 4 + (c_custkey % 10) / CAST(10 AS DOUBLE)')} AS mean_tide_range, {R6('c_custkey % 7 + (c_custkey % 9) / CAST(10 AS DOUBLE)')} AS large_tide_range FROM customer WHERE c_custkey % 17 <> 16""")
def port_lines(spark, sf_dir):
    rows = extract_lines.port_lines(_port_text(spark, sf_dir))
    return rows.select("doc", "name", "index_no", "utc_offset", *(r6(F.col(c)).alias(c) for c in ("latitude", "longitude")), "tide_type", *(r6(F.col(c)).alias(c) for c in ("mean_tide_range", "large_tide_range")))


def _tenths(v):
    return F.concat(F.when(v < 0, "-").otherwise(""), _s(F.floor(F.abs(v) / 10)), F.lit("."), _s(F.abs(v) % 10))


@query(f"SELECT 'PORT ' || {LETTERS_SQL} AS name, {', '.join(f'{R6(f'((c_custkey * {i + 3} % 90) - 20) / CAST(10 AS DOUBLE)')} AS {c}' for i, c in enumerate(extract_lines.HEIGHT_FIELDS))} FROM customer")
def height_lines(spark, sf_dir):
    k = F.col("k")
    values = F.concat_ws(" ", *(_tenths(k * (i + 3) % 90 - 20) for i in range(7)))
    lines = _customers(spark, sf_dir).select(F.lit("vol").alias("doc"), k.alias("line"), F.concat(F.lit("PORT "), _letters(k), F.lit(" "), F.when(k % 5 == 0, F.regexp_replace(values, r"\.", " .")).otherwise(values)).alias("text"))
    return extract_lines.height_lines(lines).select("name", *(r6(F.col(c)).alias(c) for c in extract_lines.HEIGHT_FIELDS))


def _shift(m, joined):
    a = F.abs(m)
    return F.concat(F.when(m < 0, "-").otherwise("+"), _s(F.floor(a / 60)), F.when(joined, "").otherwise(" "), F.lpad(_s(a % 60), 2, "0"))


def _secondary_text(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    block = F.floor(k / 50)
    row = F.concat(
        F.lpad(_s(k % 10_000), 4, "0"), F.lit(" Place "), _letters(k), F.lit(" - 8 48 "), _s(k % 60), F.lit(" 123 "), _s(k * 3 % 60), F.lit(" "), _shift(k * 7 % 200 - 100, k % 9 == 0), F.lit(" "), _tenths(k % 30 - 9), F.when(k % 8 == 0, "*").otherwise(""), F.lit(" "), _tenths(k % 40), F.lit(" "),
        _shift(k * 11 % 150 - 75, F.lit(False)), F.lit(" "), _tenths(k % 20 - 10), F.lit(" "), _tenths(k % 25), F.lit(" "), _tenths(k % 35), F.lit(" "), _tenths(k % 45), F.lit(" "), _tenths(k % 33),
    )
    head, zone = k % 50 == 0, k % 10 == 0
    lines = F.array(
        F.when(head, F.concat(F.lit("AREA "), _s(block % 7 + 1))), F.when(head, F.concat(F.lit("COAST "), _s(block))), F.when(head, F.lit("SHORE")), F.when(head, F.lit("SECONDARY PORTS TABLE 3")), F.when(head, F.concat(F.lit("on/sur REF "), _s(block % 20), F.lit(", pages 12-15"))),
        F.when(zone, F.concat(F.lit("ZONE "), _s(F.floor(k / 10)))), F.when(k % 20 == 0, F.lit("PART TWO")), row, F.when(k % 50 == 49, F.lit("* footnote")), F.when(k % 50 == 49, F.lit("more of it")),
    )
    rows = _customers(spark, sf_dir).select(F.concat(F.lit("vol"), _s(F.floor(k / 500))).alias("doc"), block.cast("int").alias("page"), "k", F.posexplode(lines).alias("i", "text"))
    return rows.where("text is not null").select("doc", "page", (F.col("k") * 10 + F.col("i")).alias("line"), "text")


SHIFT_SQL = lambda m: f"(CASE WHEN {m} < 0 THEN '-' ELSE '+' END || lpad(CAST(abs({m}) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs({m}) % 60 AS VARCHAR), 2, '0'))"


@query(f"""SELECT CAST(c_custkey % 10000 AS INTEGER) AS index_no, 'Place ' || {LETTERS_SQL} AS name, {R6('48 + (c_custkey % 60) / CAST(60 AS DOUBLE)')} AS latitude, CAST((c_custkey // 50) % 7 + 1 AS INTEGER) AS area_number,
  'COAST ' || CASE WHEN c_custkey // 50 - 7 < c_custkey // 500 * 10 THEN c_custkey // 50 ELSE c_custkey // 50 - 7 END || ' SHORE' AS area_name, 'ZONE ' || (c_custkey // 10) || CASE WHEN c_custkey // 10 % 2 = 0 THEN ' PART TWO' ELSE '' END AS geographic_zone,
  'REF ' || ((c_custkey // 50) % 20) AS reference_port, {SHIFT_SQL('(c_custkey * 7 % 200 - 100)')} AS higher_high_water_time_diff, {SHIFT_SQL('(c_custkey * 11 % 150 - 75)')} AS lower_low_water_time_diff,
  {R6('(c_custkey % 30 - 9) / CAST(10 AS DOUBLE)')} AS higher_high_water_mean_tide_diff, {R6('(c_custkey % 33) / CAST(10 AS DOUBLE)')} AS mean_water_level, c_custkey % 8 = 0 AS has_footnote FROM customer""")
def secondary_port_lines(spark, sf_dir):
    rows = extract_lines.secondary_port_lines(_secondary_text(spark, sf_dir))
    return rows.select("index_no", "name", r6(F.col("latitude")).alias("latitude"), "area_number", "area_name", "geographic_zone", "reference_port", "higher_high_water_time_diff", "lower_low_water_time_diff", *(r6(F.col(c)).alias(c) for c in ("higher_high_water_mean_tide_diff", "mean_water_level")), "has_footnote")


@query(f"SELECT c_custkey AS k, CASE WHEN c_custkey % 13 <> 12 THEN {SHIFT_SQL('(c_custkey * 7 % 1400 - 700)')} END AS diff, c_custkey % 4 = 0 AS footnote FROM customer")
def time_diff_norm(spark, sf_dir):
    k = F.col("k")
    raw = F.concat(F.when(k % 13 == 12, "n/a ").otherwise(""), _shift(k * 7 % 1400 - 700, F.lit(False)), F.when(k % 8 == 0, "*").when(k % 8 == 4, "(a)").otherwise(""))
    return _customers(spark, sf_dir).select("k", time_diff(raw).alias("diff"), has_footnote(raw).alias("footnote"))


@query("SELECT p_brand AS doc, CAST(p_partkey // 30 AS INTEGER) AS page, regexp_replace(p_name, ' +', ' ', 'g') AS text FROM part")
def word_rows(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    words = p.select(F.col("p_brand").alias("doc"), F.floor(F.col("p_partkey") / 30).cast("int").alias("page"), F.col("p_partkey").alias("k"), F.posexplode(F.split("p_name", " +")).alias("i", "text"))
    placed = words.select("doc", "page", "text", (F.col("i") * 40.0).alias("x0"), (F.col("k") % 30 * 12.0 + F.col("i") % 3 * 0.9).alias("top"))
    return extract_words.word_rows(placed).select("doc", "page", "text")


@query("SELECT CAST(c_custkey // 40 AS INTEGER) AS page, CAST(c_custkey % 40 * 12 AS INTEGER) AS row_top, unnest(['index', 'name', 'flood_dir', 'turn_flood', 'pct_ebb']) AS cell, unnest([lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), 'REACH ' || c_custkey, CAST(c_custkey % 360 AS VARCHAR), '+1 ' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0'), CAST(c_custkey % 100 AS VARCHAR)]) AS text FROM customer")
def table4_buckets(spark, sf_dir):
    k = F.col("k")
    words = F.array(*(F.struct(t.alias("text"), F.lit(float(x)).alias("x0")) for t, x in ((_s(k), 95), (F.lit("REACH"), 71), (F.lpad(_s(k % 10_000), 4, "0"), 41), (_s(k % 360), 207), (F.lpad(_s(k % 60), 2, "0"), 300), (F.lit("+1"), 280), (_s(k % 100), 599.5), (F.lit("gap"), 272), (F.lit("edge"), 600))))
    rows = _customers(spark, sf_dir).select(F.lit("vol").alias("doc"), F.floor(k / 40).cast("int").alias("page"), (k % 40 * 12 + 0.4).alias("top"), F.explode(words).alias("w")).select("doc", "page", "top", "w.*")
    return station_table.cells(rows).select("page", "row_top", "cell", "text")


STARTS = (20.0, 120.0, 220.0, 320.0, 420.0, 520.0)


def _numbered(spark, sf_dir) -> DataFrame:
    """Events with day and month, the sheet (``page``) that each is on and its place ``j`` among the five of a day there."""
    from pyspark.sql import Window

    e = A.table(spark, sf_dir, "events").withColumns({"day": F.day("ts"), "month": F.month("ts")})
    n = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("event_id")) - 1
    sheet = (F.year("ts") * 12 + F.col("month")) * 10_000 + F.floor(n / 5)
    return e.withColumns({"page": sheet.cast("int"), "j": n % 5}).drop("props")


def _page_words(e: DataFrame, second: str, cells) -> DataFrame:
    """Every event of ``_numbered`` on a page: a sheet for each user, year and month, the first half of the month on the left,
    and a further sheet wherever a day has more than five events."""
    start = F.when(F.col("day") <= 15, STARTS[0]).otherwise(STARTS[1])
    top = 100.0 + (F.col("day") - 1) % 15 * 60 + F.when(F.col("day") == 31, 900).otherwise(0) + F.col("j") * 10
    word = lambda text, x, test=F.lit(True): F.when(test, F.struct(text.alias("text"), (start + x).alias("x0")))
    words = F.filter(F.array(word(_s(F.col("day")), 0.0, F.col("j") == 0), *cells(word)), lambda w: w.isNotNull())
    body = e.select(F.col("user_id").cast("string").alias("doc"), "page", top.alias("top"), F.explode(words).alias("w")).select("doc", "page", "top", "w.*")
    names = F.array(*map(F.lit, extract_words.MONTHS))
    month = lambda i: F.concat(F.element_at(names, ((F.col("page") / 10_000).cast("int") - 1 + i) % 12 + 1), F.lit("-mois"))
    heads = [(F.lit("Day" if i % 2 == 0 else second), x, 80.0) for i, x in enumerate(STARTS)] + [(month(i), x, 60.0) for i, x in enumerate(STARTS[::2])]
    head = F.array(*(F.struct(t.alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("top")) for t, x, y in heads))
    sheets = e.select(F.col("user_id").cast("string").alias("doc"), "page").distinct().select("doc", "page", F.explode(head).alias("w")).select("doc", "page", "w.top", "w.text", "w.x0")
    both = body.unionByName(sheets)
    return both.select("doc", "page", "text", "x0", "top", (F.col("top") + 8).alias("bottom"), F.lit(620.0).alias("page_width"), F.lit(2200.0).alias("page_height"))


EVENTS = 50_000  # events whose pages one task reads


def _dealt_pages(spark, sf_dir, words: DataFrame, events: int = EVENTS) -> DataFrame:
    """Words dealt out by page to a task for each so many events, so that a task's memory does not grow with the table."""
    tasks = -(-A.table(spark, sf_dir, "events").count() // events)
    return words.repartition(max(spark.sparkContext.defaultParallelism, tasks), *extract_words.PAGE)


PAGE_SQL = "e AS (SELECT *, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d FROM events)"


@query(f"WITH {PAGE_SQL} SELECT CAST(user_id AS VARCHAR) AS doc, m AS month, d AS day, strftime(ts, '%H:%M') AS time, {R6('(event_id % 97) / CAST(10 AS DOUBLE)')} AS metres FROM e")
def tide_page(spark, sf_dir):
    v = F.col("event_id") % 97
    cells = lambda word: (word(F.date_format("ts", "HH:mm"), 25.0), word(_tenths(v), 50.0), word(_tenths(v * 3), 75.0))
    rows = extract_words.tide_page(_dealt_pages(spark, sf_dir, _page_words(_numbered(spark, sf_dir), "Jour", cells)))
    return rows.select("doc", "month", "day", "time", r6(F.col("metres")).alias("metres"))


@query(f"WITH {PAGE_SQL} SELECT CAST(user_id AS VARCHAR) AS doc, m AS month, d AS day, strftime(ts, '%H:%M') AS time, CASE WHEN event_type = 'view' THEN 'slack' ELSE 'max' END AS kind, {R6(chr(39).join(['CASE WHEN event_type IN (', 'view', ', ', 'error', ') THEN 0.0 WHEN event_type = ', 'purchase', ' THEN -(event_id % 97) / CAST(10 AS DOUBLE) ELSE (event_id % 97) / CAST(10 AS DOUBLE) END']))} AS knots, event_type = 'error' AS weak_variable FROM e")
def current_page(spark, sf_dir):
    kind, v = F.col("event_type"), F.col("event_id") % 97
    clock, slack = F.date_format("ts", "HHmm"), F.col("event_type") == "view"
    knots = F.when(kind == "error", "*").when(kind == "purchase", _tenths(-v)).otherwise(_tenths(v))
    cells = lambda word: (word(clock, 20.0, slack), word(clock, 40.0, ~slack), word(knots, 62.0, ~slack))
    rows = extract_words.current_page(_dealt_pages(spark, sf_dir, _page_words(_numbered(spark, sf_dir), "jour", cells)))
    return rows.select("doc", "month", "day", "time", "kind", r6(F.col("knots")).alias("knots"), "weak_variable")
