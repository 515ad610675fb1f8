"""Records from the text lines of yearbook pages: columns doc, page, line, text.

State that a reader would carry from line to line (area, reference port, zone) is carried by windows over the lines of
a document, so a document is one sorted run of a task and nothing needs a per-line interpreter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import close_gaps, has_footnote, recover_dotted_diff, split_joined_diff, time_diff, upper_key

# Line formats (fixed values).
NAME = r"([A-Z][A-Z\s\-'.]+?)"
PORT = rf"^{NAME}\s+(\d{{4}})\s+(-\s*\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+([A-Z]+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s*$"
HEIGHTS = rf"^{NAME}\s+" + r"\s+".join([r"(-?\d+\.\d+)"] * 7) + r"\s*$"
SHIFT = r"([+-]?\s?\d{1,2} \d{2}\*?)"
SIGNED, PLAIN = r"([+-]?\d+\.\d+\*?)", r"(\d+\.\d+\*?)"
SECONDARY = rf"^(\d{{4}})\s+(.+?)\s+-?\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+{SHIFT}\s+{SIGNED}\s+{SIGNED}\s+{SHIFT}\s+{SIGNED}\s+{SIGNED}\s+{PLAIN}\s+{PLAIN}\s+{PLAIN}\s*$"
AREA, REFERENCE = r"^AREA\s+(\d+)\s*$", r"(?i)^on/sur\s+(.+?),\s+pages\s+\d+"
NOISE = ("SECONDARY PORTS TABLE 3", "INFORMATION AND TIDAL", "RENSEIGNEMENTS", "DIFFERENCES DIFFÉRENCES", "RANGE MEAN", "PLEINE MER", "NIVEAU", "D'INDEX", "HORAIRE", "MOYENNE MARÉE", "° '", "LAT. N.", "TIDE TIDE", "IN N D O E")
SECTIONS, INDENT_X, COLUMN_SPLIT_X = ("Tide Tables", "Current Tables"), 80.0, 315.0  # contents pages; their left half counts
HEADER = r"^([A-Z][A-Z\s\-'.]*?)\s+([A-Z]{3}-[A-Z]{3})\s+\(UTC([+-]\d+)\)\s+(\d{4})\s+TIDE\s+TABLES"
DIRECTIONS = r"(?i)Flood/flot\s+direction\s+(\d+)\s+True/vraie\s+-\s*Ebb/jusant\s+direction\s+(\d+)\s+True/vraie"
AREA_LINES = 2


def _part(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def _degrees(d: Column, m: Column) -> Column:
    return d.cast("double") + m.cast("double") / 60


def port_lines(lines: DataFrame) -> DataFrame:
    """Reference ports: name, number, offset, place, type and ranges of each line of that form."""
    t = close_gaps(F.trim("text"))
    rows = lines.withColumn("_t", t).where(F.col("_t").rlike(PORT))
    g = lambda i: _part(F.col("_t"), PORT, i)
    return rows.select(
        "doc", F.trim(g(1)).alias("name"), g(2).cast("int").alias("index_no"), F.regexp_replace(g(3), r"\s", "").cast("int").alias("utc_offset"),
        _degrees(g(4), g(5)).alias("latitude"), (-_degrees(g(6), g(7))).alias("longitude"), g(8).alias("tide_type"), g(9).cast("double").alias("mean_tide_range"), g(10).cast("double").alias("large_tide_range"),
    )


HEIGHT_FIELDS = ("higher_high_water_mean_tide", "higher_high_water_large_tide", "lower_low_water_mean_tide", "lower_low_water_large_tide", "highest_recorded_high_water", "lowest_recorded_low_water", "mean_water_level")


def height_lines(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("_t", close_gaps(F.trim("text"))).where(F.col("_t").rlike(HEIGHTS))
    return rows.select("doc", F.trim(_part(F.col("_t"), HEIGHTS, 1)).alias("name"), *(_part(F.col("_t"), HEIGHTS, i + 2).cast("double").alias(f) for i, f in enumerate(HEIGHT_FIELDS)))


def _kinds(lines: DataFrame) -> DataFrame:
    """Lines that count, with their kind and the text of rows set right."""
    t = F.trim("text")
    by_page = Window.partitionBy("doc", "page")
    note = F.min(F.when(F.startswith(t, F.lit("*")), F.col("line"))).over(by_page)  # footnotes run to the end of a page
    rows = lines.withColumn("_t", t).withColumn("_note", note).where("_t <> '' and _t <> 'RÉGION' and (_note is null or line < _note)").where(~F.col("_t").rlike(r"^\d+$"))
    fixed = split_joined_diff(F.col("_t"))
    rows = rows.withColumn("_row", F.when(fixed.rlike(SECONDARY), fixed).when(recover_dotted_diff(fixed).rlike(SECONDARY), recover_dotted_diff(fixed)))
    noise = F.lit(False)
    for n in NOISE:
        noise = noise | F.contains(F.col("_t"), F.lit(n))
    x = F.col("_t")
    skipped = F.startswith(x, F.lit("see/voir")) | (F.startswith(x, F.lit("(")) & F.endswith(x, F.lit(")"))) | noise
    kind = F.when(F.col("_row").isNotNull(), "row").when(x.rlike(r"^\d{4}\s"), "bad").when(x.rlike(AREA), "area").when(x.rlike(REFERENCE), "reference").when(skipped, "noise").otherwise("other")
    return rows.withColumn("kind", kind)


def secondary_port_lines(lines: DataFrame) -> DataFrame:
    """Secondary ports with the area, reference port and zone that stand above them.

    An area's name is the first ``AREA_LINES`` lines below its first heading, up to its first port. Other lines are a
    zone: those without a port between them belong together, and a zone holds until the next one, area or reference."""
    over = Window.partitionBy("doc").orderBy("page", "line")
    so_far = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark, other = F.col("kind").isin("area", "reference"), F.col("kind") == "other"
    rows = _kinds(lines)
    rows = rows.withColumn("block", F.sum(mark.cast("int")).over(so_far))
    rows = rows.withColumn("area_number", F.last(F.when(F.col("kind") == "area", _part(F.col("_t"), AREA, 1).cast("int")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("reference_port", F.last(F.when(F.col("kind") == "reference", F.trim(_part(F.col("_t"), REFERENCE, 1))), ignorenulls=True).over(so_far))
    in_block = Window.partitionBy("doc", "block").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_ports", F.count_if(F.col("kind") == "row").over(in_block)).withColumn("_nth", F.count_if(other).over(in_block)).withColumn("_head", F.first("kind").over(in_block))
    candidate = other & (F.col("_head") == "area") & (F.col("_ports") == 0)
    first = F.min(F.when(candidate, F.col("block"))).over(Window.partitionBy("doc", "area_number"))
    rows = rows.withColumn("_name", candidate & (F.col("block") == first) & (F.col("_nth") <= AREA_LINES))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_name"), F.struct("page", "line", "_t"))).over(Window.partitionBy("doc", "area_number"))), lambda x: x["_t"]), " ")
    rows = rows.withColumn("area_name", F.nullif(names, F.lit("")))
    zone_line = F.when(other & ~F.col("_name"), F.struct("page", "line", "_t"))
    zone = F.array_join(F.transform(F.array_sort(F.collect_list(zone_line).over(Window.partitionBy("doc", "block", "_ports"))), lambda x: x["_t"]), " ")
    rows = rows.withColumn("_zone", F.when(zone_line.isNotNull(), zone))
    rows = rows.withColumn("geographic_zone", F.last("_zone", ignorenulls=True).over(in_block)).where("kind = 'row'")
    g = lambda i: _part(F.col("_row"), SECONDARY, i)
    number = lambda i: F.regexp_replace(g(i), r"\*", "").cast("double")
    return rows.select(
        "doc", g(1).cast("int").alias("index_no"), F.trim(g(2)).alias("name"), (-g(3).cast("int")).alias("utc_offset"), _degrees(g(4), g(5)).alias("latitude"), (-_degrees(g(6), g(7))).alias("longitude"),
        "area_number", "area_name", "geographic_zone", "reference_port", time_diff(g(8)).alias("higher_high_water_time_diff"), number(9).alias("higher_high_water_mean_tide_diff"), number(10).alias("higher_high_water_large_tide_diff"),
        time_diff(g(11)).alias("lower_low_water_time_diff"), number(12).alias("lower_low_water_mean_tide_diff"), number(13).alias("lower_low_water_large_tide_diff"), number(14).alias("mean_tide_range"), number(15).alias("large_tide_range"), number(16).alias("mean_water_level"),
        has_footnote(F.concat(*(g(i) for i in range(8, 14)))).alias("has_footnote"),
    )


def tide_header(first_line: Column) -> Column:
    """Struct of name, timezone, utc_offset and year of a tide page's first line; null for another page."""
    g = lambda i: _part(first_line, HEADER, i)
    return F.when(first_line.rlike(HEADER), F.struct(F.trim(g(1)).alias("name"), g(2).alias("timezone"), g(3).cast("int").alias("utc_offset"), g(4).cast("int").alias("year")))


def current_header(lines: Column) -> Column:
    """Struct of name, utc_offset and year of a current page, whose first three lines are the year, the name and the zone;
    null for another page."""
    year, name, zone = (F.trim(F.get(lines, F.lit(i))) for i in range(3))
    offset = F.nullif(F.regexp_extract(zone, r"\(UTC([+-]\d+)h?\)", 1), F.lit(""))
    fits = year.rlike(r"^\d{4}$") & name.rlike(r"^\p{Lu}") & offset.isNotNull()
    return F.when(fits, F.struct(name.alias("name"), offset.try_cast("int").alias("utc_offset"), year.try_cast("int").alias("year")))


def flow_directions(text: Column) -> Column:
    g = lambda i: F.nullif(_part(text, DIRECTIONS, i), F.lit("")).cast("int")
    return F.struct(g(1).alias("flood"), g(2).alias("ebb"))


def table_numbers(title: Column) -> Column:
    """Numbers in a mark such as ``(Tables 1, 2 and 3)``; empty without one."""
    inside = F.regexp_extract(title, r"(?i)\(Tables?\s+([\d\s,and]+?)\)", 1)
    return F.transform(F.regexp_extract_all(inside, F.lit(r"(\d+)")), lambda x: x.cast("int"))


def contents(rows: DataFrame) -> DataFrame:
    """Entries of contents pages (doc, row, text and x0, where the line begins): section, title, printed page, and the tables
    that an entry names. A line at the margin without a page opens a section; one with a page lists tables and closes it;
    an indented one with a page is a station of the section, and none outside of one."""
    entry = r"^(.+?)[\s.]+(\d{1,3})$"
    by = Window.partitionBy("doc").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    indented, paged = F.col("x0") >= INDENT_X, F.col("text").rlike(entry)
    title = F.when(paged, F.trim(_part(F.col("text"), entry, 1)))
    opened = F.last(F.when(~indented, F.struct(F.when(~paged & F.trim("text").isin(*SECTIONS), F.trim("text")).alias("s"))), ignorenulls=True).over(by)["s"]
    rows = rows.withColumns({"section": opened, "title": title, "tables": F.when(~indented & paged, table_numbers(title)).otherwise(F.array().cast("array<int>"))})
    station = indented & F.col("section").isNotNull()
    return rows.where(paged & (station | (F.size("tables") > 0))).select("doc", "row", "section", "title", _part(F.col("text"), entry, 2).cast("int").alias("printed_page"), "tables")


def page_offset(words: DataFrame) -> DataFrame:
    """What to add to a printed page for the file's page, from the lowest word of the contents page (doc, page, text, top);
    null where that is no number."""
    lowest = words.groupBy("doc", "page").agg(F.max_by("text", "top").alias("t"))
    return lowest.select("doc", (F.col("page") - F.when(F.col("t").rlike(r"^\d+$"), F.col("t")).try_cast("int")).alias("offset"))


def page_ranges(entries: DataFrame, last_page: Column) -> DataFrame:
    """first_page and end_page (exclusive) of each entry: the next entry's page, or ``last_page``."""
    by = Window.partitionBy("doc").orderBy("printed_page", "row")
    return entries.withColumn("first_page", F.col("printed_page")).withColumn("end_page", F.coalesce(F.lead("printed_page").over(by), last_page))


def merge_by_position(stations: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations with the table's columns at the same position of a document, and the rows that do not fit: unequal
    numbers of rows, a name that does not begin with the table's, another offset."""
    t = table.select("doc", "pos", F.struct(*[c for c in table.columns if c not in ("doc", "pos")]).alias("_t"))
    rows = stations.join(t, ["doc", "pos"], "full_outer")
    has_offset = "utc_offset" in table.columns and "utc_offset" in stations.columns
    wrong = F.when(F.col("name").isNull() | F.col("_t").isNull(), "count").when(~F.startswith(F.col("name"), F.col("_t.name")), "name")
    if has_offset:
        wrong = wrong.when(F.col("utc_offset") != F.col("_t.utc_offset"), "offset")
    rows = rows.withColumn("problem", wrong)
    extra = [c for c in table.columns if c not in ("doc", "pos", *stations.columns)]
    good = rows.where("problem is null").select(*stations.columns, *(F.col(f"_t.{c}").alias(c) for c in extra))
    return good, rows.where("problem is not null").select("doc", "pos", "problem")


def merge_by_name(stations: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same by upper-case name without marks; problems are names met twice and names that match nothing."""
    key = lambda df: df.withColumn("_key", upper_key(F.col("name")))
    s, t = key(stations), key(table)
    twice = t.groupBy("doc", "_key").count().where("count > 1").select("doc", "_key", F.lit("twice").alias("problem"))
    lost = t.join(s, ["doc", "_key"], "left_anti").select("doc", "_key", F.lit("unmatched").alias("problem"))
    extra = [c for c in table.columns if c not in stations.columns]
    good = s.join(t.join(twice, ["doc", "_key"], "left_anti").select("doc", "_key", *extra), ["doc", "_key"]).drop("_key")
    return good, twice.unionByName(lost)
