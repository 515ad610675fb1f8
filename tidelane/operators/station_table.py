"""The table of current stations, from the placed words of its pages (doc, page, text, x0, top).

Rows are words of one rounded height. What the rows above leave behind for a station (the port that its differences count
from, a zone, a mark that they count from tides) are windows over the rows of a page: a port is the last one so far; zones
and marks hold until a secondary station or a port, so the rows between two of those are one group; and a remark in
parentheses belongs to the group of rows behind its station. Words are shuffled once, by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract_lines import REFERENCE

# Columns by x; the first that fits counts (fixed values).
COLUMNS = {
    "index": (40.0, 70.0), "name": (70.0, 180.0), "flood_dir": (180.0, 210.0), "lat_d": (205.0, 220.0), "lat_m": (220.0, 235.0), "lon_d": (235.0, 252.0), "lon_m": (252.0, 270.0),
    "turn_flood": (275.0, 318.0), "flood_max": (318.0, 358.0), "turn_ebb": (358.0, 405.0), "ebb_max": (405.0, 445.0), "max_flood": (445.0, 480.0), "max_ebb": (480.0, 510.0), "pct_flood": (510.0, 545.0), "pct_ebb": (545.0, 600.0),
}
# Headings of the table (fixed values).
HEADINGS = (
    "REFERENCE AND SECONDARY", "STATIONS DE RÉFERENCE", "STATIONS DE RÉFÉRENCE", "INFORMATION RATES", "INFORMATION VITESSES", "CURRENT STATIONS", "INDEX POSITION", "NO. CURRENT STATION", "DIFFÉRENCES DE TEMPS", "D'INDEX STATION", "REFERENCE STATION",
    "STATION DE RÉFÉRENCE", "SECONDARY STATION", "STATION SECONDAIRE", "TURN TO MAXIMUM", "TIME DIFFERENCES", "MAXIMUM RATE", "% REF.", "% VITESSE", "FLOOD FLOOD EBB EBB", "FLOT JUSANT", "RENV. VERS", "° true", "° vraie", "noeuds", "DIR. DU", "DIR. OF FLOOD", "knots knots",
)
FROM_TIDES, LOW, HIGH, NOTE = "LW HW", "LW", "HW", "(a)"
INDEX_END = COLUMNS["index"][1]


def column_of(x0: Column) -> Column:
    """Name of the column at x."""
    out = F.lit(None).cast("string")
    for name, (low, high) in reversed(COLUMNS.items()):
        out = F.when((x0 >= low) & (x0 < high), name).otherwise(out)
    return out


def _row_top() -> Column:
    return F.bround("top", 0).cast("int").alias("row_top")


def cells(words: DataFrame) -> DataFrame:
    """A row for each rounded height and column, its words from left to right."""
    rows = words.select("doc", "page", _row_top(), column_of(F.col("x0")).alias("cell"), "x0", "text").where("cell is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy("doc", "page", "row_top", "cell").agg(joined.alias("text"))


def _cell(name: str, without: Column | None = None) -> Column:
    """The texts of a column's words."""
    found = F.filter("words", lambda w: w["cell"] == name)
    texts = F.transform(found, lambda w: w["text"])
    return texts if without is None else F.filter(texts, lambda t: t != without)


def _whole(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def _degrees(name: str) -> Column:
    part = lambda p: _whole(F.get(_cell(f"{name}_{p}"), F.lit(0)))
    return part("d") + part("m") / 60


def _difference(texts: Column) -> tuple[Column, Column]:
    """``±HH:MM`` from the words of hours and minutes, and whether one of them has a footnote's mark."""
    hours, minutes = F.get(texts, F.lit(0)), F.get(texts, F.lit(1))
    marked = F.coalesce(F.contains(hours, F.lit(NOTE)) | F.contains(minutes, F.lit(NOTE)), F.lit(False))
    h = F.regexp_extract(hours, r"^([+-]?)(\d+)$", 2)
    m = F.regexp_extract(F.replace(minutes, F.lit(NOTE), F.lit("")), r"^\s*(\d+)\s*$", 1)
    two = lambda digits: F.format_string("%02d", digits.cast("int"))
    return F.when((h != "") & (m != ""), F.concat(F.when(F.startswith(hours, F.lit("-")), "-").otherwise("+"), two(h), F.lit(":"), two(m))), marked


def _rows(words: DataFrame) -> DataFrame:
    """Rows of a page with their words, text and kind: station, port, tides, remark or zone."""
    word = F.struct("x0", "text", column_of(F.col("x0")).alias("cell"))
    rows = words.select("doc", "page", _row_top(), word.alias("w")).groupBy("doc", "page", "row_top").agg(F.array_sort(F.collect_list("w")).alias("words"))
    rows = rows.withColumn("line", F.trim(F.array_join(F.transform("words", lambda w: w["text"]), " ")))
    first, line = F.get("words", F.lit(0)), F.col("line")
    heading = F.lit(False)
    for text in HEADINGS:
        heading = heading | F.contains(line, F.lit(text))
    other = heading | (line == "") | line.rlike(r"^\d+$") | F.startswith(line, F.lit(NOTE)) | F.startswith(line, F.lit("*"))
    kind = (
        F.when(first["text"].rlike(r"^\d{4}$") & (first["x0"] < INDEX_END), F.when(first["cell"] == "index", "station"))
        .when(line.rlike(REFERENCE), "port").when(line == FROM_TIDES, "tides")
        .when(line.rlike(r"^\(.*\)$") & ~F.startswith(line, F.lit(NOTE)), "remark").when(~other, "zone")
    )
    return rows.withColumn("kind", kind).where("kind is not null")


def current_stations(words: DataFrame) -> DataFrame:
    """Stations of the table, those above a page's first port with the role ``reference``, the others ``secondary``.

    A secondary station whose differences count from tides, by a mark above it or ``LW`` and ``HW`` in its own row, takes the
    zone above as the first part of its name. Only the first remark behind a station counts."""
    page = Window.partitionBy("doc", "page").orderBy("row_top")
    so_far, before = page.rowsBetween(Window.unboundedPreceding, Window.currentRow), page.rowsBetween(Window.unboundedPreceding, -1)
    port = F.when(F.col("kind") == "port", F.trim(F.regexp_extract("line", REFERENCE, 1)))
    rows = _rows(words).withColumn("reference_primary", F.last(port, ignorenulls=True).over(so_far))
    secondary = (F.col("kind") == "station") & F.col("reference_primary").isNotNull()
    rows = rows.withColumns({"_group": F.coalesce(F.count_if(secondary | (F.col("kind") == "port")).over(before), F.lit(0)), "_nth": F.count_if(secondary).over(so_far)})
    group = Window.partitionBy("doc", "page", "_group").orderBy("row_top").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("doc", "page", "_nth").orderBy("row_top").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = lambda kind: F.when(F.col("kind") == kind, F.col("line"))
    rows = rows.withColumns({"_zone": F.last(line("zone"), ignorenulls=True).over(group), "_tides": F.last(line("tides"), ignorenulls=True).over(group), "_remark": F.first(line("remark"), ignorenulls=True).over(behind)})

    texts = F.transform("words", lambda w: w["text"])
    inline = F.array_contains(texts, LOW) & F.array_contains(texts, HIGH)
    is_secondary = F.col("reference_primary").isNotNull()
    tides = is_secondary & (inline | F.col("_tides").isNotNull())
    own = F.trim(F.array_join(_cell("name"), " "))
    diffs = {"turn_to_flood_diff": ("turn_flood", F.lit(LOW)), "flood_max_diff": ("flood_max", None), "turn_to_ebb_diff": ("turn_ebb", F.lit(HIGH)), "ebb_max_diff": ("ebb_max", None)}
    made, marks = [], F.lit(False)
    for name, (cell, label) in diffs.items():
        value, marked = _difference(_cell(cell))
        if label is None:  # a row with LW and HW has turns alone
            value, marked = F.when(~inline, value), ~inline & marked
        else:
            bare = _difference(_cell(cell, label))
            value, marked = F.when(inline, bare[0]).otherwise(value), F.when(inline, bare[1]).otherwise(marked)
        made.append(F.when(is_secondary, value).alias(name))
        marks = marks | marked
    first = lambda cell: F.get(_cell(cell), F.lit(0))
    direction = F.when(first("flood_dir").rlike(r"^\d+$"), first("flood_dir").try_cast("int"))
    return rows.where("kind = 'station'").select(
        "doc", "page", F.get("words", F.lit(0))["text"].cast("int").alias("index_no"), F.when(tides & F.col("_zone").isNotNull(), F.trim(F.concat_ws(" ", "_zone", own))).otherwise(own).alias("name"),
        F.when(is_secondary, "secondary").otherwise("reference").alias("role"), direction.alias("flood_direction_true"), _degrees("lat").alias("latitude"), (-_degrees("lon")).alias("longitude"),
        "reference_primary", F.when(is_secondary & ~tides, F.col("_zone")).alias("geographic_zone"), F.when(is_secondary, F.col("_remark")).alias("name_annotation"), *made,
        F.when(is_secondary, _whole(first("pct_flood"))).alias("pct_ref_flood"), F.when(is_secondary, _whole(first("pct_ebb"))).alias("pct_ref_ebb"),
        first("max_flood").try_cast("double").alias("max_flood_knots"), first("max_ebb").try_cast("double").alias("max_ebb_knots"), tides.alias("offsets_from_tides"), (is_secondary & marks).alias("has_footnote"),
    )
